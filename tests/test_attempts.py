"""Extraction in several attempts."""

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from abacusflow.operators import attempts

LINES = "Cuota Vencimiento Capital Interés Total\n1 05/02/2024 1.000,00 50,00 1.050,00\n2 05/03/2024 1.000,00 40,00 1.040,00\n"
FIELDS = "Préstamo\n 1\n 05/02/2024\n 1.000,00\n 50,00\n 1.050,00\n2\n05/03/2024\n1.000,00\n40,00\n1.040,00\n"
SCAN = "1 O5/02/2O24 1.OOO,00 5O,00 1.050.OO\n2 05.03.2024 1,000.00 40,00 l.040,00\n"
ZEROS = "1 05/02/2024 0,00 0,00 0,00\n2 05/03/2024 0,00 0,00 0,00\n"
DAMAGED = "1 99/99/2024 1,00 1,00 2,00\n2 05/03/2O24 1,OO 2,00 3,00\n3 O6/O3/2024 1,00 1,00 2,00\n"


def test_three_layouts(spark):
    docs = spark.createDataFrame([("lines", LINES), ("fields", FIELDS), ("scan", SCAN), ("zeros", ZEROS), ("none", "nothing here"), ("null", None), ("damaged", DAMAGED)], "doc string, text string")
    rows, log = attempts.loan_schedules(docs, "doc", "text")
    found = {}
    for r in rows.collect():
        found.setdefault(r["doc"], []).append((r["n"], r["due_date"], r["capital"], r["interest"], r["due"], r["strategy"]))
    wanted = [(1, date(2024, 2, 5), D(1000), D(50), D(1050)), (2, date(2024, 3, 5), D(1000), D(40), D(1040))]
    for layout in ("lines", "fields", "scan"):
        assert sorted(found[layout]) == [(*w, layout) for w in wanted]
    assert set(found) == {"lines", "fields", "scan", "damaged"}
    told = {r["doc"]: (r["attempts"], r["strategy"], r["reason"]) for r in attempts.outcome(log, "doc").collect()}
    assert told == {"lines": (1, "lines", "OK"), "fields": (2, "fields", "OK"), "scan": (3, "scan", "OK"), "zeros": (3, None, "ZERO_AMOUNTS"), "none": (3, None, "EMPTY"), "null": (3, None, "EMPTY"), "damaged": (2, "scan", "OK")}
    assert log.groupBy("doc").count().agg(F.max("count")).first()[0] == attempts.MOST
    assert {r["n"]: r["due_date"] for r in rows.where("doc = 'damaged'").collect()} == {1: None, 2: date(2024, 3, 5), 3: date(2024, 3, 6)}


def test_only_what_fails_is_read_again(spark):
    docs = spark.createDataFrame([(k, k % 3) for k in range(9)], "doc int, kind int")
    seen = []

    def reader(name, works):
        def read(some):
            seen.append((name, sorted(r["doc"] for r in some.collect())))
            return some.where(F.col("kind") == works).select("doc", F.lit(name).alias("x"))

        return read

    chain = lambda reason, attempt: F.when(attempt == 1, "b").when(attempt == 2, F.lit("a"))
    rows, log = attempts.attempted(docs, "doc", F.lit("a"), {"a": reader("a", 0), "b": reader("b", 1)}, lambda r: r.select("doc", F.lit("OK").alias("reason")), chain, 5)
    assert sorted((r["doc"], r["x"]) for r in rows.collect()) == [(k, "ab"[k % 3]) for k in range(9) if k % 3 < 2]
    # those that no way can read have tried both and are not asked again
    assert [s for s in seen if s[1]] == [("a", list(range(9))), ("b", [1, 2, 4, 5, 7, 8])]
    assert attempts.outcome(log, "doc").where("strategy is null").count() == 3


def test_no_documents(spark):
    rows, log = attempts.loan_schedules(spark.createDataFrame([], "doc string, text string"), "doc", "text")
    assert rows.count() == log.count() == 0
