"""Charts of accounts against plain trees."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from abacusflow.operators import accounts

LINES = "entry int, k int, code string, debit decimal(18,2), credit decimal(18,2)"


def test_reading_a_chart(spark):
    cells = spark.createDataFrame([("21401", "IVA Débito Fiscal", "No", "21401", "dup"), ("2140101.0", "IVA Ventas 21%", "SI", "9", "x"), ("nan", "nothing", None, None, None), ("2140101", "IVA Ventas 21%", None, None, None)], "a string, b string, c string, d string, e string").toDF("Código", "Descripción", "Imputable", "Código", "Descripción")
    assert sorted(tuple(r) for r in accounts.chart_of(cells).collect()) == [("21401", "IVA Débito Fiscal", False), ("2140101", "IVA Ventas 21%", True)]


def above(codes, code):
    return [c for c in codes if code.startswith(c)]


def test_tree_and_roll_up(spark):
    r = random.Random(1)
    codes = sorted({"".join(r.choice("12") for _ in range(r.randint(1, 9))) for _ in range(80)})
    lines = [(0, k, r.choice([*codes, "unknown"]), D(r.randint(0, 900)) / 100, D(r.randint(0, 900)) / 100) for k in range(300)]
    tree = accounts.with_parents(spark.createDataFrame([(c, c, True) for c in codes], "code string, name string, postable boolean"))
    told = {x["code"]: (x["parent"], x["leaf"]) for x in tree.collect()}
    assert told == {c: (max((p for p in above(codes, c) if p != c), key=len, default=None), not any(d != c and d.startswith(c) for d in codes)) for c in codes}
    up = {(x["code"], x["ancestor"]): x["steps"] for x in accounts.ancestors(tree).collect()}
    assert up == {(c, a): sum(len(b) > len(a) for b in above(codes, c)) for c in codes for a in above(codes, c)}
    found = {x["code"]: (x["level"], x["own"], x["total"]) for x in accounts.rolled_up(spark.createDataFrame(lines, LINES), tree, "code", "debit", "credit").collect()}
    balance = {c: sum((d - h for _, _, x, d, h in lines if x == c), D(0)) for c in codes}
    assert found == {c: (len(above(codes, c)) - 1, balance[c], sum((balance[d] for d in codes if d.startswith(c)), D(0))) for c in codes}


def test_an_account_above_itself(spark):
    with pytest.raises(ValueError, match="above itself"):
        accounts.ancestors(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "code string, parent string"))
    deep = spark.createDataFrame([(str(k), str(k - 1) if k else None) for k in range(40)], "code string, parent string")
    assert accounts.ancestors(deep).count() == 40 * 41 // 2


def test_entries_on_closed_accounts_and_cents(spark):
    chart = spark.createDataFrame([("21401", "IVA Débito Fiscal", False), ("2140101", "IVA Ventas 21%", True)], "code string, name string, postable boolean")
    rows = [(1, 1, "21401", D(100), D(0)), (1, 2, "2140401", D(0), D(100)), (2, 1, "2140101", D("1000.03"), D(0)), (2, 2, "2140401", D(0), D("1000.00")), (3, 1, "2140101", D(10), D(0)), (3, 2, "2140401", D(0), D(1)), (4, 1, "2140101", D("5.00"), D(0)), (4, 2, "2140401", D(0), D("2.00")), (4, 3, "2140401", D(0), D("3.02"))]
    lines = spark.createDataFrame(rows, LINES)
    assert [(r["entry"], r["code"]) for r in accounts.not_postable(lines, chart, "code").collect()] == [(1, "21401")]
    out = accounts.exported(lines, chart, ["entry"], ["k"], "code", "debit", "credit")
    states = {r["entry"]: (r["s"], r["d"], r["c"]) for r in out.groupBy("entry").agg(F.min("state").alias("s"), F.sum("debit").alias("d"), F.sum("credit").alias("c")).collect()}
    assert states == {1: ("NO IMPUTABLE", D(100), D(100)), 2: ("LISTO", D("1000.00"), D("1000.00")), 3: ("DESBALANCEADO", D(10), D(1)), 4: ("LISTO", D("5.00"), D("5.00"))}
