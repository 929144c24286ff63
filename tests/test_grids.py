"""Tables from the places of words."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from abacusflow.operators import grids

WORDS = "doc int, line int, x0 double, x1 double, text string"


def page(doc, lines):
    return [(doc, k, float(a), float(b), t) for k, line in enumerate(lines) for a, b, t in line]


def test_missing_and_wide_cells(spark):
    head = [(0, 30, "Fecha"), (100, 140, "Detalle"), (144, 160, "mov."), (200, 240, "Cantidad"), (300, 330, "Importe")]
    plain = lambda k: [(0, 50, f"{k:02d}/01/2024"), (100, 130, "Rescate"), (220, 240, f"{k}0"), (310, 330, f"{k},00")]
    wide = [(0, 50, "13/01/2024"), (100, 130, "Rescate"), (132, 212, "de-muchas-palabras"), (310, 330, "7,00")]
    lines = [head, *(plain(k) for k in range(1, 13)), wide, [(0, 50, "14/01/2024"), (310, 330, "8,00")]]
    words = spark.createDataFrame(page(1, lines) + page(2, [[(0, 9, "nothing")], [(0, 9, "here")]]), WORDS)
    columns = grids.columns_of(words, ["doc"], "line", "x0", "x1")
    assert sorted((r["column"], r["from"], r["to"]) for r in columns.where("doc = 1").collect()) == [(1, 0, 50), (2, 100, 130), (3, 220, 240), (4, 310, 330)]
    cells = grids.cells_of(words, columns, ["doc"], "line", "x0", "x1", "text")
    header = grids.header_map(cells, ["doc"], "line", [("date", ("FECHA",), ()), ("what", ("DETALLE",), ()), ("units", ("CANTIDAD",), ()), ("total", ("IMPORTE",), ())], "date")
    assert {(r["doc"], r["header"], r["column"], r["field"]) for r in header.collect()} == {(1, 0, 1, "date"), (1, 0, 2, "what"), (1, 0, 3, "units"), (1, 0, 4, "total")}
    rows = {r["line"]: (r["date"], r["what"], r["units"], r["total"]) for r in grids.mapped(cells, header, ["doc"], "line", ["date", "what", "units", "total"]).collect()}
    assert rows[1] == ("01/01/2024", "Rescate", "10", "1,00") and len(rows) == 14
    assert rows[13] == ("13/01/2024", "Rescate de-muchas-palabras", None, "7,00")
    assert rows[14] == ("14/01/2024", None, None, "8,00")


def test_header_in_the_second_line(spark):
    cells = spark.createDataFrame([(1, 0, 1, "Banco"), (1, 1, 1, "Fecha Liq."), (1, 1, 2, "Fecha"), (1, 1, 3, "Operación"), (1, 1, 4, "Valor cuota"), (1, 1, 5, "Cuotapartes"), (1, 1, 6, "Total"), (1, 2, 2, "x"), (2, 5, 1, "Fecha"), (2, 5, 2, "Total")], "doc int, line int, column int, value string")
    header = grids.header_map(cells, ["doc"], "line", grids.FUND_HEADERS, "date")
    assert {r["field"]: r["column"] for r in header.collect()} == {"date": 2, "concept": 3, "value": 4, "units": 5, "total": 6}


def test_what_is_missing_is_worked_out(spark):
    rows = spark.createDataFrame([(1, D("2"), D("3.5"), None), (2, None, D("4"), D("10")), (3, D("0"), D("4"), D("0")), (4, D("2"), D("3"), D("9"))], "k int, u decimal(18,4), v decimal(18,2), t decimal(18,2)")
    units, total = grids.completed(F.col("u"), F.col("v"), F.col("t"))
    assert {r["k"]: (r["u"], r["t"]) for r in rows.select("k", units.alias("u"), total.alias("t")).collect()} == {1: (D(2), D(7)), 2: (D("2.5"), D(10)), 3: (None, None), 4: (D(2), D(9))}


def test_no_words(spark):
    words = spark.createDataFrame([], WORDS)
    columns = grids.columns_of(words, ["doc"], "line", "x0", "x1")
    assert grids.cells_of(words, columns, ["doc"], "line", "x0", "x1", "text").count() == 0
