import itertools
import random
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from abacusflow.functions import text
from abacusflow.operators import fiscal, matching, names


def test_closing_entry_balances(spark):
    rows = [("m", "21", D("210.00"), D("100.00"), D("30.00")), ("m", "10.5", D("10.50"), D("0.00"), D("30.00")), ("n", "21", D("10.00"), D("50.00"), None)]
    found = fiscal.vat_closing(spark.createDataFrame(rows, "k string, r string, d decimal(18,2), c decimal(18,2), p decimal(18,2)"), ["k"], "r", "d", "c", "p").collect()
    for k, end in (("m", ("owed", D(0), D("90.50"))), ("n", ("carried on", D("40.00"), D(0)))):
        own = [r for r in found if r["k"] == k]
        assert sum(r["debit"] for r in own) == sum(r["credit"] for r in own)
        assert end in [(r["line"], r["debit"], r["credit"]) for r in own]


def test_residual_levy(spark):
    rows = spark.createDataFrame([(D(121), D(100), D(10), D(11)), (D(100), D(105), None, None)], "t decimal(18,2), r decimal(18,2), w decimal(18,2), l decimal(18,2)")
    residual, off = fiscal.closing_difference(F.col("t"), F.col("r"), [F.col("w")], F.col("l"))
    assert [tuple(r) for r in rows.select(residual, off).collect()] == [(D(11), D(0)), (D(0), D(0))]
    assert spark.range(1).select(fiscal.closes(F.lit(100000.0), F.lit(100090.0)), fiscal.closes(F.lit(100.0), F.lit(151.0))).first() == (True, False)


def test_schedules(spark):
    rows = [("a", D(1), date(2024, 1, 1)), ("b", D(0), None), ("b", D(0), None), ("c", D(-1), None), ("d", D(1), None)]
    found = {r["k"]: r["verdict"] for r in fiscal.plausible_schedule(spark.createDataFrame(rows, "k string, x decimal(18,2), d date"), ["k"], "x", "d").collect()}
    assert found == {"a": "OK", "b": "ZERO_AMOUNTS", "c": "NEGATIVE", "d": "MISSING_DATES"}
    loans = spark.createDataFrame([("l", 1, 1, D(5), D(95), D(0)), ("l", 1, 2, D(6), D(90), D(0)), ("l", 2, 3, D(7), D(88), D(0))], "l string, n int, o int, c decimal(18,2), b decimal(18,2), t decimal(18,2)")
    assert tuple(fiscal.consolidated_loans(loans, "l", "n", ["o"], "c", "b", "t").first()) == ("l", 2, D(95))


def test_fund_year(spark):
    rows = [("f", date(2024, 1, 1), D(10), D("1.5"), D(10), D(14)), ("f", date(2024, 2, 1), D(12), D(2), D(3), D(5))]
    df = spark.createDataFrame(rows, "f string, m date, u decimal(18,6), v decimal(18,6), mu decimal(18,6), ma decimal(18,2)")
    found = fiscal.fund_year(df, ["f"], "m", "u", "v", "mu", "ma").orderBy("m").collect()
    assert [(r["result"], r["state"]) for r in found] == [(D(1), "OK"), (D(4), "ERROR")]


def test_small_things(spark):
    row = spark.sql("select map('a', cast(1.5 as decimal(18,2)), 'b', null) m, map('a', cast(0 as decimal(18,2))) z").select(fiscal.debt_at(F.col("m")), fiscal.debt_at(F.col("z"))).first()
    assert tuple(row) == (D("1.50"), None)
    entry = spark.createDataFrame([(date(2024, 3, 1), "D", "1.1", D("5.10"), D(0))], "d date, k string, a string, x decimal(18,2), y decimal(18,2)")
    assert fiscal.journal_lines(entry, {"D": "DIA"}, "d", "k", "a", "x", "y").first()[0] == "20240301;DIA;1.1;5.10;0.00"
    told = spark.createDataFrame([(1, 1, D(5), ["a"]), (1, 2, None, ["b"]), (1, 3, D(7), []), (1, 4, None, ["c"])], "k int, o int, v decimal(18,2), l array<string>")
    assert tuple(fiscal.last_told(told, ["k"], ["o"], "v", "l").first()) == (1, D(7), ["a", "b", "c"])


def test_closest_subset_equals_brute_force(spark):
    r = random.Random(8)
    items = [("g", k, D(r.randint(1, 900)) / 100) for k in range(12)]
    goals = [("g", t, D(r.randint(300, 5000)) / 100) for t in range(4)]
    found = matching.closest_subset(spark.createDataFrame(items, "g string, i int, x decimal(18,2)"), spark.createDataFrame(goals, "g string, t int, y decimal(18,2)"), ["g"], "i", "x", "t", "y", ["i"], pool=8, most=4).collect()
    for q in found:
        goal = next(y for _, t, y in goals if t == q["target"])
        best = min(abs(goal - sum(x[2] for x in c)) for n in range(1, 5) for c in itertools.combinations(items[:8], n))
        assert q["off"] == best and abs(goal - sum(x[2] for x in items if x[1] in q["members"])) == best and len(q["members"]) <= 4


def test_lists_and_tickers(spark):
    lists = spark.createDataFrame([("Mercadería", "tornillo de acero"), ("Servicio", "flete")], "kind string, name string")
    rows = spark.createDataFrame([(1, "Flete a planta"), (2, "acero tornillo"), (3, "zzz"), (4, None), (5, "tornillo largo")], "k int, t string")
    found = {r["k"]: r["label"] for r in names.by_lists(rows, "t", lists).collect()}
    assert found[1] == "Servicio" and found[2] == "Mercadería" and found[4] == "PENDIENTE"
    assert found[5].startswith("PENDIENTE (probable Mercadería")
    cats = spark.createDataFrame([("Admin.  b",), ("Cajera C",), ("jefe",), ("Vendedor z",)], "t string")
    own = names.canonical(F.col("t"), {"jefe": "Jefe"}, {"admin": ("Administrativo", "ABCDEF"), "cajer": ("Cajero", "ABC"), "vendedor": ("Vendedor", "ABCD")})
    assert [r[0] for r in cats.select(own).collect()] == ["Administrativo B", "Cajero C", "Jefe", None]
    book = spark.createDataFrame([("AB", "Short", "bono"), ("ABCD", "Long", "accion")], "ticker string, name string, kind string")
    rows = spark.createDataFrame([(1, "compra abcd ab"), (2, "venta x")], "k int, t string")
    assert {r["k"]: r["security"] and r["security"]["name"] for r in names.by_ticker(rows, "t", book).collect()} == {1: "Long", 2: None}


def test_names_of_files(spark):
    row = spark.createDataFrame([("20111111112_006_3_45.pdf",)], "n string").select(text.from_file_name(F.col("n")).alias("r")).first()["r"]
    assert tuple(row) == ("20111111112", "006", "00003-00000045")
    told = spark.createDataFrame([("Inicio de actividades: 01/01/2000 y algunas palabras que siguen, de Fecha 05/06/2024",), ("nada",)], "t string").select(text.date_in(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in told] == [date(2024, 6, 5), None]


def test_grids_balances_and_noise(spark):
    from abacusflow.operators import extract, reports

    grid = spark.createDataFrame([("sales", *[D(5) if m == 1 else None for m in range(12)]), ("rent", *[D(2) if m < 2 else None for m in range(12)])], "c string, " + ", ".join(f"m{m} decimal(18,2)" for m in range(1, 13)))
    found = {r["month"]: (r["income"], r["cost"]) for r in reports.from_grid(grid, "c", {"income": ["sales"], "cost": ["rent"]}).collect()}
    assert found == {1: (D(0), D(2)), 2: (D(5), D(2))}
    paid = spark.createDataFrame([("x", D(5)), ("x", D(6)), ("y", D(1))], "b string, c decimal(18,2)")
    opening = spark.createDataFrame([("x", D(10))], "b string, o decimal(18,2)")
    assert {r["b"]: r["left"] for r in reports.suggested_balances(paid, opening, "b", "c", "o").collect()} == {"x": D(0), "y": None}
    labels = spark.createDataFrame([("Total general",), ("Nota de crédito total",), ("Proveedor",), ("",)], "t string")
    assert [r[0] for r in labels.select(reports.wanted_rows(F.col("t"), "TOTAL|CONTROL", "NOTA DE CREDITO")).collect()] == [False, True, True, False]
    texts = spark.createDataFrame([("a=1 b=2",), ("c=3",), ("none",)], "t string")
    field = lambda k: F.regexp_extract("t", rf"{k}=(\d)", 1)
    forms = {"one": F.struct(field("c").alias("c")), "two": F.struct(field("a").alias("a"), field("b").alias("b"))}
    assert [r[0]["form"] for r in texts.select(extract.best_form(forms)).collect()] == ["two", "one", None]


def test_amounts_of_a_ledger(spark):
    rows = spark.createDataFrame([(1, D(5)), (2, D(5)), (3, D(7))], "r int, x decimal(18,2)")
    ledger = spark.createDataFrame([(10, D(5), "A"), (11, D(9), "B")], "l int, x decimal(18,2), account string")
    found = matching.by_amount_else(rows, ledger, "r", "l", "x", "account", F.lit("99999")).collect()
    assert {r["r"]: r["account"] for r in found} == {1: "A", 2: "99999", 3: "99999"}
