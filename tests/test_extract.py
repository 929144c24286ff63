from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from abacusflow.operators import extract, periods, vouchers
from abacusflow.sources import tables

LINES = "d int, n int, t string"


def lines(spark, *told):
    return spark.createDataFrame([(1, n, t) for n, t in enumerate(told)], LINES)


def test_sections_and_blocks(spark):
    df = lines(spark, "a", "START", "b", "c", "END", "d", "START", "e")
    found = extract.sections(df, ["d"], "n", F.col("t") == "START", F.col("t") == "END").orderBy("n").collect()
    assert [r["t"] for r in found if r["in_section"]] == ["b", "c", "e"]
    df = lines(spark, "x", "01/02 pay", "more", "02/02 fee")
    found = extract.blocks(df, ["d"], "n", "t", F.col("t").rlike(r"^\d")).orderBy("block").collect()
    assert [(r["block"], r["first_line"], r["text"]) for r in found] == [(0, 0, "x"), (1, 1, "01/02 pay more"), (2, 3, "02/02 fee")]


def test_inherited_values(spark):
    df = lines(spark, "x", "ENERO", "1", "2", "MARZO", "3")
    month = F.when(F.col("t").rlike("^[A-Z]+$"), F.col("t"))
    assert [r["m"] for r in extract.inherited(df, ["d"], "n", month, "m").orderBy("n").collect()] == [None, "ENERO", "ENERO", "ENERO", "MARZO", "MARZO"]


def test_records_across_lines(spark):
    text = "+ VENTAS $ 10,00\n- ARANCEL $ 1,00\nNETO $ 9,00 dia 01/02/2024\n+ VENTAS $ 5,00 NETO $ 5,00 dia 02/02/2024 junk"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "nothing")], "d int, t string")
    pattern = r"(?s)\+ VENTAS \$ ([\d.]+,\d{2})((?:(?!\+ VENTAS).)*?)NETO \$ ([\d.]+,\d{2}).*?(\d{2}/\d{2}/\d{4})"
    found = extract.records(docs, ["d"], "t", pattern, ["sales", "cuts", "net", "day"]).orderBy("match").collect()
    assert [(r["sales"], r["net"], r["day"]) for r in found] == [("10,00", "9,00", "01/02/2024"), ("5,00", "5,00", "02/02/2024")]
    cuts = spark.createDataFrame([(1, "- ARANCEL", D("1.00")), (1, "- IVA ARANCEL", D("0.21")), (1, "- ODD", D("3.00"))], "k int, label string, x decimal(18,2)")
    row = extract.column_by_kind(cuts, ["k"], "label", "x", {"vat": "IVA", "fee": "ARANCEL"}).first()
    assert (row["vat"], row["fee"], row["other"], row["unknown"]) == (D("0.21"), D("1.00"), D("3.00"), 1)


def test_fallbacks_and_numbers(spark):
    one = spark.createDataFrame([("Total: 5",)], "t string").select(extract.first_of(F.col("t"), [r"Neto: (\d+)", r"Total: (\d+)"]).alias("r")).first()["r"]
    assert one == "5"
    rows = [(["100.00", "2.500000", "250.00"],), (["2.5", "250"],), (["250000", "2.5"],), (["1"],)]
    found = [r["r"] for r in spark.createDataFrame(rows, "n array<string>").select(extract.number_roles(F.col("n")).alias("r")).collect()]
    assert [tuple(map(float, r)) if r else None for r in found] == [(100, 2.5, 250), (100, 2.5, 250), (100000, 2.5, 250000), None]


def test_vouchers_and_operations(spark):
    told = [("Nota de Crédito A", "NCA"), ("ND", "ND"), ("Fact. B", "B"), ("006", "B"), ("LQ", "LQ"), (None, "")]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in told], "t string").select(vouchers.voucher_kind(F.col("t"))).collect()] == [w for _, w in told]
    assert spark.createDataFrame([("006",)], "t string").select(vouchers.voucher_kind(F.col("t"), vouchers.MATCHER_CODES)).first()[0] == "NCA"
    ops = [("Rescate FCI", 1, "Rescate"), ("suscripción", 1, "Suscripcion"), ("x", -1, "Venta"), ("", None, "Movimiento"), ("Pago de cupón", None, "Renta")]
    rows = spark.createDataFrame([(t, u) for t, u, _ in ops], "t string, u int")
    assert [r[0] for r in rows.select(vouchers.operation_kind(F.col("t"), F.col("u"), F.lit(None).cast("int"))).collect()] == [w for _, _, w in ops]


def test_merge_without_repeats(spark):
    schema = "k string, d date, x decimal(18,2)"
    old = spark.createDataFrame([("a", date(2024, 1, 5), D(10)), ("a", date(2024, 1, 6), D(5))], schema)
    new = spark.createDataFrame([("a", date(2024, 1, 5), D(10)), ("a", date(2024, 1, 31), D(15)), ("a", date(2024, 1, 9), D(7)), ("a", date(2024, 1, 9), D(7)), ("b", date(2024, 1, 9), D(7))], schema)
    found = sorted((r["k"], r["d"].day, r["x"]) for r in periods.merged(old, new, ["k"], "d", "x").collect())
    assert found == [("a", 5, D(10)), ("a", 6, D(5)), ("a", 9, D(7)), ("b", 9, D(7))]


def test_sources(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Código;Descripción;a;b;c\n01;x;1;2;3\n")
    df = tables.read_csv(spark, str(tmp_path / "one.csv"))
    found = tables.resolve(df, {"code": ["codigo"], "name": ["Detalle", "Descripcion"], "none": ["zz"]}, needed=("code",))
    assert found.columns == ["code", "name"] and found.first()["code"] == "01"
    (tmp_path / "two.csv").write_text("Código;Descripción;a;b;c\n01;x;1;2;3\n")
    files = {r["path"].rpartition("/")[2]: r["first"] for r in tables.read_files(spark, str(tmp_path), "*.csv").collect()}
    assert files == {"one.csv": True, "two.csv": False}
    cells = spark.createDataFrame([("s", 0, 0, "Title"), ("s", 2, 0, "Fecha"), ("s", 2, 1, "Importe"), ("s", 3, 0, "importe x")], "sheet string, row int, col int, value string")
    assert tables.header_row(cells, ["FECHA", "IMPORTE"]).first()["row"] == 2
    words = spark.createDataFrame([(1, 1, 50, 31, "b"), (1, 1, 10, 33, "a"), (1, 1, 5, 50, "c")], "d int, p int, x int, y int, t string")
    assert sorted(r["text"] for r in tables.lines_from_words(words, "d", "p", "x", "y", "t").collect()) == ["a b", "c"]


def test_partitions_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.partitionBy("k").parquet(path)
    tables.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
