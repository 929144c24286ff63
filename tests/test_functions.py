from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from abacusflow.functions import dates, money, similarity, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("mode", "raw", "wanted"),
    [
        ("decimal", "1.234,56", "1234.56"),
        ("decimal", "1,234.56", "1234.56"),
        ("decimal", "1234,5", "1234.50"),
        ("decimal", "1.234", "1.23"),
        ("decimal", "2,675", "2.68"),
        ("decimal", "-12,00", "-12.00"),
        ("decimal", "nan", "0.00"),
        ("decimal", "abc", "0.00"),
        ("decimal", None, "0.00"),
        ("last_separator", "1.234.56", "1234.56"),
        ("last_separator", "1.234", "1234.00"),
        ("last_separator", "$ 24 .8oo .000 , l0", "24800000.10"),
        ("last_separator", ",5", "0.50"),
        ("last_separator", "", "0.00"),
        ("tolerant", "(1.234,50)", "-1234.50"),
        ("tolerant", "1.234", "1.23"),
        ("tolerant", "1.234.567", "1234567.00"),
        ("tolerant", "x", None),
    ],
)
def test_money(spark, mode, raw, wanted):
    assert one(spark, money.MODES[mode], raw) == (None if wanted is None else D(wanted))


def test_rates(spark):
    assert one(spark, lambda c: money.percent(c, 0.11), "11") == D("0.11")
    assert one(spark, lambda c: money.percent(c, 0.11), "1") == D("1")
    assert one(spark, lambda c: money.percent(c, 0.11), "x") == D("0.11")
    assert one(spark, money.rate_label, 10.5, "double") == "10,5%" and one(spark, money.rate_label, 21.0, "double") == "21%"


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("31/01/2024", date(2024, 1, 31)), ("31/01/24", date(2024, 1, 31)), ("2024-01-31", date(2024, 1, 31)), ("1-2-2024", date(2024, 2, 1)), ("45322", date(2024, 1, 31)), ("31/02/2024", None), ("soon", None), (None, None)],
)
def test_dates(spark, raw, wanted):
    assert one(spark, dates.parse_date, raw) == wanted


def test_scanned_dates_and_periods(spark):
    assert one(spark, dates.parse_scanned_date, "31'01*2024") == date(2024, 1, 31)
    assert one(spark, dates.parse_period, "due 202403 x") == date(2024, 3, 1)
    assert one(spark, dates.parse_period, "03/2024") == date(2024, 3, 1)
    assert one(spark, dates.parse_period, "nothing") is None
    row = spark.sql("select date'2020-02-29' s, date'2024-02-28' e").select(dates.whole_years(F.col("s"), F.col("e")).alias("y"), dates.month_name(F.col("e")).alias("m"), dates.period_label(F.col("e")).alias("p"), F.size(dates.fiscal_months(F.col("s"), F.col("e"))).alias("n")).first()
    assert tuple(row) == (3, "febrero", "02/2024", 49)


def test_text(spark):
    assert one(spark, text.fold, "  Débito\táñü \n ß ") == "DEBITO ANU SS"
    assert one(spark, text.fold, None) == ""
    assert one(spark, text.fold_words, "S.A. de C.V.") == "S A DE C V"
    assert one(spark, text.tax_id, "20-12345678-9") == "20123456789" and one(spark, text.tax_id, "12") is None
    assert one(spark, text.voucher_in, "FC A 3 - 45 x") == "00003-00000045" and one(spark, text.voucher_in, "none") is None
    assert one(spark, text.second_field, "a / Name / c") == "Name" and one(spark, text.second_field, "alone") == "alone"
    assert one(spark, text.payment_number, "pago vep 123") == "123"
    assert one(spark, text.person_type, "Ejemplo S.R.L.") == "juridica" and one(spark, text.person_type, "Ana Ejemplo") == "fisica"
    pair = spark.createDataFrame([("20111111112", "20111111113"), ("20111111112", "29111111113"), ("", "20111111113")], "a string, b string")
    assert [r[0] for r in pair.select(text.near_equal_id(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    ids = spark.createDataFrame([("x 20-11111111-2 y 30222222223 z", "30222222223")], "t string, k string").select(text.issuer_and_receiver(F.col("t"), F.col("k")).alias("r")).first()["r"]
    assert tuple(ids) == ("20111111112", "30222222223")


def test_token_set():
    assert similarity.token_set("ACME SRL", "SRL ACME") == 100
    assert similarity.token_set("ACME", "ACME SRL") == 100
    assert similarity.token_set("", "ACME") == 0
    assert 0 < similarity.token_set("ACME NORTE", "ACME SUR") < 100
    assert similarity.token_set("ABCD", "EFGH") == 0
