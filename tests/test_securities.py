"""Every rule by which a security is told."""

import random

import pytest
from pyspark.sql import functions as F

from abacusflow.operators import securities as S

CASES = [  # name, description, operation, currency -> canonical, kind, confidence, reason
    ("Fima renta fija", "en dólares", None, None, "FIMA RF DOLARES", S.FUND, S.SURE, "Alias FIMA / FCI"),
    ("Fondo - Fima  otra cosa", None, None, None, "FIMA OTRA COSA", S.FUND, S.SURE, "Alias FIMA / FCI"),
    ("Fondo: Delta", "Fondo común", None, None, "Delta", S.FUND, S.SURE, "Fondo común"),
    ("Alfa", "suscripción de cuotapartes", None, None, "Alfa", S.FUND, S.SURE, "Fondo común"),
    ("u$s", None, None, None, "USD", S.DOLLAR, S.SURE, "Moneda / caja USD"),
    ("CA", "Caja de ahorro en dólares", None, None, "USD", S.DOLLAR, S.SURE, "Extracto CA en dólares"),
    ("AL30D", "dolar MEP", None, None, "AL30D", S.BOND, S.SURE, "Título público AL30D"),
    ("AL30C", None, None, None, "AL30", S.BOND, S.SURE, "Título público AL30"),
    ("bono GD30 2030", None, None, None, "GD30", S.BOND, S.SURE, "Título público GD30"),
    ("XX", "Letra del Tesoro", None, None, "XX", S.BOND, S.SURE, "Texto de título público"),
    ("Serie 4", "bono a tasa", None, None, "SERIE 4", S.BOND, S.SURE, "Texto de bono"),
    ("", "compra MEP", None, None, "USD", S.DOLLAR, S.SURE, "Operación MEP — usar Caja USD"),
    ("Cedear  Uno", None, None, None, "CEDEAR Uno", S.SHARE, S.SURE, "Cedear"),
    ("Compañía 9", "acción ordinaria", None, None, "COMPAÑÍA 9", S.SHARE, S.SURE, "Acción"),
    ("ggal", None, "compra", "ARS", "GGAL", S.SHARE, S.SURE, "Ticker corto"),
    ("Empresa 10", "ON clase 2", None, None, "Empresa 10", S.OTHER, S.REVIEW, "ON — confirmar tipo"),
    ("Fibra de carbono 1", None, None, None, "Fibra de carbono 1", S.OTHER, S.REVIEW, "No identificado"),
    (None, None, None, None, "Sin especie", S.OTHER, S.REVIEW, "No identificado"),
]


@pytest.fixture(scope="module")
def books(spark):
    catalogue = spark.createDataFrame([("AL30",), ("AL30D",), ("GD30",), ("TX26",)], "ticker string")
    aliases = spark.createDataFrame([(1, ["renta fija", "dolar"], "FIMA RF DOLARES"), (2, ["premium"], "FIMA PREMIUM"), (3, ["renta fija"], "FIMA RF")], "priority int, words array<string>, name string")
    return catalogue, aliases


def test_every_rule(spark, books):
    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "k int, n string, d string, o string, c string")
    found = {r["k"]: tuple(r["security"]) for r in S.identified(rows, "n", "d", "o", "c", *books).collect()}
    for k, (*told, canonical, kind, confidence, reason) in enumerate(CASES):
        assert found[k] == (canonical, kind, S.GROUPS[kind], confidence, reason), told
    assert len({c[-1].split(" AL")[0].split(" GD")[0] for c in CASES}) == 13


def test_longest_ticker_by_words_and_beginnings(spark):
    r = random.Random(1)
    tickers = sorted({"".join(r.choice("AB3") for _ in range(r.randint(2, 5))) for _ in range(40)})
    listed = sorted({" ".join("".join(r.choice("AB3-") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 3))) for _ in range(120)})
    found = {q["name"]: q["ticker"] for q in S.ticker_of(spark.createDataFrame([(x,) for x in listed], "name string"), spark.createDataFrame([(x,) for x in tickers], "ticker string")).collect()}
    for name in listed:
        bare = "".join(c for c in name if c.isalnum())
        held = [t for t in tickers if bare.startswith(t) or t in "".join(c if c.isalnum() else " " for c in name).split()]
        assert found.get(name) == (min(held, key=lambda t: (-len(t), t)) if held else None)


def test_nothing_to_identify(spark, books):
    none = spark.createDataFrame([], "n string, d string, o string, c string")
    assert S.identified(none, "n", "d", "o", "c", *books).count() == 0
    empty = spark.createDataFrame([], "ticker string"), spark.createDataFrame([], "priority int, words array<string>, name string")
    rows = spark.createDataFrame([("AL30", None, None, None)], "n string, d string, o string, c string").withColumn("x", F.lit(1))
    assert S.identified(rows, "n", "d", "o", "c", *empty).first()["security"]["reason"] == "No identificado"
