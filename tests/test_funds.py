"""Fund years against plain queues."""

import datetime
import random
from collections import defaultdict, deque
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from abacusflow.operators import funds

D = Decimal
LOTS = "fund string, day date, seq long, units decimal(28,6), unit_value decimal(18,8), origin string"
MOVES = "fund string, day date, seq long, side string, units decimal(28,6), price decimal(18,8), amount decimal(18,2)"
CENT = D("0.01")


def date(k):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=k)


def span(a, b):
    return F.lit(date(a)), F.lit(date(b))


def moves_of(seed, n):
    r = random.Random(seed)
    out = []
    for k in range(n):
        units, price = D(r.randrange(1, 5000)) / 100, D(r.randrange(100, 900)) / 100
        out.append((r.choice("ab"), date(r.randrange(300)), k, r.choice("SSR"), units, price, (units * price).quantize(CENT, ROUND_HALF_UP)))
    return out


def queues(moves, start):
    """(lots, interest per fund) by loops."""
    have, interest = defaultdict(deque), defaultdict(D)
    for fund, day, seq, units, value in start:
        have[fund].append([day, seq, units, value])
    for fund, day, seq, side, units, price, _ in sorted(moves, key=lambda m: (m[1], m[2])):
        if side == "S":
            have[fund].append([day, seq, units, price])
            continue
        gained = D(0)
        while units and have[fund]:
            lot = have[fund][0]
            take = min(units, lot[2])
            gained += take * (price - lot[3])
            lot[2] -= take
            units -= take
            if not lot[2]:
                have[fund].popleft()
        interest[fund] += gained.quantize(CENT, ROUND_HALF_UP)
    return sorted((f, *lot) for f, q in have.items() for lot in q), interest


def rows(state):
    return sorted((r["fund"], r["day"], r["seq"], r["units"], r["unit_value"]) for r in state.collect())


def test_two_halves_are_the_whole(spark, tmp_path):
    moves = moves_of(1, 300)
    start = [("a", funds.BEFORE_ALL, 0, D("120.5"), D("2.25")), ("c", funds.BEFORE_ALL, 0, D(7), D(1))]
    opening = spark.createDataFrame([(*x, funds.OPENING) for x in start], LOTS)
    df = spark.createDataFrame(moves, MOVES)
    exits, whole = funds.period(df, opening, ["fund"], *span(0, 299))
    _, half = funds.period(df, opening, ["fund"], *span(0, 150))
    funds.hand_on(half, str(tmp_path), "first")
    later, end = funds.period(df, funds.taken_over(spark, str(tmp_path), "first"), ["fund"], *span(151, 299))
    wanted, interest = queues(moves, start)
    assert rows(whole) == rows(end) == wanted
    assert {r["fund"]: r["i"] for r in exits.groupBy("fund").agg(F.sum("interest").alias("i")).collect()} == dict(interest)
    assert later.count() == sum(m[3] == "R" and m[1] > date(150) for m in moves)
    with pytest.raises(AnalysisException):
        funds.hand_on(half, str(tmp_path), "first")


def test_the_equation_closes(spark):
    moves = [("a", date(3), 1, "S", D(10), D(2), D(20)), ("a", date(5), 2, "R", D(4), D(3), D(12)), ("a", date(400), 3, "S", D(9), D(9), D(81))]
    opening = spark.createDataFrame([("a", funds.BEFORE_ALL, 0, D(5), D(1), funds.OPENING)], LOTS)
    df = spark.createDataFrame(moves, MOVES)
    exits, left = funds.period(df, opening, ["fund"], *span(0, 365))
    closings = spark.createDataFrame([("a", D(4), D("44.07")), ("b", D(1), None)], "fund string, value decimal(9,2), stated decimal(18,2)")
    out = {r["fund"]: r for r in funds.control(df, opening, exits, left, closings, ["fund"], *span(0, 365), "value", "stated").collect()}
    a = out["a"]
    # 1 of 5 opening units is left at 1.00, and 10 at 2.00: worth 44 at 4.00
    assert [a[c] for c in ("units", "opening", "subscriptions", "redemptions", "interest", "holding", "adjustment", "to_book", "valuation")] == [D(11), D(5), D(20), D(12), D(8), D(23), D("0.07"), D("23.07"), D("44.07")]
    assert a["opening"] + a["subscriptions"] + a["interest"] + a["to_book"] - a["redemptions"] == a["valuation"]
    assert [out["b"][c] for c in ("units", "opening", "valuation")] == [0, 0, 0]


def test_openings_from_a_return(spark):
    block = "Fondos comunes de Inversión\n{name}\nID Clase / Tipo Cantidad 25\nCantidad {units}\nImporte al 31/12/2022 $ 900,00\nImporte al 31/12/2023: \n$ {cost}\n"
    text = "Bienes\n" + block.format(name="Fima  Ahorro - 12", units="1.234,5", cost="2.469,00") + block.format(name="FIMA Premium", units="3", cost="500,00") + block.format(name="fima ahorro", units="100", cost="999,00") + block.format(name="Otro", units="100", cost="999,00")
    found = funds.declared_funds(spark.createDataFrame([(1, text), (2, "nada"), (3, None)], "id int, text string"))
    told = {r["id"]: [(f["name"], f["cost"], f["units"]) for f in r["funds"]] for r in found.collect()}
    assert told == {1: [("Fima Ahorro", D("2469.00"), D("1234.5")), ("FIMA Premium", D("500.00"), None)], 2: [], 3: []}
    seeded, review = funds.opening_lots(found.select(F.inline("funds")), ["name"], "units", "cost")
    assert [(r["name"], r["units"], r["unit_value"], r["day"]) for r in seeded.collect()] == [("Fima Ahorro", D("1234.5"), D(2), funds.BEFORE_ALL)]
    assert [r["name"] for r in review.collect()] == ["FIMA Premium"]


def test_nothing_at_all(spark):
    none, moves = spark.createDataFrame([], LOTS), spark.createDataFrame([], MOVES)
    exits, left = funds.period(moves, none, ["fund"], *span(0, 9))
    assert exits.count() == left.count() == 0
