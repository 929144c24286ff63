import random
from collections import defaultdict, deque
from datetime import date
from decimal import ROUND_HALF_UP
from decimal import Decimal as D

from pyspark.sql import functions as F

from abacusflow.operators import currency, loans, lots

SCHEMA = "k string, month date, ord int, entry decimal(28,6), exit decimal(28,6), cost decimal(9,2)"


def events(seed, n=150):
    r = random.Random(seed)
    out = []
    for j in range(n):
        units = D(r.randint(1, 500)) / 100
        entry = r.random() < 0.5
        out.append((r.choice("xxy"), date(2024, 1 + 12 * j // n, 1), j, units if entry else D(0), D(0) if entry else units, D(r.randint(1, 9))))
    return out


def queue(rows):
    open_, taken = defaultdict(deque), []
    for k, _, j, entry, leave, cost in rows:
        if entry:
            open_[k].append([j, entry, cost])
        while leave > 0 and open_[k]:
            lot = open_[k][0]
            q = min(lot[1], leave)
            taken.append((k, lot[0], j, q))
            lot[1] -= q
            leave -= q
            if not lot[1]:
                open_[k].popleft()
    return taken, {k: (sum(x[1] for x in v), sum(x[1] * x[2] for x in v), len(v)) for k, v in open_.items()}


def test_intervals_equal_a_queue(spark):
    for seed in range(4):
        rows = events(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        taken, left = queue(rows)
        found = lots.applications(df, ["k"], "month", ["ord"], per_range=3).collect()
        assert sorted((r["k"], r["lot"]["ord"], r["exit_row"]["ord"], r["quantity"]) for r in found) == sorted(taken)
        for r in lots.positions(df, ["k"], "month", ["ord"], "cost").collect():
            units, cost, n = left[r["k"]]
            assert (r["units"], r["open_lots"]) == (units, n) and abs(r["cost"] - cost) <= D("0.005")


def test_average_cost_equals_a_loop(spark):
    r = random.Random(2)
    rows = [(k, j, D(r.randint(0, 999)) / 100, D(r.randint(800, 1200)), r.random() < 0.6) for k in "ab" for j in range(60)]
    found = currency.average_cost(spark.createDataFrame(rows, "k string, j int, m decimal(18,2), t decimal(18,6), i boolean"), ["k"], ["j"], "m", "t", "i").collect()
    got = {(x["k"], x["j"]): (x["units"], x["rate"], x["result"]) for x in found}
    round_ = lambda x, n: x.quantize(D(1).scaleb(-n), ROUND_HALF_UP)
    units, rate = defaultdict(D), defaultdict(D)
    for k, j, m, t, entry in rows:
        if m <= 0:
            assert (k, j) not in got
            continue
        result = D(0)
        if entry:
            rate[k] = round_((units[k] * rate[k] + m * t) / (units[k] + m), 10) if units[k] > 0 and rate[k] > 0 else t
            units[k] += m
        else:
            result = round_(m * (t - rate[k]), 2)
            units[k] -= m
        assert got[k, j][0] == units[k] and abs(got[k, j][1] - rate[k]) <= D("0.000001") and got[k, j][2] == result


def test_average_cost_is_carried_over_cells(spark):
    r = random.Random(3)
    rows = [(k, j // 13, j, D(r.randint(1, 999)) / 100, D(r.randint(800, 1200)) + D(r.randint(0, 999999)) / 10**6, r.random() < 0.6) for k, n in (("a", 90), ("b", 8), ("c", 40)) for j in range(n) if not (k == "a" and j // 13 == 2)] + [("c", 6, 80, D(1), D(900), False)]
    df = spark.createDataFrame(rows, "k string, c int, j int, m decimal(18,2), t decimal(18,6), i boolean").repartition(3)
    round_ = lambda x, n: x.quantize(D(1).scaleb(-n), ROUND_HALF_UP)
    units, rate, wanted = defaultdict(D), defaultdict(D), {}
    for k, _, j, m, t, entry in rows:
        if entry:
            rate[k] = round_((units[k] * rate[k] + m * t) / (units[k] + m), 10) if units[k] > 0 and rate[k] > 0 else t
        units[k] += m if entry else -m
        wanted[k, j] = units[k], round_(rate[k], 6), D(0) if entry else round_(m * (t - rate[k]), 2)
    for cell, grain in ((None, 1), ("c", 1), ("c", 20), ("c", 1000)):
        found = currency.average_cost(df, ["k"], ["j"], "m", "t", "i", cell, grain).collect()
        assert len(found) == len(wanted) and {(x["k"], x["j"]): (x["units"], x["rate"], x["result"]) for x in found} == wanted


def test_average_cost_never_gathers_a_key(spark):
    df = spark.range(100_000).selectExpr("1 as k", "id as j", "1.00 as m", "10.000000 as t", "id % 3 < 2 as i")
    out = currency.average_cost(df, ["k"], ["j"], "m", "t", "i")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert tuple(out.agg(F.count("*"), F.max_by("units", "j"), F.max("rate"), F.sum("result")).first()) == (100_000, D("33334.00"), D(10), D(0))


def test_french_loan_by_hand(spark):
    row = spark.createDataFrame([(1, D("100000.00"), 12, 0.60, date(2024, 1, 31)), (2, D("1000.00"), 3, 0.0, date(2024, 1, 1)), (3, D("5.00"), 0, 0.1, date(2024, 1, 1))], "k int, c decimal(18,2), n int, r double, s date")
    found = loans.french(row, ["k"], "c", "n", "r", "s").orderBy("k", "n").collect()
    rate = D("0.05")
    payment = D(100000) * rate / (1 - (1 + rate) ** -12)
    balance = D("100000.00")
    cents = D("0.01")
    for i in range(12):
        interest = (balance * rate).quantize(cents, ROUND_HALF_UP)
        capital = balance if i == 11 else (payment - interest).quantize(cents, ROUND_HALF_UP)
        vat = (interest * D("0.21")).quantize(cents, ROUND_HALF_UP)
        balance -= capital
        assert tuple(found[i])[1:7] == (i + 1, interest, capital, vat, interest + capital + vat, balance)
    assert found[1]["due_date"] == date(2024, 2, 29)
    assert [r["capital"] for r in found if r["k"] == 2] == [D("333.33"), D("333.33"), D("333.34")]
    assert not [r for r in found if r["k"] == 3]


def test_german_loan_adds_up(spark):
    row = spark.createDataFrame([(1, D("1000.00"), 7, 0.12, date(2024, 1, 1))], "k int, c decimal(18,2), n int, r double, s date")
    found = loans.german(row, ["k"], "c", "n", "r", "s")
    assert found.agg(F.sum("capital")).first()[0] == D("1000.00") and found.agg(F.min("balance")).first()[0] == D(0)
