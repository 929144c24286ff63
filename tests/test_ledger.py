import random
from datetime import date, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from abacusflow.operators import ledger, running
from abacusflow.operators.asof import asof

SCHEMA = "acc string, month date, ord int, amount decimal(18,2), balance decimal(18,2)"


def data(seed, n=200):
    r = random.Random(seed)
    rows, balance = [], {}
    for k in range(n):
        acc = r.choice("aab")
        amount = D(r.randint(-500, 500)) / 100
        balance[acc] = balance.get(acc, D(0)) + amount
        told = amount if r.random() < 0.7 else r.choice([None, -amount, amount + 3])
        rows.append((acc, date(2024, 1 + k * 12 // n, 1), k, told, balance[acc] if r.random() < 0.8 else None))
    return rows


def repaired(rows):
    before, out = {}, {}
    for acc, _, k, amount, balance in rows:
        if balance is None:
            out[k] = amount
            continue
        if acc not in before:
            out[k] = amount or D(0)
        else:
            change = balance - before[acc]
            out[k] = D(0) if abs(change) < D("0.005") else change if amount is None or abs(amount - change) > D("0.05") else amount
        before[acc] = balance
    return out


def test_chain_repair_equals_a_loop(spark):
    for seed in range(3):
        rows = data(seed)
        found = ledger.repair_chain(spark.createDataFrame(rows, SCHEMA), ["acc"], "month", ["ord"], "amount", "balance")
        assert {r["ord"]: r["repaired"] for r in found.collect()} == repaired(rows)


def test_signs_read_wrongly(spark):
    rows = [("a", date(2024, 1, 1), k, D(x), D(b)) for k, (x, b) in enumerate([("0", "1000"), ("-100", "1100"), ("40", "1060")])]
    found = ledger.repair_chain(spark.createDataFrame(rows, SCHEMA), ["acc"], "month", ["ord"], "amount", "balance").orderBy("ord").collect()
    assert [r["repaired"] for r in found] == [D(0), D(100), D(-40)]


def test_control_and_continuity(spark):
    rows = [("a", date(2024, 1, 1), 1, D(10), D(110)), ("a", date(2024, 1, 1), 2, D(-30), D(80)), ("a", date(2024, 2, 1), 3, D(5), D(90)), ("a", date(2024, 4, 1), 4, D(1), None)]
    control = ledger.monthly_control(spark.createDataFrame(rows, SCHEMA), ["acc"], "month", ["ord"], "amount", "balance")
    found = {r["month"].month: r for r in control.collect()}
    assert (found[1]["opening"], found[1]["closing"], found[1]["state"]) == (D(100), D(80), "OK")
    assert found[4]["state"] == "ERROR" and found[4]["closing"] is None
    near = {r["month"].month: (r["gap"], r["state"]) for r in ledger.continuity(control, ["acc"], "month").collect()}
    assert near == {1: (None, "OK"), 2: (D(5), "ERROR"), 4: (None, "ERROR")}
    again = {r["month"].month: (r["opening"], r["state"]) for r in ledger.reinforce(control, ["acc"], "month").collect()}
    assert again[2] == (D(80), "ERROR")
    assert [(r["after_month"].month, r["before_month"].month) for r in ledger.bridges(control, ["acc"], "month").collect()] == [(2, 4)]


def test_validation_reports_the_first_failure(spark):
    rows = [("a", date(2024, 1, 1), 1, D(0), D(10)), ("a", date(2024, 1, 1), 2, D(5), D(15)), ("a", date(2024, 2, 1), 3, D(5), D(21)), ("a", date(2024, 2, 1), 4, D(1), D(30))]
    found = ledger.validate(spark.createDataFrame(rows, SCHEMA), ["acc"], "month", ["ord"], "amount", "balance").first()
    assert (found["n_rows"], found["n_bad"], found["first_bad"]["ord"]) == (4, 2, 3)


def test_repeats_are_compared_to_the_kept_row(spark):
    rows = [(1, k, c, D(x)) for k, (c, x) in enumerate([("a", "1.00"), ("a", "1.01"), ("a", "1.02"), ("b", "1.02"), ("b", "1.02")])]
    found = ledger.collapse_repeats(spark.createDataFrame(rows, "d int, o int, c string, x decimal(18,2)"), ["d"], ["o"], "c", "x").first()["kept"]
    assert [(r["concept"], r["amount"]) for r in found] == [("a", D("1.00")), ("a", D("1.02")), ("b", D("1.02"))]


def test_running_values_over_cells(spark):
    rows = data(9)
    df = spark.createDataFrame([(a if a == "a" else None, m, k, x or D(0)) for a, m, k, x, _ in rows], "acc string, month date, ord int, amount decimal(18,2)")
    found = running.running(df, ["acc"], "month", ["ord"], {"s": ("sum", F.col("amount")), "m": ("max", F.col("amount"))}).collect()
    total, most = {}, {}
    wanted = {}
    for acc, _, k, x, _ in rows:
        total[acc] = total.get(acc, D(0)) + (x or D(0))
        most[acc] = max(most.get(acc, D(-999)), x or D(0))
        wanted[k] = (total[acc], most[acc])
    assert {r["ord"]: (r["s"], r["m"]) for r in found} == wanted


def test_asof(spark):
    start = date(2024, 1, 10)
    quotes = [(start + timedelta(days=d), float(d)) for d in (0, 3, 40, 41, 200)]
    probes = [(k, start + timedelta(days=d)) for k, d in enumerate((-5, 0, 2, 3, 39, 40, 100, 199, 200, 500))]
    found = asof(spark.createDataFrame(probes, "k int, d date"), spark.createDataFrame(quotes, "q date, r double"), "d", "q", "r").collect()
    wanted = {k: max((q for q in quotes if q[0] <= d), default=quotes[0])[1] for k, d in probes}
    assert {r["k"]: r["value"] for r in found} == wanted
