import random
from datetime import date, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from abacusflow.operators import fiscal, figures, lots, obligations, readings

OWED = "obligation long, party string, bundle string, day date, total decimal(18,2), base decimal(18,2)"
DEBITS = "debit long, party string, paid_day date, paid decimal(18,2), text string"


def test_bundles_come_first_then_totals_bases_and_the_only_candidate(spark):
    d = date(2024, 3, 10)
    owed = [
        (1, "a", "x", d, D(100), None), (2, "a", "x", d, D(50), None),  # one debit of 150
        (3, "a", None, d, D(150), None),  # would fit it too, but the bundle comes first
        (4, "b", None, d, D("80.5"), None), (5, "b", None, d, D(200), D(180)),
        (6, "c", None, d, D(70), None), (7, "c", None, date(2024, 6, 1), D(70), None),
        (8, "d", None, d, D(40), None), (9, "e", None, d, D(10), None),
    ]
    debits = [(10, "a", d, D(150), "x"), (40, "b", d, D(80), "plain"), (41, "b", d + timedelta(5), D(80), "SINDICATO"), (50, "b", d, D(180), "x"), (60, "c", date(2023, 1, 1), D(70), "pago SINDICATO"), (80, "d", d + timedelta(90), D(40), "otro")]
    found = {r["obligation"]: (r["debit"], r["state"], r["stage"]) for r in obligations.settled(spark.createDataFrame(owed, OWED), spark.createDataFrame(debits, DEBITS), ("SINDICATO",)).collect()}
    assert found[1] == found[2] == (10, "PAGADO", "bundle")
    assert found[3] == (0, "FALTA", "")
    assert found[4] == (41, "PAGADO", "single")  # the keyword counts more than the day
    assert found[5] == (50, "PARCIAL", "single")
    assert found[6] == (60, "PAGADO", "only") and found[7] == (0, "SIN EXTRACTO", "")
    assert found[8] == (0, "SIN EXTRACTO", "") and found[9] == (0, "SIN EXTRACTO", "")


def test_scored_assignment_equals_a_greedy_pass(spark):
    r = random.Random(2)
    day = lambda: date(2024, 1, 1) + timedelta(r.randint(0, 120))
    invoices = [(k, r.choice("ab"), day(), D(r.randint(100, 9000)), D(r.randint(10, 900))) for k in range(40)]
    held = [(100 + k, r.choice("ab"), day(), D(r.randint(1, 90)), D(r.randint(1, 700)), D(r.randint(2, 180))) for k in range(30)]
    found = obligations.scored_assignment(spark.createDataFrame(held, "withholding long, party string, held_day date, ss decimal(18,2), iva decimal(18,2), gan decimal(18,2)"), spark.createDataFrame(invoices, "invoice long, party string, day date, net decimal(18,2), vat decimal(18,2)"))
    pairs = sorted((abs(s - n * D("0.01")) + abs(i - v * D("0.8")) + abs(g - n * D("0.02")) + 10 * (b - a).days, w, k) for w, p, b, s, i, g in held for k, q, a, n, v in invoices if p == q and 0 <= (b - a).days <= 45)
    wanted, used = set(), set()
    for s, w, k in pairs:
        if w not in used and -k - 1 not in used:
            used |= {w, -k - 1}
            wanted.add((w, k, s))
    assert {(x["withholding"], x["invoice"], x["score"]) for x in found.collect()} == wanted


def test_passes_by_name_amount_late_and_sums(spark):
    d = date(2024, 5, 6)
    debits = [(1, d, D(100), "ACME"), (2, d, D(200), "?"), (3, d + timedelta(10), D(300), "?"), (4, d + timedelta(80), D(400), "NORTE"), (5, d, D(750), "?"), (6, d, D(45), "?"), (7, d, D(46), "?"), (8, d, D(9999), "?")]
    invoices = [(11, d, D(100), "ACME"), (12, d, D(100), "OTHER"), (13, d + timedelta(2), D("200.5"), "X"), (14, d, D(300), "Y"), (15, d, D(400), "NORTE"), (16, d, D(500), "Z"), (17, d, D(250), "Z"), (18, d, D(91), "W")]
    score = F.when(F.col("text") == F.col("name"), 100.0).otherwise(0.0)
    found = obligations.matched_by_passes(spark.createDataFrame(debits, "debit long, paid_day date, paid decimal(18,2), text string"), spark.createDataFrame(invoices, "invoice long, day date, amount decimal(18,2), name string"), score)
    assert sorted((r["debit"], r["invoice"], r["stage"]) for r in found.collect()) == [(1, 11, "name"), (2, 13, "amount"), (3, 14, "unique"), (4, 15, "late"), (5, 16, "two_invoices"), (5, 17, "two_invoices"), (6, 18, "two_debits"), (7, 18, "two_debits")]


def test_installments_and_their_debits(spark):
    due = spark.createDataFrame([("s", 1, D(100000), date(2025, 3, 5)), ("s", 2, D(100000), date(2025, 4, 5)), ("s", 3, D(5), date(2025, 5, 5))], "loan string, installment long, due decimal(18,2), due_date date")
    paid = spark.createDataFrame([("s", 11, D(100000), date(2025, 3, 4)), ("s", 12, D(100000), date(2025, 4, 6))], "loan string, debit long, paid decimal(18,2), paid_day date")
    found = {r["installment"]: (r["debit"], r["matched"]) for r in fiscal.installments_paid(due, paid, ["loan"]).collect()}
    assert found == {1: (11, True), 2: (12, True), 3: (None, False)}


def test_lot_results_equal_a_queue(spark):
    r = random.Random(7)
    rows = []
    for k in range(120):
        entry = r.random() < 0.55
        n, unit = r.randint(1, 30), r.randint(1, 9)
        rows.append(("a" if k % 3 else "b", date(2024, 1 + k // 20, 1), k, D(n) if entry else D(0), D(0) if entry else D(n), D(unit), D(unit + 1), D(0) if entry else D(n * (unit + 1))))
    frame = spark.createDataFrame(rows, "account string, month date, k long, entry decimal(28,6), exit decimal(28,6), cost decimal(9,0), price decimal(9,0), amount decimal(18,2)")
    queues, results, slices = {}, {}, {}
    for account, _, k, entry, leave, cost, price, amount in rows:
        queue = queues.setdefault(account, [])
        if entry:
            queue.append([k, entry, cost])
            continue
        rest, spent, covered = leave, D(0), D(0)
        while rest and queue:
            take = min(rest, queue[0][1])
            slices[queue[0][0], k] = (take, take * (price - queue[0][2]))
            spent, covered, rest = spent + take * queue[0][2], covered + take, rest - take
            queue[0][1] -= take
            if not queue[0][1]:
                queue.pop(0)
        applied = amount if covered == leave else (amount * covered / leave).quantize(D("0.01"), "ROUND_HALF_UP")
        results[k] = (covered, spent, applied - spent if covered else D(0), "SALIDA" if covered == leave else "SIN_STOCK")
    args = frame, ["account"], "month", ["k"]
    assert {r["k"]: (r["covered"], r["cost"], r["result"], r["state"]) for r in lots.exit_results(*args, "cost", "price", "amount").collect()} == results
    found = lots.slices(*args, "cost", "price", "amount").collect()
    assert {(r["lot"]["k"], r["exit_row"]["k"]): (r["quantity"], r["interest"]) for r in found} == slices
    for k, (covered, *_) in results.items():
        if covered:  # slices add up to the exit's own amount
            assert sum(r["amount"] for r in found if r["exit_row"]["k"] == k) == rows[k][7]
    left = {r["k"]: r["left"] for r in lots.open_lots(*args).collect()}
    assert left == {k: n for q in queues.values() for k, n, _ in q}


def test_a_date_in_a_line(spark):
    lines = {"x 2024-02-30 y": None, "on 2024 05-06": date(2024, 5, 6), "07/08/2023 2024-01-01": date(2024, 1, 1), "07/08/2023": date(2023, 8, 7), "ref 20240506 ok": date(2024, 5, 6), "1999-01-01": None, "120240506": None, "2024-13-01 01/02/2022": date(2022, 2, 1)}
    found = spark.createDataFrame([(x,) for x in lines], "x string").select("x", readings.date_in_line(F.col("x")).alias("d")).collect()
    assert {r["x"]: r["d"] for r in found} == lines


def test_sheets_of_a_report_that_failed(spark):
    errors = spark.createDataFrame([("a.pdf", None), ("b.pdf", "no table")], "file string, reason string")
    sheets = figures.fallback_sheets(errors, errors, errors)
    assert list(sheets) == ["ERRORES", "MOVIMIENTOS", "CONTROL"] and sorted(r["detalle"] for r in sheets["ERRORES"].collect()) == ["no table", "sin detalle"]
