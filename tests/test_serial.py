"""Row-by-row assignment against a plain loop."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from abacusflow.operators import serial


def loop(lefts, rights, soft=(), lone=None):
    """(left, right) pairs of one pass over the lefts."""
    used, out = set(), []
    for left, keys in sorted(lefts.items()):
        found = next((r for k in keys if k is not None for r in sorted(rights) if r not in used and k in rights[r]), None)
        for rule in soft:
            if found is None:
                found = next((r for r in sorted(rights) if r not in used and (left, r) in rule), None)
        if found is None and lone and lone[0].get(left) is not None:
            same = [r for r in rights if r not in used and lone[1].get(r) == lone[0][left]]
            found = same[0] if len(same) == 1 else None
        if found is not None:
            used.add(found)
            out.append((left, found))
    return sorted(out)


def worked_out(spark, lefts, rights, soft=(), lone=None, grain=serial.GRAIN):
    a = spark.createDataFrame([(k, v, lone and lone[0].get(k)) for k, v in lefts.items()], "a long, keys array<string>, one string")
    b = spark.createDataFrame([(k, v, lone and lone[1].get(k)) for k, v in rights.items()], "b long, keys array<string>, one string")
    rules = [lambda df, rule=rule: spark.createDataFrame(sorted(rule), "a long, b long").join(df.select("a"), "a", "left_semi") for rule in soft]
    out = serial.serial_match(a, b, "a", "b", F.col("keys"), F.col("keys"), rules, (F.col("one"), F.col("one")) if lone else None, grain)
    return sorted((r["a"], r["b"]) for r in out.collect())


def test_a_later_row_holds_a_better_key(spark):
    lefts = {1: ["late"], 2: ["best"], 3: ["best", "late"]}
    rights = {10: ["best", "late"], 11: ["late"]}
    assert worked_out(spark, lefts, rights) == loop(lefts, rights) == [(1, 10), (3, 11)]


@pytest.mark.parametrize(("cases", "grain"), [(((1, 60, 12), (2, 80, 4), (3, 50, 30)), 10**6), (((4, 60, 5), (5, 90, 2)), 9)])
def test_random_keys(spark, cases, grain):
    """Several instances side by side: their keys have nothing in common."""
    lefts, rights = {}, {}
    for seed, n, values in cases:
        r = random.Random(seed)
        some = lambda: [r.choice([None, *(f"{seed}{k}{r.randrange(values)}" for k in "xyz")]) for _ in range(r.randrange(4))]  # noqa: E731, B023
        lefts |= {k * 10 + seed: some() for k in range(n)}
        rights |= {k * 10 + seed: some() for k in range(n)}
    assert worked_out(spark, lefts, rights, grain=grain) == loop(lefts, rights)


@pytest.mark.parametrize(("seed", "grain"), [(6, serial.GRAIN), (8, 10)])
def test_random_soft_rules_and_lone_rights(spark, seed, grain):
    r = random.Random(seed)
    lefts = {k: [f"x{r.randrange(20)}"] * r.randrange(2) for k in range(40)}
    rights = {k: [f"x{r.randrange(20)}"] * r.randrange(2) for k in range(40)}
    soft = [{(r.randrange(40), r.randrange(40)) for _ in range(25)} for _ in range(2)]
    lone = ({k: r.choice([None, *"abcdefgh"]) for k in lefts}, {k: r.choice([None, *"abcdefgh"]) for k in rights})
    assert worked_out(spark, lefts, rights, soft, lone, grain=grain) == loop(lefts, rights, soft, lone)


def test_all_alike_takes_few_rounds(spark, monkeypatch):
    rounds = []
    old = serial._State._round
    monkeypatch.setattr(serial._State, "_round", lambda self, n: (rounds.append(n), old(self, n)))
    lefts, rights = {k: ["same", "other"] for k in range(2000)}, {k: ["same"] for k in range(1500)}
    assert worked_out(spark, lefts, rights) == [(k, k) for k in range(1500)]
    assert len(rounds) <= 3


def day(k):
    return datetime.date(2024, 3, k)


INVOICE = "id long, code string, issuer long, kind string, number string, day date, total decimal(18,2), ours boolean"


def test_crossing_of_invoices(spark):
    rows = [
        (1, "12345678901234", 20, "A", "1-1", day(1), Decimal("100.00"), True),  # by code
        (2, None, 20, "A", "1-2", day(2), Decimal("200.03"), True),  # by kind and number, three cents off
        (3, "", 20, None, "1-3", day(3), Decimal("300.00"), True),  # by number, total differs
        (4, None, 20, "B", "9-9", day(4), Decimal("401.00"), True),  # soft: same day, within 2 %
        (5, None, 20, "B", "9-8", day(9), Decimal("500.04"), True),  # soft: same issuer, within cents
        (6, None, 20, "B", "9-7", day(6), Decimal("1.00"), True),  # the only one of that day
        (7, None, 21, "B", "9-6", day(6), Decimal("1.00"), True),  # two of that day
        (8, None, 20, "A", "1-1", day(1), Decimal("100.00"), False),  # made out to somebody else
        (9, None, 20, "A", "1-10", day(10), None, True),  # no total: the listing's
    ]
    listed = [
        (11, "12345678901234", 20, "A", "1-1", day(1), Decimal("100.00"), None),
        (12, None, 20, "A", "1-2", day(2), Decimal("200.00"), None),
        (13, None, 20, "C", "1-3", day(3), Decimal("310.00"), None),
        (14, None, 20, "B", "4-4", day(4), Decimal("405.00"), None),
        (15, None, 20, "B", "5-5", day(5), Decimal("500.00"), None),
        (16, None, 20, "B", "6-6", day(6), Decimal("600.00"), None),
        (17, None, 21, "B", "7-7", day(6), Decimal("700.00"), None),
        (18, None, 21, "B", "7-8", day(6), Decimal("800.00"), None),
        (19, None, 20, "A", "1-10", day(10), Decimal("900.00"), None),
    ]
    left = spark.createDataFrame(rows, INVOICE).withColumnRenamed("id", "invoice")
    right = spark.createDataFrame(listed, INVOICE).withColumnRenamed("id", "row")
    out = {(r["invoice"], r["row"]): (r["state"], (r["key"] or "").split(":")[0], r["difference"]) for r in serial.crossed(left, right, "invoice", "row", F.col("ours")).collect()}
    assert out == {
        (1, 11): ("OK", "code", Decimal("0.00")),
        (2, 12): ("OK", "issuer+kind+number", Decimal("0.03")),
        (3, 13): ("DIFERENCIA", "issuer+number", Decimal("-10.00")),
        (4, 14): ("DIFERENCIA", "soft0", Decimal("-4.00")),
        (5, 15): ("OK", "soft1", Decimal("0.04")),
        (6, 16): ("DIFERENCIA", "lone", Decimal("-599.00")),
        (9, 19): ("OK", "issuer+kind+number", Decimal("0.00")),
        (7, None): ("REVISAR", "", None),
        (8, None): ("REVISAR", "", None),
        (None, 17): ("FALTA", "", None),
        (None, 18): ("FALTA", "", None),
    }


def test_empty_sides(spark):
    left = spark.createDataFrame([], INVOICE).withColumnRenamed("id", "invoice")
    right = spark.createDataFrame([], INVOICE).withColumnRenamed("id", "row")
    assert serial.crossed(left, right, "invoice", "row").count() == 0


def test_issuers_by_themselves_as_in_rounds(spark, monkeypatch):
    """Equal whichever way issuers go; those whose codes and numbers nobody else has take no round."""
    r = random.Random(5)

    def invoice(k, issuer, shared):
        own = "" if shared else issuer
        number = r.choice([None, "", f"{own}-{r.randrange(3)}", f"{own}|{r.randrange(2)}"])
        total = r.choice([None, Decimal(0), Decimal(r.randrange(1, 8)), Decimal("100.00") + Decimal(r.randrange(12)) / 100, Decimal("-100.03")])
        return (k, r.choice([None, f"{own}0123456789{r.randrange(2)}", f"{own}7"]), issuer, r.choice([None, "A", "1|A"]), number, r.choice([None, day(1), day(2)]), total, r.random() > 0.1)

    rows = lambda: [invoice(k, r.choice([None, "i1", "i1|1"]), True) if k % 3 == 0 else invoice(k, f"j{r.randrange(9)}", False) for k in range(120)]
    kind = INVOICE.replace("issuer long", "issuer string")
    left, right = spark.createDataFrame(rows(), kind).withColumnRenamed("id", "a"), spark.createDataFrame(rows(), kind).withColumnRenamed("id", "b")
    crossed = lambda a, b, **more: sorted(map(str, serial.crossed(a, b, "a", "b", F.col("ours"), **more).collect()))
    rounds = []
    old = serial._State._round
    monkeypatch.setattr(serial._State, "_round", lambda self, n: (rounds.append(n), old(self, n)))
    both = crossed(left, right)
    assert both == crossed(left, right, most=0) and rounds
    assert {x.split("key='")[1].split("'")[0].split(":")[0] for x in both if "key='" in x} >= {"soft0", "soft1", "code", "number", "issuer+day+total"}
    rounds.clear()
    apart = F.col("issuer").startswith("j")
    found = crossed(left.where(apart), right.where(apart))
    assert not rounds and found == crossed(left.where(apart), right.where(apart), most=0) and rounds
