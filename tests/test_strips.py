"""Passes over pairs that meet by amount, settled strip by strip, against plain loops."""

import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from abacusflow.functions.similarity import token_set, token_set_ratio
from abacusflow.operators import matching, obligations, strips
from abacusflow.plans import registry

FOLDER = "/root/testdata/sf0.001"
SIDE = "id long, amount decimal(18,2), day date, name string"
NAMES = ["ACME", "ACME SUR", "NORTE SUR", "NORT SA", "ACMES", "CUSTOMER#0001", "CUSTOMER#0002", "CUSTOMER#0013", "", "SUR"]
DAY = date(2024, 3, 1)


def sides(seed):
    """Few amounts, days and names, so that rows compete in long chains; some amounts and days are missing."""
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.05 else DAY + timedelta(r.randrange(6))
    amount = lambda: None if r.random() < 0.02 else D(r.randrange(4000 if r.random() < 0.9 else 20)) / 100
    return [[(first + k, amount(), day(), r.choice(NAMES)) for k in range(150)] + [(None, D(k), DAY, "ACME") for k in range(20)] for first in (0, 1000)]


def greedy(pairs):
    taken, used = {}, set()
    for *_, a, b, tag in sorted(pairs):
        if a not in taken and b not in used:
            taken[a] = (b, tag)
            used.add(b)
    return taken


def ordered(rule, left, right):
    """The pairs within 0.10, each with its place in the order of the rule, and its tag."""
    for a, x, d, n in left:
        for b, y, e, m in right:
            if None in (a, b, x, y) or abs(x - y) > D("0.1"):
                continue
            score, off = token_set(n, m), -1 if d is None or e is None else abs(d - e).days
            if rule == "by_day" and score >= 55 and (off < 0 or e <= d + timedelta(2)):
                yield d or date.min, a, -score, a, b, score
            if rule == "any_day" and score >= 62:
                yield -score, off, a, b, 0.0
            if rule == "near_days" and 0 <= off <= 3:
                yield 1, off, 0, a, b, 1.0
                if score >= 62:
                    yield 0, off, -score, a, b, 0.0


@pytest.mark.parametrize("rule", ["by_day", "near_days", "any_day"])
def test_strips_equal_a_pass_over_all_pairs(spark, rule):
    made = {"by_day": lambda: strips.by_day(55.0, 2), "near_days": lambda: strips.near_days(62.0, 3), "any_day": lambda: strips.any_day(62.0)}[rule]()
    left, right = sides(3)
    wanted = greedy(ordered(rule, left, right))
    for grain in (12, 10_000):  # strips much narrower than the chains, and one strip
        found = strips.settled(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE), 0.1, made, grain)
        assert {r["l"]: (r["r"], r["tag"]) for r in found.collect()} == wanted


def test_copies_make_no_pairs(spark):
    """20,000 copies on either side would be 400 million pairs."""
    copies = lambda first: spark.range(first, first + 20_000).select("id", F.lit("5.00").cast("decimal(18,2)").alias("amount"), F.lit(DAY).alias("day"), F.lit("ACME").alias("name"))
    for rule in (strips.near_days(62.0, 3), strips.any_day(62.0), strips.by_day(55.0, 2)):
        found = strips.settled(copies(0), copies(100_000), 1.0, rule, 1000)
        assert found.count() == 20_000 and found.where("r <> l + 100000").isEmpty()


def test_passes_by_names_equal_those_by_scores(spark):
    left, right = (spark.createDataFrame(x, SIDE) for x in sides(8))
    debits = left.select(F.col("id").alias("debit"), F.col("day").alias("paid_day"), F.col("amount").alias("paid"), F.col("name").alias("text"))
    invoices = right.select(F.col("id").alias("invoice"), "day", "amount", "name")
    told = [obligations.matched_by_passes(debits, invoices, score, 0.03).collect() for score in (token_set_ratio(F.col("text"), F.col("name")), (F.col("text"), F.col("name")))]
    assert sorted(map(tuple, told[0])) == sorted(map(tuple, told[1]))
    assert {r["stage"] for r in told[1]} >= {"name", "amount", "unique", "late"}


def test_the_only_candidates(spark):
    rows = [(1, 500), (2, 600), (3, 600), (4, 700), (5, 800)]
    debits = spark.createDataFrame([(k, D(x) / 100, DAY) for k, x in rows], "debit long, paid decimal(18,2), paid_day date")
    owed = [(11, 501, 15), (12, 600, 0), (13, 700, 0), (14, 701, 1), (15, 800, 16)]  # 12 is wanted by two, 4 has two, 15 is too late
    invoices = spark.createDataFrame([(k, D(x) / 100, DAY + timedelta(n)) for k, x, n in owed], "invoice long, amount decimal(18,2), day date")
    assert [tuple(r) for r in obligations._only_candidates(debits, invoices, 0.05, 15).collect()] == [(1, 11)]


@pytest.mark.parametrize("name", ["debit_passes", "invoice_match_one_to_one"])
def test_names_are_settled_without_pairs_of_rows(spark, monkeypatch, name):
    def no_rounds(*_):
        raise AssertionError("rounds over all pairs")

    for module in (matching, obligations):
        monkeypatch.setattr(module, "one_to_one", no_rounds)
    assert registry.queries()[name](spark, FOLDER).count() > 900
