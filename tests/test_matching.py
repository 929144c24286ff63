import itertools
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from abacusflow.operators import dedup, matching, proration, reports, rules


def test_rounds_equal_a_greedy_pass(spark):
    for seed in range(3):
        r = random.Random(seed)
        pairs = [(a, b, r.randint(0, 4)) for a in range(25) for b in range(25) if r.random() < 0.3]
        found = matching.one_to_one(spark.createDataFrame(pairs, "a int, b int, s int"), "a", "b", [F.col("s")]).collect()
        used_a, used_b, wanted = set(), set(), set()
        for s, a, b in sorted((s, a, b) for a, b, s in pairs):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                wanted.add((a, b))
        assert {(x["a"], x["b"]) for x in found} == wanted


def test_ties_are_taken_in_few_rounds(spark, monkeypatch):
    """Equal rows on both sides, some of them with something better elsewhere: few rounds, and what a greedy pass takes."""
    rounds = []
    monkeypatch.setattr(matching, "stored", lambda df, real=matching.stored: rounds.append(1) or real(df))
    left, right = spark.range(300).select(F.col("id").alias("a")), spark.range(1000, 1280).select(F.col("id").alias("b"))
    found = matching.one_to_one(left.crossJoin(right).withColumn("s", F.lit(1)), "a", "b", [F.col("s")])
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [(k, 1000 + k) for k in range(280)]
    assert len(rounds) <= 12
    for seed in range(3):
        r = random.Random(seed)
        kinds = [(a, b, 0 if r.random() < 0.02 else 1) for a in range(24) for b in range(24) if a % 3 == b % 3 or r.random() < 0.03]
        found = matching.one_to_one(spark.createDataFrame(kinds, "a int, b int, s int"), "a", "b", [F.col("s")]).collect()
        used_a, used_b, wanted = set(), set(), set()
        for _, a, b in sorted((s, a, b) for a, b, s in kinds):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                wanted.add((a, b))
        assert {(x["a"], x["b"]) for x in found} == wanted


def test_cascade_of_thousands_of_equal_keys(spark):
    rows = spark.range(5000).select((F.col("id") * 7 % 5000).alias("id"), F.lit("k").alias("k"))
    cut = matching.ranked(rows, ["k"], "id", "n", grain=10, cells=7).collect()
    assert all(r["n"] == r["id"] + 1 for r in cut)
    left, right = spark.range(5000).select(F.col("id").alias("a"), F.lit("k").alias("k")), spark.range(5000).select((F.col("id") * 3).alias("b"), F.lit("k").alias("k"))
    found = matching.cascade(left, right, "a", "b", [[F.col("k")]], [[F.col("k")]])
    assert found.count() == 5000 and found.where("b <> 3 * a").count() == 0


def test_amount_band_finds_all(spark):
    r = random.Random(1)
    left = [(k, D(r.randint(0, 3000)) / 100) for k in range(120)]
    right = [(k, D(r.randint(0, 3000)) / 100) for k in range(120)]
    for tolerance in (0.0, 0.05, 1.0):
        found = matching.amount_band(spark.createDataFrame(left, "a int, x decimal(18,2)"), spark.createDataFrame(right, "b int, y decimal(18,2)"), "x", "y", tolerance).collect()
        assert sorted((q["a"], q["b"]) for q in found) == sorted((a, b) for (a, x), (b, y) in itertools.product(left, right) if abs(x - y) <= D(str(tolerance)))


def test_cascade_prefers_the_first_key(spark):
    left = spark.createDataFrame([(1, "k1", "m1"), (2, None, "m1"), (3, "k9", "m3")], "a int, k string, m string")
    right = spark.createDataFrame([(10, "k1", "m1"), (11, "k2", "m1"), (12, "k3", None)], "b int, k string, m string")
    found = matching.cascade(left, right, "a", "b", [[F.col("k")], [F.col("m")]], [[F.col("k")], [F.col("m")]]).collect()
    assert sorted((r["a"], r["b"], r["level"]) for r in found) == [(1, 10, 0), (2, 11, 1)]


def test_subset_sums_equal_brute_force(spark):
    r = random.Random(4)
    items = [("g", k, D(r.randint(1, 4000)) / 100) for k in range(14)]
    goals = [("g", t, D(r.randint(500, 9000)) / 100) for t in range(12)]
    found = matching.subset_sums(spark.createDataFrame(items, "g string, i int, x decimal(18,2)"), spark.createDataFrame(goals, "g string, t int, y decimal(18,2)"), ["g"], "i", "x", "t", "y", 0.5).collect()
    wanted = {}
    for _, t, goal in goals:
        best = min(((abs(goal - sum(x[2] for x in c)), n, [x[1] for x in c]) for n in (1, 2, 3) for c in itertools.combinations(items, n)), default=None)
        if best and best[0] <= D("0.5"):
            wanted[t] = (best[0], best[2])
    assert {q["target"]: (q["off"], q["members"]) for q in found} == wanted


def test_subset_sums_with_credit_notes_and_four(spark):
    r = random.Random(6)
    items = [(g, k, D(r.randint(-2000, 4000)) / 100) for g in "gh" for k in range(13)] + [("i", 1, D(10)), ("i", 2, D(-3)), ("j", 1, D(-3)), ("j", 2, D(-2)), ("j", 3, D(4))]
    goals = [(g, t, D(r.randint(-3000, 9000)) / 100) for g in "gh" for t in range(8)] + [("i", 8, D(7)), ("j", 9, D(-1)), ("k", 10, D(1))]
    frames = spark.createDataFrame(items, "g string, i int, x decimal(18,2)"), spark.createDataFrame(goals, "g string, t int, y decimal(18,2)")
    for most, grain in ((1, 256), (2, 4), (3, 4), (4, 5)):
        wanted = {}
        for g, t, goal in goals:
            own = [x for x in items if x[0] == g]
            sets = [(abs(goal - sum(x[2] for x in c)), n, [x[1] for x in c]) for n in range(1, most + 1) for c in itertools.combinations(own, n)]
            if sets and min(sets)[0] <= D("0.5"):
                wanted[g, t] = min(sets)[0], min(sets)[2]
        found = matching.subset_sums(*frames, ["g"], "i", "x", "t", "y", 0.5, most, grain).collect()
        assert {(q["g"], q["target"]): (q["off"], q["members"]) for q in found} == wanted


def test_staged_passes_use_leftovers(spark):
    left = spark.createDataFrame([(1, 5), (2, 5), (3, 9)], "a int, x int")
    right = spark.createDataFrame([(10, 5), (11, 6), (12, 50)], "b int, y int")
    exact = lambda p, q: p.join(q, p["x"] == q["y"])
    near = lambda p, q: p.join(q, F.abs(p["x"] - q["y"]) <= 1)
    found = matching.staged(left, right, "a", "b", [("exact", exact, [F.col("a")]), ("near", near, [F.col("a")])]).collect()
    assert sorted((r["a"], r["b"], r["stage"]) for r in found) == [(1, 10, "exact"), (2, 11, "near")]


def test_names_by_shared_words(spark):
    left = spark.createDataFrame([(1, "GRUPO EJEMPLO NORTE"), (2, "OTRO NOMBRE")], "a int, n string")
    right = spark.createDataFrame([(5, "EJEMPLO GRUPO SA"), (6, "NOMBRE UNO")], "b int, n string")
    assert [tuple(r) for r in matching.shared_words(left, right, "a", "b", F.col("n"), F.col("n")).collect()] == [(1, 5, 2)]


def test_first_rule_wins(spark):
    data = [("IVA", "Tax", "T", 2, True), ("PERCEP. IVA", "Perception", "P", 1, True), ("", "Never", "N", 0, True), ("X", "Off", "O", 0, False), ("débito", "Debit", "D", 3, True)]
    table = spark.createDataFrame(data, "pattern string, category string, kind string, rank int, active boolean")
    rows = spark.createDataFrame([(1, "percep. iva 21"), (2, "privado iva"), (3, None), (4, "x"), (5, "DEBITO auto")], "k int, t string")
    direct = {r["k"]: r["category"] for r in rules.classify(rows, table, "t").collect()}
    assert direct == {1: "Perception", 2: "Tax", 3: rules.UNKNOWN[0], 4: rules.UNKNOWN[0], 5: "Debit"}
    live = table.where("active and pattern != ''").select(F.upper(F.translate("pattern", "é", "e")).alias("_pattern"), "category", "kind", F.col("rank").alias("_rank"))
    assert {r["k"]: r["category"] for r in rules.classify_by_join(rows, live, "t").collect()} == direct


def test_sides(spark):
    rows = spark.createDataFrame([(D(5), "", None, None), (D(5), "DEB", None, None), (D(-5), "", None, None), (D(-5), "CREDITO", None, None), (D(9), "", D(1), None)], "x decimal(18,2), k string, d decimal(18,2), c decimal(18,2)")
    debit, credit = rules.debit_credit(F.col("x"), F.col("k"), F.col("d"), F.col("c"))
    assert [tuple(r) for r in rows.select(debit, credit).collect()] == [(D(0), D(5)), (D(5), D(0)), (D(5), D(0)), (D(0), D(5)), (D(1), D(0))]


def test_shares_add_up(spark):
    r = random.Random(3)
    rows = [(g, k, D(r.randint(0, 999)) / 100, D("100.01")) for g in range(8) for k in range(r.randint(1, 7))] + [(99, 1, D(0), D("5.00")), (99, 2, D(0), D("5.00"))]
    df = spark.createDataFrame(rows, "g int, k int, w decimal(18,2), t decimal(18,2)")
    found = proration.spread(df, ["g"], ["k"], "w", "t").groupBy("g").agg(F.sum("share").alias("s"), F.first("t").alias("t")).collect()
    assert all(r["s"] == r["t"] for r in found) and len(found) == 9
    cut = proration.discounted(df, ["g"], ["k"], "w", "t").groupBy("g").agg(F.sum("net").alias("n"), F.sum("w").alias("w"), F.first("t").alias("t")).collect()
    assert all(r["n"] == (r["w"] - r["t"] if r["w"] > 0 else r["w"]) for r in cut)


def test_entries_balance(spark):
    rows = spark.createDataFrame([(1, 1, D("10.00"), D(0)), (1, 2, D(0), D("9.97")), (2, 1, D("10.00"), D(0)), (2, 2, D(0), D("1.00"))], "e int, k int, d decimal(18,2), c decimal(18,2)")
    found = {r["e"]: (r["d"], r["c"], r["b"]) for r in proration.balanced_entry(rows, ["e"], ["k"], "d", "c").groupBy("e").agg(F.sum("d").alias("d"), F.sum("c").alias("c"), F.first("balanced").alias("b")).collect()}
    assert found == {1: (D("10.00"), D("10.00"), True), 2: (D("10.00"), D("1.00"), False)}


def test_dedup_and_reports(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z"), (None, 3, "w")], "k string, o int, v string")
    assert sorted(r["v"] for r in dedup.keep_one(rows, ["k"], ["o"]).collect()) == ["w", "y"]
    assert sorted(r["v"] for r in dedup.keep_one(rows, ["k"], ["o"], last=False).collect()) == ["x", "z"]
    assert sorted(r["unique_name"] for r in dedup.unique_names(rows.where("k = 'a'"), "k", ["o"]).collect()) == ["a", "a (2)"]
    assert dedup.sample_strata(rows, "k", 1, ["o"]).count() == 2
    money = rows.select("k", F.lit(5).cast("decimal(18,2)").alias("c"), F.lit(2).cast("decimal(18,2)").alias("d"))
    total = {r["k"]: (r["n"], r["net"]) for r in reports.by_category(money, "k", "c", "d").collect()}
    assert total == {"a": (2, D(6)), "(sin categoría)": (2, D(6)), "TOTAL": (4, D(12))}


def greedy(pairs):
    used_l, used_r, out = set(), set(), []
    for cost, a, b in sorted(pairs):
        if a not in used_l and b not in used_r:
            used_l.add(a)
            used_r.add(b)
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("kind", ["ladder", "descending ladder", "random", "ties"])
def test_assignment_in_few_rounds(spark, monkeypatch, kind):
    r = random.Random(5)
    pairs = {
        "ladder": [(0, i, j) for i in range(400) for j in (i, i + 1)],
        "descending ladder": [(-i, i, j) for i in range(60) for j in (i, i + 1)],
        "random": [(r.randrange(40), r.randrange(150), r.randrange(150)) for _ in range(1500)],
        "ties": [(0, i, j) for i in range(40) for j in range(30)] + [(1, i, 100 + i // 2) for i in range(40)],
    }[kind]
    pairs = sorted({(a, b): c for c, a, b in pairs}.items())
    pairs = [(c, a, b) for (a, b), c in pairs]
    rounds = []
    old = matching._tied
    monkeypatch.setattr(matching, "_tied", lambda *x: (rounds.append(1), old(*x))[1])
    df = spark.createDataFrame(pairs, "c int, a int, b int")
    found = sorted((x["a"], x["b"]) for x in matching.one_to_one(df, "a", "b", [F.col("c")]).collect())
    assert found == greedy(pairs)
    assert len(rounds) < 12


def test_names_that_share_words(spark):
    r = random.Random(9)
    pick = lambda: " ".join(["SOCIEDAD"] * (r.random() < 0.8) + r.sample(["NORTE", "AGUAS", "PUERTO", "CAMPO", "ACERO", "LTDA"], r.randrange(4)))
    a, b = [(k, pick()) for k in range(40)], [(100 + k, pick()) for k in range(40)]
    found = matching.shared_words(spark.createDataFrame(a, "x int, n string"), spark.createDataFrame(b, "y int, n string"), "x", "y", F.col("n"), F.col("n"))
    long = lambda n: {w for w in n.split() if len(w) > 3}
    wanted = sorted((i, j, len(long(m) & long(n))) for i, m in a for j, n in b if len(long(m) & long(n)) >= 2)
    assert sorted(tuple(q) for q in found.collect()) == wanted


def test_rows_that_are_released_are_offered_again(spark):
    r = random.Random(11)
    near = {(a, b): r.randrange(9) for a in range(20) for b in range(20) if r.random() < 0.4}
    far = {(a, b): r.randrange(9) for a in range(20) for b in range(20) if r.random() < 0.3}
    wrong = {p for p in sorted({*near, *far}) if r.random() < 0.75}
    kept, barred, number = {}, set(), 0
    while True:  # the same by loops
        number += 1
        found, used = {}, ({a for a, _ in kept}, {b for _, b in kept})
        for stage, pairs in (("near", near), ("far", far)):
            for _, a, b in sorted((c, a, b) for (a, b), c in pairs.items() if (a, b) not in barred):
                if a not in used[0] and b not in used[1]:
                    found[a, b] = (stage, number)
                    used[0].add(a)
                    used[1].add(b)
        back = {p for p in found if p in wrong}
        kept |= {p: v for p, v in found.items() if p not in back}
        barred |= back
        if not back:
            break
    table = lambda pairs: spark.createDataFrame([(a, b, c) for (a, b), c in pairs.items()], "a int, b int, c int")
    both = lambda pairs: lambda p, q: table(pairs).join(p.select("a"), "a").join(q.select("b"), "b")
    bad = spark.createDataFrame(sorted(wrong), "a int, b int")
    ids = lambda name: spark.range(20).select(F.col("id").cast("int").alias(name))
    out = matching.released(ids("a"), ids("b"), "a", "b", [("near", both(near), [F.col("c")]), ("far", both(far), [F.col("c")])], lambda found: found.join(bad, ["a", "b"], "left_semi"))
    assert number > 2 and {(q["a"], q["b"]): (q["stage"], q["round"]) for q in out.collect()} == kept
