import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from abacusflow.llm import near_dedup as N

from .conftest import ascii_lower, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(ascii_lower(text))
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t, *_ in rows]
    best = [i for i, *_ in rows]
    changed = True
    while changed:
        changed = False
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    least = min((v for v in (best[x], best[y]) if v is not None), default=None)
                    if (best[x], best[y]) != (least, least):
                        best[x] = best[y] = least
                        changed = True
    return [(i, len(s), c, i == c) for (i, *_), s, c in zip(rows, sets, best, strict=True)]


def key(x):
    return tuple(map(str, x))


def test_components_equal_brute_force(spark, folder, rows):
    got = [tuple(r) for r in N.op4_near_dedup(spark, folder).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, 85), key=key)


def test_families_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 16)
    r = np.random.default_rng(3)
    rows = []
    for family in range(3):
        base = prose(family + 20, 150, 5000)
        for _ in range(40):
            words = list(base)
            for k in r.choice(150, r.integers(0, 5), replace=False):
                words[k] = f"w{r.integers(1 << 30)}"
            rows.append((len(rows) * 7 % 121, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = brute(rows, 85)
    found = N.linked(docs).select("_id", "_n", "_rep._id").collect()
    assert sorted(((a, b, c, a == c) for a, b, c in found), key=key) == sorted(wanted, key=key)
    kept = [r["doc_id"] for r in N.deduplicated(docs, percent=85).collect()]
    assert sorted(kept) == sorted(a for a, _, c, _ in wanted if a == c)


def test_drifting_copies_in_large_stars(spark, monkeypatch):
    """Chains in which neighbours are linked and ends are not, in stars of several blocks and bands."""
    monkeypatch.setattr(N, "BLOCK_MEMBERS", 3)
    rows = []
    for family in range(2):
        words = prose(family + 70, 120, 5000)
        for k in range(45):
            rows.append((len(rows) * 13 % 97, " ".join(words)))
            for j in range(2):
                words[(2 * k + j) % 120] = f"v{family}x{k}x{j}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members = []
    large = N._large_star_links
    monkeypatch.setattr(N, "_large_star_links", lambda *x: members.append(x[1].count()) or large(*x))
    found = N.linked(docs).select("_id", "_n", "_rep._id").collect()
    assert sorted(((a, b, c, a == c) for a, b, c in found), key=key) == sorted(brute(rows, 85), key=key)
    assert members and members[0] > 0


def test_sets_that_share_a_hash_are_hashed_anew(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(prose(k, 40))) for k in range(8)] + [(8, " ".join(prose(3, 40)))], "doc_id long, text string")
    salts, described = [], N.described

    def weak(*x):
        salts.append(x[3])
        return described(*x).withColumn("_class", F.col("_class") % 2) if x[3] == 0 else described(*x)

    monkeypatch.setattr(N, "described", weak)
    assert {r["_id"]: r["_rep"]["_id"] for r in N.linked(docs).collect()} == {k: k for k in range(8)} | {8: 3}
    assert salts == [0, 1]


def test_equal_sums_are_not_equal_words(spark):
    half = "a"
    for _ in range(11):
        half += half.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, half), (2, half.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {r["_id"]: r["_rep"]["_id"] for r in N.linked(docs).collect()} == {1: 1, 2: 2}


def test_one_of_each_group_stays(spark, docs, rows):
    clash = docs.withColumn("_row", F.lit(1)).withColumn("_id", F.lit("x"))
    kept = N.deduplicated(clash)
    assert kept.columns == clash.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(map(str, [1, 4, 5, 6, 7, 8, 9, 11, 12, 13, None, 14, 15]))


def test_odd_tables(empty):
    assert N.linked(empty).count() == 0
    assert N.deduplicated(empty).count() == 0


def test_keys_agree_as_often_as_promised():
    r = np.random.default_rng(9)
    texts = []
    for _ in range(150):
        words = [f"w{x}" for x in r.integers(0, 1 << 40, 240)]
        other = list(words)
        for k in r.choice(np.arange(10, 230, 12), 4, replace=False):
            other[k] = f"x{r.integers(1 << 40)}"
        texts += [" ".join(words), " ".join(other)]
    codes, first = N.shingle_sets(pa.array(texts, pa.large_string()))
    half, whole, check = N.signatures(codes, first)
    tables = N.table_keys(half)
    assert tables.shape[1] == N.HALVES**2
    assert (tables[0::2] == tables[1::2]).any(axis=1).all()
    assert len(set(whole.tolist())) == len(set(check.tolist())) == len(texts) and not set(whole.tolist()) & set(check.tolist())


def test_a_link_at_the_very_threshold_of_long_texts():
    """100 times what these share is beyond the whole numbers that 32-bit floats hold."""
    for common, union, wanted in [(671_585, 790_100, True), (671_653, 790_180, True), (671_584, 790_100, False), (671_551, 790_060, True)]:
        shared, more = " ".join(f"w{k:x}" for k in range(common + 4)), union - common
        texts = [f"{shared} " + " ".join(f"{s}{k:x}" for k in range(n)) for s, n in (("a", more // 2), ("b", more - more // 2))]
        assert (N.links_within(pa.array(texts), np.zeros(2, np.int8), 85)[1] == 0) == wanted
        assert bool(N._to_centre(pa.array(texts), 85)[1][1]) == wanted
