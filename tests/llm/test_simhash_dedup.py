import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from abacusflow.llm import simhash_dedup as S

from .conftest import ascii_lower, prose


def fingerprint(text):
    """Bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least(numbers, ids, most=4):
    """The least id of each one's component, by comparing all with all."""
    out = list(range(len(numbers)))
    while True:
        new = [min(out[j] for j in range(len(numbers)) if (numbers[i] ^ numbers[j]).bit_count() <= most) for i in range(len(numbers))]
        if new == out:
            break
        out = new
    return [min((ids[j] for j in range(len(ids)) if out[j] == out[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def test_equals_brute_force(spark, folder, rows):
    found = S.op12_simhash(spark, folder).collect()
    numbers, ids = [fingerprint(t) for _, t, *_ in rows], [i for i, *_ in rows]
    wanted = [(i, f"{n:016x}", c) for i, n, c in zip(ids, numbers, least(numbers, ids), strict=True)]
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == sorted(wanted, key=str)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "SHINGLES", 7)
    texts = [" ".join(prose(k, n)) for k, n in enumerate([0, 1, 3, 4, 5, 20, 100])] + [None]
    assert S.fingerprints_of(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def clustered(seed, centres, size, flips):
    """Fingerprints in clusters, with bits 0 to 9 mostly alike."""
    r = random.Random(seed)
    out = set()
    for _ in range(centres):
        centre = r.getrandbits(64) & ~0x3FF | (0x2A5 if r.random() < 0.9 else r.getrandbits(10))
        for _ in range(size):
            x = centre
            for b in r.sample(range(64), r.randint(0, flips)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def components_of(spark, numbers, **how):
    signed = np.array(numbers, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame([(x,) for x in signed], "_fp bigint").repartition(3)
    block = how.pop("block", S.BLOCK)
    comps = {r["_class"]: r["_comp"] for r in S.components(S.cut(S.links(S.bucket_rows(classes, **how), how.get("most", 4), block, 64).distinct())).collect()}
    return [comps.get(x, x) for x in signed]


@pytest.mark.parametrize(("m", "block"), [(None, S.BLOCK), (5, 16), (4, S.BLOCK), (3, 40), (2, S.BLOCK)])
def test_finds_every_link(spark, m, block):
    numbers = clustered(m or 1, 25, 12, 6)
    signed = np.array(numbers, np.uint64).view(np.int64).tolist()
    assert components_of(spark, numbers, m=m, block=block) == least(numbers, signed)


@pytest.mark.parametrize("most", [1, 3, 6])
def test_other_distances(spark, most):
    numbers = clustered(most, 12, 8, most + 2)
    signed = np.array(numbers, np.uint64).view(np.int64).tolist()
    assert components_of(spark, numbers, most=most) == least(numbers, signed, most)


def test_chains_across_partitions(spark):
    chain, x = [0], 0
    for k in range(20):  # each four bits from the one before
        for b in range(3 * k, 3 * k + 4):
            x ^= 1 << b
        chain.append(x)
    assert set(components_of(spark, chain)) == {min(np.array(chain, np.uint64).view(np.int64).tolist())}


def test_allocation_is_the_cheapest():
    r = np.random.default_rng(3)
    cost = np.concatenate([np.zeros((3, 1, 40)), np.sort(r.random((3, 5, 40)), axis=1)], axis=1)
    found = S.allocated(cost, 4)
    assert (found.sum(axis=0) == 4 - 3 + 1).all()
    for k in range(40):
        every = [cost[0, a, k] + cost[1, b, k] + cost[2, c, k] for a in range(6) for b in range(6) for c in range(6) if a + b + c == 5]
        assert sum(cost[i, found[i, k] + 1, k] for i in range(3)) == pytest.approx(min(every))


def test_counts_at_distances():
    counts = np.random.default_rng(4).integers(0, 5, 64)
    found = S.at_distance(counts, 3)
    for v in range(64):
        for d in range(4):
            assert found[d, v] == sum(int(n) for x, n in enumerate(counts) if (x ^ v).bit_count() == d)


def test_a_common_value_is_not_asked():
    """A fingerprint with a value that most have leaves that partition out, and others ask it as before."""
    parts, n = [list(range(16 * k, 16 * k + 16)) for k in range(4)], 1 << 20
    spread = np.full(1 << 16, n >> 16)
    hot = np.zeros(1 << 16, np.int64)
    hot[7], hot[9000] = n - 40, 40
    counts = {tuple(p): S.at_distance(h, 4) for p, h in zip(parts, [hot, spread, spread, spread], strict=True)}
    cost = S.expected(parts, counts, n, np.array([7 | 3 << 16, 9000 | 3 << 16], np.uint64), 4)
    within = S.allocated(cost, 4)
    assert within[0].tolist() == [-1, 1] and (within.sum(axis=0) == 1).all()


def test_groups_in_partitions_go_by_correlation():
    strength = np.eye(64)
    for a in range(0, 64, 4):  # bits a, a + 1, a + 2, a + 3 vary together
        strength[a : a + 4, a : a + 4] = 0.9
    parts = S.partitions(strength, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert all(len({b // 4 for b in p}) == 4 for p in parts)


def test_empty_tables_copies_and_columns(spark, docs, empty):
    assert S.linked(empty).count() == 0
    many = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("the very same words again and again").alias("text"))
    assert {r["_rep"] for r in S.linked(many).collect()} == {0}
    odd = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("_id", F.lit(1)).withColumn("_fp", F.lit(2)).withColumn("_rep", F.lit(3))
    kept = S.deduplicated(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 4, 5, 6, 9, 11, 12, 13}
