import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from abacusflow.llm import prefix_trie as T

ROWS = "conv_id bigint, turn bigint, role string, text string"


def told(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def in_order(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, told(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def nodes_of(convs):
    """Every node by plain loops over all prefixes."""
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[c] for c in children[p]]
        worth = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(x[0] for x in below) if below else 1, worth + sum(x[1] for x in below))
    out = []
    for p, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(p))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found_by(spark, convs, **how):
    turns = [(c, k, told(*t), len(t[1].encode())) for c, v in convs.items() for k, t in enumerate(v, 1)]
    lens = [(c, len(v)) for c, v in convs.items()]
    out = T.trie(spark.createDataFrame(turns, "conv bigint, pos bigint, mark binary, bytes bigint"), spark.createDataFrame(lens, "conv bigint, len bigint"), **how)
    assert out.columns == T.NODE
    return sorted((tuple(r) for r in out.collect()), key=str)


def grown(seed, n, depth, choices):
    r = random.Random(seed)
    return {c * 3: [(r.choice(["user", "assistant"][: 1 + choices % 2]), "é" * r.randrange(choices)) for _ in range(r.randrange(depth))] for c in range(n)}


@pytest.mark.parametrize(("seed", "n", "depth", "choices", "stride", "most"), [(1, 60, 6, 2, 8, 4096), (2, 60, 12, 2, 1, 1), (3, 40, 30, 1, 2, 4), (4, 80, 5, 3, 2, 2)])
def test_equals_plain_loops(spark, seed, n, depth, choices, stride, most):
    convs = grown(seed, n, depth, choices)
    assert found_by(spark, convs, stride=stride, most=most) == nodes_of(convs)


def test_copies_of_a_long_conversation(spark):
    long = [("user", f"{k}") for k in range(300)]
    convs = {1: long, 2: long, 7: long[:150], 9: [*long[:299], ("user", "other")], 11: [], 12: [("user", "x")] * 40}
    assert found_by(spark, convs) == nodes_of(convs)


@pytest.mark.parametrize("convs", [{5: []}, {5: [("a", "b")]}, {1: [], 2: []}, {-3: [("a", "b")], 4: [("a", "b")], 100_000_000_000: [("a", "b")]}])
def test_small_tables(spark, convs):
    assert found_by(spark, convs) == nodes_of(convs)


def test_query_with_every_odd_row(spark, folder, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    rows += [(None, 1, "user", "nobody's"), (10, None, "user", "first"), (10, 5, None, None), (10, 5, "user", "tie"), (10, 5, "user", "tie"), (10, -4, "a", "before"), (11, 1, "user", "x"), (12, 0, "user", "x"), (13, 9, "user", "x")]
    rows += [(c, k, "user", f"turn {k}") for c in range(20, 40) for k in range(c % 13)] + [(50, k, "u", "word " * 30_000) for k in range(3)]
    spark.createDataFrame(rows, ROWS).withColumn("conv", F.lit("clash")).withColumn("pos", F.lit(None).cast("int")).write.parquet(f"{tmp_path}/conversations.parquet")
    found = sorted((tuple(r) for r in T.op11_prefix_trie(spark, str(tmp_path)).collect()), key=str)
    assert found == nodes_of(rebuilt(in_order(rows)))


def test_numbering_in_cells(spark):
    rows = [(1, k * 700, "user", str(k)) for k in range(50)] + [(1, None, "user", "none")]
    found = {r["pos"]: r["text"] for r in T.sequences(spark.createDataFrame(rows, ROWS), payload=True).collect()}
    assert found == {1: "none"} | {k + 2: str(k) for k in range(50)}


def test_turns_of_nodes(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi")]
    turns = T.sequences(spark.createDataFrame(rows, ROWS), payload=True)
    found = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in T.with_turns(T.trie(turns, T.lengths(turns)), turns).collect()}
    assert found == {(1, 0): (None, None), (1, 1): ("user", "hi"), (1, 2): ("bot", "yes")}


def test_digest_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    convs = {c: [("user", "same")] for c in range(-20, 60, 2)}
    assert found_by(spark, convs) == nodes_of(convs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert T.op11_prefix_trie(spark, str(tmp_path)).count() == 0
