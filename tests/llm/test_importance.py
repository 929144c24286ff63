import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from abacusflow.llm import importance as I

from .conftest import SCHEMA, ascii_lower, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall(ascii_lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def by_hand(rows, target, percent=25, least=20):
    """doc_id, n_features, weight, score, rank of every row, by plain loops."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, runs(text)[1]))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    big_s, big_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    out = []
    for key, text in rows:
        words, found = runs(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def as_rows(found):
    return sorted(((r["_key"], r["_features"], r["_weight"], r["_score"], r["_rank"]) for r in found.collect()), key=str)


def test_equals_plain_loops(spark, folder, rows):
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = sorted((tuple(r) for r in I.op13_importance(spark, folder).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert found == by_hand([(i, t) for i, t, *_ in rows], target)


@pytest.mark.parametrize("size", [1, 3, 500])
def test_chunks_change_nothing(docs, rows, size):
    target = docs.where("doc_id = 4").select("text")
    found = I.scored(docs, target, long_bytes=10, chunk_words=size)
    assert as_rows(found) == by_hand([(i, t) for i, t, *_ in rows], [t for i, t, *_ in rows if i == 4])


def test_a_chunk_owns_what_starts_in_it():
    found = list(I.chunks(pa.array(["One, two THREE four five", None, "--"]), 2, 3))
    assert found == [(0, 0, 2, "one, two three four"), (0, 1, 2, "three four five"), (0, 2, 1, "five"), (1, 0, 0, ""), (2, 0, 0, "")]
    whole = sorted(I.features(pa.array(["one two three four five"]), runs=3)[1].tolist())
    parts = I.features(pa.array([t for *_, t in found[:3]]), np.array([2, 2, 1]), runs=3)[1]
    assert sorted(parts.tolist()) == whole


def test_words_of_any_length():
    texts = ["a" * n + " é" + "b" * n for n in (0, 1, 7, 63, 64, 65, 1000)]
    whose, bucket, _ = I.features(pa.array(texts))
    for k, text in enumerate(texts):
        assert sorted(bucket[whose == k].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in runs(text)[1])


def test_a_long_text_among_short_ones(spark):
    rows = [(k, " ".join(prose(k, 30))) for k in range(30)] + [(99, " ".join(prose(99, 300_000, 5000)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    target = docs.where("doc_id in (1, 2)").select("text")
    assert as_rows(I.scored(docs, target)) == by_hand(rows, [t for k, t in rows if k in (1, 2)])


def test_ties_take_consecutive_ranks(spark):
    docs = spark.range(400).select(F.lit(5).cast("long").alias("doc_id"), F.lit(" ".join(prose(1, 25))).alias("text"))
    ranks = [r["_rank"] for r in I.scored(docs, docs.limit(1)).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 101)) and ranks.count(None) == 300


def test_empty_tables_and_clashing_columns(spark, docs, empty):
    assert I.scored(empty, docs).count() == 0
    assert I.scored(docs, empty).count() == docs.count()
    odd = docs.withColumn("_row", F.lit(1)).withColumn("_key", F.lit("k")).withColumn("_rank", F.lit(2)).withColumn("key", F.lit(3))
    kept = I.resampled(odd, docs.where("doc_id = 4"), percent=100, least_words=0)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert docs.schema == spark.createDataFrame([], SCHEMA).schema
