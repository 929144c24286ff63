import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abacusflow.llm import decontamination as D
from abacusflow.llm.fm_index import BREAK, FMIndex

from .conftest import ascii_lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 5), min_size=3, max_size=3), min_size=1, max_size=10))
def test_index_finds_every_occurrence(runs, phrases):
    text = [x for run in runs for x in [*run, BREAK]]
    index = FMIndex.restored(FMIndex.of(np.array(text, np.int64)).stored())
    low, high = index.search(np.array(phrases, np.int64))
    which, place = index.locate(low, high)
    got = sorted(zip(which.tolist(), place.tolist(), strict=True))
    assert got == sorted((p, k) for p, phrase in enumerate(phrases) for k in range(len(text) - 2) if text[k : k + 3] == phrase)


def test_index_of_repeats_and_rest():
    text = np.array([1, 2] * 3000 + [BREAK] + [3] * 500 + [BREAK], np.int64)
    index = FMIndex.of(text)
    low, high = index.search(np.array([[1, 2, 1], [3, 3, 3], [2, 2, 1], [9, 1, 1]]))
    assert (high - low).tolist() == [2999, 498, 0, 0]
    assert sorted(index.locate(low[:1], high[:1])[1].tolist()) == list(range(0, 5998, 2))


def brute(rows, items, window=10):
    phrases = []
    for i, t in items:
        w = WORD.findall(ascii_lower(t))
        n = min(window, len(w))
        phrases += [(str("" if i is None else i), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n]
    for i, t, *_ in rows:
        w, hit, ids = WORD.findall(ascii_lower(t)), set(), set()
        for item, p in phrases:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids.add(item)
        yield i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_equal_to_brute_force(spark, folder, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = sorted(tuple(map(str, r)) for r in D.op10_decontamination(spark, folder).collect())
    wanted = list(brute(rows, items))
    assert got == sorted(tuple(map(str, r)) for r in wanted)
    assert any(r[5] for r in wanted) and not all(r[5] for r in wanted)


def test_blocks_and_shards_do_not_matter(spark, folder, docs):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    extra = spark.createDataFrame([(None, "zebra crossing ahead"), (7, "one two")], "item_id long, text string")
    items = items.unionByName(extra)
    columns = ["_row", "n_words", "_begin", "_end", "_items"]
    runs = [sorted(map(str, D.hits(docs, F.col("doc_id"), items, block_bytes=b, shard_bytes=s).select(*columns).collect())) for b, s in ((1 << 20, 1 << 20), (40, 300))]
    assert runs[0] == runs[1]


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Before, THE quick (brown) fox! after", 5), (2, "quick the", 6), (3, None, 7)], "doc_id long, text string, _text int")
    items = spark.createDataFrame([(1, "the quick brown fox")], "item_id long, text string")
    cleaned = {r["doc_id"]: r for r in D.spans_removed(docs, items).collect()}
    assert cleaned[1]["text"] == "Before, ! after" and cleaned[2]["text"] == "quick the" and cleaned[3]["text"] is None
    assert D.spans_removed(docs, items).columns == docs.columns
    assert sorted(r["doc_id"] for r in D.without_benchmark(docs, items).collect()) == [2, 3]


def test_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.without_benchmark(docs, none).count() == docs.count()
    assert D.without_benchmark(empty, none).count() == 0


def test_one_index_serves_several_benchmarks(spark, docs, folder):
    index = D.shard_index(docs.repartition(3), F.col("doc_id"), shard_bytes=2000)
    assert index.count() > 2
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    other = spark.createDataFrame([(9, "x y z x"), (8, "漢字 😀")], "item_id long, text string")
    for k in (items, other):
        columns = ["_row", "n_words", "_begin", "_end", "_items"]
        assert sorted(map(str, D.search(index, k).select(*columns).collect())) == sorted(map(str, D.hits(docs, F.col("doc_id"), k).select(*columns).collect()))
    assert {r["_row"] for r in D.search(index, other).where(F.size("_begin") > 0).collect()} == {12, 15}


def test_equal_sums_are_not_equal_words(spark):
    half = "a"
    for _ in range(11):
        half += half.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, half), (2, half.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    items = docs.where("doc_id = 1").select(F.col("doc_id").alias("item_id"), "text")
    assert [r["doc_id"] for r in D.without_benchmark(docs, items).collect()] == [2]
