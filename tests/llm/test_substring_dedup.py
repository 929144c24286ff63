import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from abacusflow.llm import substring_dedup as S

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window=35):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    for w in words:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        yield w, gone


def test_equal_to_brute_force(spark, folder, rows):
    got = sorted(tuple(map(str, r)) for r in S.op9_substring_dedup(spark, folder).collect())
    wanted = []
    for (i, *_), (w, gone) in zip(rows, brute([r[1] for r in rows]), strict=True):
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        wanted.append(tuple(map(str, (i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))))
    assert got == sorted(wanted)


@pytest.mark.parametrize("hot", [0, 3, 256])
def test_small_pages_and_hot_prefixes(spark, hot):
    passages = [prose(k, 50, 3000) for k in range(3)]
    texts = []
    for k in range(60):
        own = prose(100 + k, 40, 3000)
        texts.append(" ".join(own[: k % 40] + passages[k % 3][k % 7 : 50 - k % 5] + own[k % 40 :]))
    texts += ["a b " * 60, "a " * 34, "a " * 35, "a " * 36, " ".join(passages[0][:34]), " ".join(prose(7, 900, 5000)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["_row"]: r for r in S.repeats(docs, F.col("doc_id"), page_bytes=2000, most=hot).collect()}
    for i, (w, gone) in enumerate(brute(texts)):
        r = found[i]
        spans = {k for a, b in zip(r["begin"], r["end"], strict=True) for k in range(a, b)}
        assert spans == gone and r["n_removed"] == len(gone) and r["n_words"] == len(w)
        assert r["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("hot", [0, 10, 1000])
def test_short_windows_over_few_words(spark, hot):
    """Subtrees that branch everywhere: every removed word, and each maximal repeat in texts of their own."""
    r = random.Random(hot)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 14))) for _ in range(150)] + ["x y z v w u", "q x y z v w u", "x y z v w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for window, gram in ((6, 2), (5, 5), (7, 1)):
        found = {r["_row"]: r for r in S.repeats(docs, F.col("doc_id"), window=window, gram=gram, page_bytes=300, most=hot).collect()}
        for i, (_, gone) in enumerate(brute(texts, window)):
            assert {k for a, b in zip(found[i]["begin"], found[i]["end"], strict=True) for k in range(a, b)} == gone


def test_odd_tables(spark, docs, empty):
    assert S.repeats(empty, F.col("doc_id")).count() == 0
    clash = docs.select(F.struct("*", F.lit(1).alias("kept")).alias("all"), F.col("text"))
    found = S.repeats(clash, F.col("all")).select("_row.*", "n_removed")
    assert found.count() == docs.count() and "kept" in found.columns


def test_pages_meet_their_answers_one_by_one(spark, docs):
    """Answers are not gathered in the JVM, nor all pages of a task handed over at once."""
    told = S.repeats(docs, F.col("doc_id"), page_bytes=500)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in told and "collect_list" not in told
