import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from abacusflow.llm import ppm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def brute(rows, order):
    sequence = lambda words: b"\n" * order + b"".join(w.encode() + b" " for w in words) + b"\n"
    count, trie = Counter(), defaultdict(Counter)
    for i, t, *_ in rows:
        if not held_out(i):
            count.update([*tokens(t), None])
            s = sequence(tokens(t))
            for p in range(order, len(s)):
                trie[s[p - order : p]][s[p]] += 1
    for k in range(order, 0, -1):  # a shorter context counts each longer one once
        for context, seen in [x for x in trie.items() if len(x[0]) == k]:
            for b in seen:
                trie[context[1:]][b] += 1
    n, v = sum(count.values()), len(count)
    for i, t, *_ in rows:
        words = [*tokens(t), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        score, s = 0.0, sequence(words[:-1])
        for p in range(order, len(s)):
            excluded = set()
            for k in range(order, -1, -1):
                seen = trie.get(s[p - k : p], {})
                uses = sum(c for b, c in seen.items() if b not in excluded)
                if uses and s[p] in seen:
                    score += math.log10((seen[s[p]] - ppm.DISCOUNT) / uses)
                    break
                if uses:
                    score += math.log10(ppm.DISCOUNT * len(set(seen) - excluded) / uses)
                excluded = set(seen)
            else:
                score -= math.log10(256 - len(excluded))
        yield i, held_out(i), len(words), sum(count[w] > 0 for w in words), n, base, score


def test_scores_equal_brute_force(spark, folder, rows):
    key = lambda r: (str(r[0]), r[2])
    got = sorted((tuple(r) for r in ppm.op2_ppm(spark, folder).collect()), key=key)
    wanted = sorted(brute(rows, ppm.ORDER), key=key)
    assert [x[:5] for x in got] == [x[:5] for x in wanted]
    np.testing.assert_allclose([x[5] for x in got], [x[5] for x in wanted], rtol=1e-9)
    np.testing.assert_allclose([x[6] for x in got], [x[6] for x in wanted], rtol=1e-6)


def test_pages_and_groups_do_not_matter(spark, docs, monkeypatch):
    learn = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    runs = []
    for n, group in ((1 << 20, 4096), (500, 4096), (2000, 3)):
        monkeypatch.setattr(ppm, "GROUP_PAGES", group)
        runs.append({(r["_row"], r["n_tokens"]): (r["score"], r["base_score"]) for r in ppm.scored(docs, F.col("doc_id"), learn, page_bytes=n).collect()})
    assert runs[0].keys() == runs[1].keys() == runs[2].keys()
    for other in runs[1:]:
        assert all(math.isclose(x, y, rel_tol=1e-6) for k in runs[0] for x, y in zip(runs[0][k], other[k], strict=True))


def test_model_beats_the_unigram_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    found = ppm.scored(docs, F.col("doc_id"), fold != 0).where(F.crc32(F.col("_row").cast("string").cast("binary")) % 10 == 0)
    r = found.agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert r["a"] > r["b"]


def test_probabilities_add_up():
    r = np.random.default_rng(0)
    order = 3
    runs = np.unique(r.integers(0, 4, (200, order + 1)) @ (256 ** np.arange(order, -1, -1))).astype(np.uint64)
    trie = ppm.levels(runs, r.integers(1, 5, len(runs)), order)
    for context in (runs[:20] >> np.uint64(8)).tolist() + [0x636465]:
        every = np.array([(context << 8) | b for b in range(256)], np.uint64)
        assert math.isclose((10 ** ppm.costs(every, order, trie)).sum(), 1, rel_tol=1e-9)


def test_codes_keep_runs():
    runs = np.random.default_rng(1).integers(0, 1 << 48, 1000, np.int64).astype(np.uint64)
    assert (ppm.to_runs(ppm.to_codes(runs, 5), 5) == runs).all()


def test_odd_tables(spark, empty):
    assert ppm.scored(empty, F.col("doc_id"), F.lit(True)).count() == 0
    nothing = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    found = {r["_row"]: r for r in ppm.scored(nothing, F.col("doc_id"), F.lit(False)).collect()}
    assert found[1]["train_tokens"] == 0 and found[1]["n_known"] == 0
    assert math.isclose(found[2]["score"], -math.log10(256), rel_tol=1e-6)
