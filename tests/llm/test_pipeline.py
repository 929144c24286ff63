import hashlib
import re
import struct
from collections import Counter, defaultdict

import __spark_entry__
import corpus_pipeline
import xxhash

from abacusflow.llm import decontamination, mixing, near_dedup, quality_rules
from abacusflow.llm.common import cut
from abacusflow.sources import scratch

from .conftest import prose
from .test_decontamination import brute as leak_brute
from .test_near_dedup import brute as near_brute


def test_stages_take_effect(spark, folder, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    state = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = cut(stage(spark, state, folder))
        assert state.columns == docs.columns
        counts.append(state.count())
    assert counts[0] < docs.count() and counts[1] < counts[0] and counts[2] <= counts[1]
    rows = corpus_pipeline.run(spark, folder).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert len(rows) == counts[3]
    ids = {r["doc_id"] for r in rows}
    assert not ids & {1, 2, 3, 4, 5}  # copies, and the benchmark's passages


def test_stages_take_empty_tables(spark, folder, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_results_of_two_stages_side_by_side(spark, folder, docs):
    a = corpus_pipeline.quality_stage(spark, docs, folder)
    b = corpus_pipeline.decontamination_stage(spark, docs, folder)
    c = corpus_pipeline.near_dedup_stage(spark, corpus_pipeline.near_dedup_stage(spark, docs, folder).where("doc_id > 1"), folder)
    assert min(a.count(), b.count(), c.count()) > 0
    before = set(scratch.made(spark))
    del a, b, c
    corpus_pipeline.quality_stage(spark, docs, folder)
    assert before - set(scratch.made(spark))


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert all(f.__module__ for f in (quality_rules.keep_good, near_dedup.deduplicated, decontamination.hits, mixing.mixed))


def plain_mix(rows, epochs=3):
    """Copies of each document by weighted fair queueing, one queue after the other."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r["text"]) for r in rows if r["source"] == s) for s in names}
    weight, target, capped = {s: 1 + k % 3 for k, s in enumerate(names)}, {}, set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / (sum(w for s, w in weight.items() if s not in capped) or 1)
        target = {s: 3 * total[s] if s in capped else weight[s] * level for s in names}
        over = {s for s in names if s not in capped and target[s] >= 3 * total[s]}
        if not over:
            break
        capped |= over
    ends = []
    for s in names:
        digest = lambda r: hashlib.md5(f"17|{'' if r['doc_id'] is None else r['doc_id']}|{hashlib.md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()
        passed = 0
        for r in sorted((r for r in rows if r["source"] == s), key=digest):
            passed += size(r["text"])
            ends += [((passed - size(r["text"]) / 2 + e * total[s]) / target[s], size(r["text"]), r) for e in range(epochs) if size(r["text"]) and target[s]]
    spent, until, budget = 0, 1.0, sum(total.values())
    for finish, n, _ in sorted(ends, key=lambda x: x[0]):
        if finish > 1:
            break
        spent += n
        if spent >= budget:
            until = finish
            break
    return [r["doc_id"] for finish, _, r in ends if finish <= until]


def plain_shards(rows, slots=4096, shards=16):
    weight = Counter()
    key = lambda r: (r["text"] or "").encode() if r["doc_id"] is None else struct.pack("<q", r["doc_id"])
    slot = lambda r: struct.unpack("<q", xxhash.xxh64(key(r), seed=42).digest()[::-1])[0] % slots
    for r in rows:
        weight[slot(r)] += len((r["text"] or "").encode()) + 1
    held, owner = dict.fromkeys(range(shards), 0), {}
    for s in sorted(range(slots), key=lambda s: (-weight[s], s)):
        owner[s] = min(held, key=lambda k: (held[k], k))
        held[owner[s]] += weight[s]
    return [(r["doc_id"], owner[slot(r)]) for r in rows]


def test_every_stage_equals_a_plain_version(spark, folder, docs):
    """Each stage, on what its predecessor kept, against loops over its rows."""
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    more = spark.createDataFrame([(100 + k, " ".join(f"the of and to {w}{'.' if j % 6 == 5 else ''}" for j, w in enumerate(prose(200 + k, 40, 900))), "en", "abcd"[k % 4], 1) for k in range(24)], docs.schema)
    state = cut(docs.unionByName(more))
    for name, stage in corpus_pipeline.STAGES:
        before = state.collect()
        state = cut(stage(spark, state, folder))
        after, told = state.collect(), [(r["doc_id"], r["text"]) for r in before]
        if name == "quality_rules":
            rules = list(quality_rules.rules())
            votes = [r.asDict() for r in quality_rules.measured(spark.createDataFrame(before, docs.schema)).withColumns(quality_rules.rules()).collect()]
            passed = [v for v in votes if v["n_words"] >= 50 and 100 * v["n_repeat_words"] <= 50 * v["n_words"]]
            model = quality_rules.fit(spark.createDataFrame([tuple(v[n] for n in rules) for v in passed], ", ".join(f"{n} int" for n in rules)), rules)
            odds = lambda v: quality_rules.posterior({n: v[n] for n in rules if v[n] or v["n_words"] >= 50}, model["prior"], model["rate"])  # noqa: E731, B023
            wanted = [v["doc_id"] for v in votes if v["n_words"] and 100 * v["n_repeat_words"] <= 50 * v["n_words"] and odds(v) >= 0.5]
        elif name == "near_dedup":
            wanted = list({i for (i, n, _, kept) in near_brute(told, 80) if kept and n}) + [i for (i, n, _, _) in near_brute(told, 80) if not n]
        elif name == "decontamination":
            wanted = [r[0] for r in leak_brute(told, items) if not r[5]]
        elif name == "mixing":
            wanted = plain_mix(before)
        else:
            assert Counter((r["doc_id"], r["shard"]) for r in after) == Counter(plain_shards(before))
            break
        assert Counter(r["doc_id"] for r in after) == Counter(wanted), name
