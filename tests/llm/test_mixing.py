import re
from collections import defaultdict

from pyspark.sql import functions as F

from abacusflow.llm import mixing as M


def targets(sizes, budget):
    """Water-filling by hand: cap at 3 times the size, share the rest by weight."""
    names = sorted(n for n in sizes if n is not None) + [n for n in sizes if n is None]
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    out, open_ = {}, set(names)
    while open_:
        share = (budget - sum(out.values())) / sum(weight[n] for n in open_)
        over = {n for n in open_ if weight[n] * share >= 3 * sizes[n]}
        if not over:
            return out | {n: weight[n] * share for n in open_}
        out |= {n: 3.0 * sizes[n] for n in over}
        open_ -= over
    return out


def test_targets_and_takes(spark, folder, rows):
    found = M.op6_mixing(spark, folder).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, source, _ in rows:
        sizes[source] += words(t)
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted((str(i), words(t)) for i, t, *_ in rows)
    wanted = targets(sizes, sum(sizes.values()))
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6 * (1 + r["target"])
        assert r["taken"] <= 3 * r["size"]
    again = {(r["doc_id"], r["taken"]) for r in M.op6_mixing(spark, folder).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in found}


def many(spark):
    text = F.concat(F.repeat(F.lit("w "), (F.col("id") % 23).cast("int")), F.lit("w"))
    source = F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 10).cast("string")))
    return spark.range(5000).select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"), F.lit(1).alias("_row"))


def test_large_sources_come_near_their_targets(spark):
    found = M.taken(many(spark)).groupBy("_source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("t"), F.first("_target").alias("target")).collect()
    assert len(found) == 5
    for r in found:
        assert abs(r["t"] - r["target"]) <= 24
    weights = spark.createDataFrame([("hot", 1.0), ("s7", 1.0)], "_source string, _weight double")
    own = {r["_source"]: r["t"] for r in M.taken(many(spark), weights=weights).groupBy("_source").agg(F.sum("_copies").alias("t")).collect()}
    assert own["s8"] == 0 and own["hot"] > 0


def test_every_prefix_is_mixed(spark):
    mix = M.mixed(many(spark))
    assert mix.columns == ["doc_id", "text", "source", "_row"]
    rows = mix.collect()
    part = rows[: len(rows) // 4]
    share = lambda rs: sum(len(r["text"].split()) for r in rs if r["source"] == "hot") / sum(len(r["text"].split()) for r in rs)
    assert abs(share(part) - share(rows)) < 0.02


def test_odd_tables(spark, docs, empty):
    assert M.mixed(empty).count() == 0
    assert {r["doc_id"] for r in M.mixed(docs).collect()}.isdisjoint({6, 7, 8})
    only = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert M.taken(only).first()["_target"] == 0
