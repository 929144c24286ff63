import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from abacusflow.llm import sharding as S


def test_places_are_gapless_and_sizes_near_equal(spark, folder, rows):
    found = S.op3_sharding(spark, folder).collect()
    places = defaultdict(list)
    for r in found:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    key = lambda x: (str(x[0]), *x[1:])
    wanted = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=key)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=key) == wanted
    assert {r["law"] for r in found} == {"bytes"} and {r["grown_shard"] for r in found} == {None}
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 37).cast("int")).alias("text"))
    held = [r["b"] for r in S.sharded(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(held) == 16 and max(held) - min(held) < 0.02 * max(held)


def test_map_versions_move_little():
    load = {s: (1, 100 + s % 7) for s in range(4096)}
    one = S.balanced(load, 4096, 16)
    two = S.balanced(load, 4096, 17, one)
    assert [v["version"] for v in two] == [1, 2]
    moved = [(a, b) for a, b in zip(two[0]["owner"], two[1]["owner"], strict=True) if a != b]
    assert 0 < len(moved) < 4096 / 10
    assert sum(b == 16 for _, b in moved) > 0.9 * len(moved)
    fewer = S.balanced(load, 4096, 15, two)[-1]
    assert set(fewer["owner"]) == set(range(15))


def test_edited_texts_stay_and_hot_ids_are_split(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 37).cast("int")).alias("text"))
    place = lambda df: {r["doc_id"]: r["virtual_slot"] for r in S.sharded(df).collect()}
    assert place(rows) == place(rows.withColumn("text", F.concat("text", F.lit(" edited"))))
    # one id has a third of all rows
    hot = rows.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, -5).otherwise(F.col("doc_id"))).withColumn("text", F.concat("text", F.lit(" "), F.expr("uuid()").substr(1, 6)))
    hot.write.parquet(str(tmp_path / "rows"))
    hot = spark.read.parquet(str(tmp_path / "rows"))
    maps = str(tmp_path / "map")
    for _ in range(2):
        found = S.sharded(hot, maps=maps).collect()
        held = defaultdict(int)
        for r in found:
            held[r["shard"]] += r["size"]
        assert len(found) == 6000 and set(held) == set(range(16)) and max(held.values()) - min(held.values()) < 0.02 * max(held.values())
        assert {r["map_version"] for r in found} == {1}
        places = defaultdict(list)
        for r in found:
            places[r["shard"]].append(r["slot"])
        assert all(sorted(x) == list(range(len(x))) for x in places.values())
    assert S.stored_map(spark, maps)[-1]["owner"].count(S.SPLIT) == 1


def test_map_is_stored(spark):
    versions = S.balanced({3: (2, 50)}, 8, 2)
    assert S.read_map(S.map_table(spark, versions)) == versions


def test_odd_tables(spark, docs, empty):
    assert S.sharded(empty).count() == 0
    clash = docs.withColumn("slot", F.lit("mine")).withColumn("shard", F.lit("mine"))
    found = S.sharded(clash)
    assert found.count() == docs.count() and dict(found.dtypes)["shard"] == "int"


def test_the_query_stores_its_map(spark, folder, tmp_path):
    maps = str(tmp_path / "map")
    spark.conf.set("spark.abacusflow.shardMap", maps)
    try:
        found = S.op3_sharding(spark, folder).collect()
    finally:
        spark.conf.unset("spark.abacusflow.shardMap")
    (one,) = S.stored_map(spark, maps)
    assert one["version"] == 1 and all(one["owner"][r["virtual_slot"]] == r["shard"] for r in found)
    assert S.map_folder(spark) != S.map_folder(spark)


def test_a_later_run_edits_the_stored_map(spark, tmp_path):
    maps = str(tmp_path / "map")
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 37).cast("int")).alias("text"))
    for shards in (16, 17, 17):
        found = S.sharded(many, shards=shards, maps=maps).collect()
        newest = S.stored_map(spark, maps)[-1]
        assert {r["map_version"] for r in found} == {newest["version"]}
        assert all(newest["owner"][r["virtual_slot"]] == r["shard"] for r in found)
    versions = S.stored_map(spark, maps)
    assert [(v["version"], v["shards"]) for v in versions][:2] == [(1, 16), (2, 17)]
    moved = sum(a != b for a, b in zip(versions[0]["owner"], versions[1]["owner"], strict=True))
    # a map dealt anew would move nearly all of them
    assert 0 < moved < S.SLOTS / 2
