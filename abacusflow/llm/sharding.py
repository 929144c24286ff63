"""Sharding by fixed virtual slots.

Records are hashed by their id into thousands of virtual slots, once and for all,
so that an edited text stays where it is; bytes are added up per slot, and a small
map says which shard owns each slot. The map is versioned and stored: balancing
adds a version that moves as few slots as it can to the stored map, and records
never need to be hashed again. The Spark setting ``spark.abacusflow.shardMap``
names the map's folder, for runs that edit the map of an earlier one; else a run
starts a map in the shared folder. The driver handles the map and the per-slot
totals (as many rows as there are slots, a parameter), never records.

A slot with over ``HOT`` times the mean slot's bytes is one id's, or a long
text's. The map marks it as split (shard -1), from then on, and its records are
dealt to the other slots by id and text.

The law that shards keep is `bytes`: their sizes are near equal. A slot is the
smallest thing that moves, so shards differ by about one slot's bytes at most.

Defined cases: a null text has no bytes, a row weighs its bytes plus 1; rows
with equal texts or equal ids are each placed; rows without an id are hashed by
their text; an empty table yields an even map and no rows. Input columns named
like a result column are replaced.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder, table

SLOTS = 4096
SHARDS = 16
#: Times the mean slot's bytes from which a slot is split.
HOT = 16
SPLIT = -1
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def virtual_slot(key: str, text: str, slots: int, split: list[int] | None = None) -> Column:
    """A record's slot, by its id (by its text where it has none); records of split slots are dealt to the others by both."""
    home = F.pmod(F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(text)), F.lit(slots)).cast("int")
    if not split:
        return home
    whole = F.array(*[F.lit(s) for s in range(slots) if s not in set(split)])
    return F.when(home.isin(*split), F.get(whole, F.pmod(F.xxhash64(key, text), F.lit(slots - len(set(split)))).cast("int"))).otherwise(home)


def hot_slots(load: dict[int, tuple[int, int]], slots: int) -> list[int]:
    """Slots that weigh over ``HOT`` times the mean, while others are left to take what they hold."""
    mean = sum(b for _, b in load.values()) / slots
    found = sorted((s for s, (n, b) in load.items() if b > HOT * mean and n > HOT), key=lambda s: -load[s][1])
    return sorted(found[: slots // 2])


def balanced(load: dict[int, tuple[int, int]], slots: int, shards: int, before: list[dict] | None = None, split: list[int] | None = None) -> list[dict]:
    """Versions of the slot map, the last of them new: slot -> shard, near equal in bytes.

    ``load``: slot -> (rows, bytes). Without an earlier version, heavy slots are
    dealt first, each to the shard with the fewest bytes so far. With one, slots
    stay where they are unless their shard is gone or too full; those are dealt
    in the same way.
    """
    versions = list(before or [])
    weight = {s: load.get(s, (0, 0))[1] for s in range(slots)}
    owner: dict[int, int] = dict.fromkeys(split or [], SPLIT)
    held = dict.fromkeys(range(shards), 0)
    fair = sum(weight.values()) / shards
    heavy_first = sorted(weight, key=lambda s: (-weight[s], s))
    if versions:
        old = versions[-1]["owner"]
        for s in heavy_first:
            if s not in owner and 0 <= old[s] < shards and held[old[s]] + weight[s] / 2 <= fair:
                owner[s] = old[s]
                held[old[s]] += weight[s]
    free = [(b, k) for k, b in held.items()]
    heapq.heapify(free)
    for s in heavy_first:
        if s not in owner:
            b, k = heapq.heappop(free)
            owner[s] = k
            heapq.heappush(free, (b + weight[s], k))
    return [*versions, {"version": len(versions) + 1, "shards": shards, "owner": [owner[s] for s in range(slots)]}]


def map_table(spark: SparkSession, versions: list[dict]) -> DataFrame:
    """The versions as a table (version, shards, virtual_slot, shard), to be stored beside the shards."""
    rows = [(v["version"], v["shards"], s, k) for v in versions for s, k in enumerate(v["owner"])]
    return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")


def read_map(stored: DataFrame) -> list[dict]:
    """Versions from such a table (slots x versions rows)."""
    out: dict[int, dict] = {}
    for r in stored.orderBy("version", "virtual_slot").collect():
        out.setdefault(r["version"], {"version": r["version"], "shards": r["shards"], "owner": []})["owner"].append(r["shard"])
    return list(out.values())


def map_folder(spark: SparkSession) -> str:
    """Where the map is: the folder that ``spark.abacusflow.shardMap`` names, else a new one in the shared folder."""
    return spark.conf.get("spark.abacusflow.shardMap", None) or f"{shared_folder(spark)}/shard-map-{uuid.uuid4().hex}"


def stored_map(spark: SparkSession, maps: str) -> list[dict]:
    """The versions in a map's folder; none if there is no such folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(maps)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return read_map(spark.read.schema("version int, shards int, virtual_slot int, shard int").parquet(maps))


def slot_load(slotted: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (rows, bytes): one small row per slot reaches the driver."""
    return {r[0]: (r[1], r[2]) for r in slotted.groupBy("virtual_slot").agg(F.count(F.lit(1)), F.sum("size")).collect()}


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, slots: int = SLOTS, versions: list[dict] | None = None, maps: str | None = None) -> DataFrame:
    """Add size, shard, place in the shard (``slot``, gapless from 0), virtual slot and map version to every row.

    A place is the rows of the shard's earlier virtual slots, from the map, plus
    the place within the virtual slot, so the sort works on thousands of even
    groups whatever the number of shards. ``versions``: an earlier map to edit.
    ``maps``: the folder of a stored map, which is read, edited and gets the new
    version; a version that would equal the last one is not written.
    """
    if maps:
        versions = stored_map(docs.sparkSession, maps)
    if versions and len(versions[-1]["owner"]) != slots:
        raise ValueError(f"the map has {len(versions[-1]['owner'])} slots, not {slots}")
    kept = [c for c in docs.columns if c not in RESULTS or c in (key, text)]
    rows = docs.select(*kept, size_of(text).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    split = [s for s, k in enumerate(versions[-1]["owner"]) if k == SPLIT] if versions else []
    slotted = rows.withColumn("virtual_slot", virtual_slot(key, text, slots, split))
    load = slot_load(slotted)
    hot = hot_slots(load, slots)
    if hot:
        split = sorted({*split, *hot})
        slotted = rows.withColumn("virtual_slot", virtual_slot(key, text, slots, split))
        load = slot_load(slotted)
    newest = balanced(load, slots, shards, versions, split)[-1]
    if maps and versions and all(newest[c] == versions[-1][c] for c in ("shards", "owner")):
        newest = versions[-1]
    elif maps:
        map_table(docs.sparkSession, [newest]).coalesce(1).write.mode("append").parquet(maps)
    first: list[int] = []
    held: dict[int, int] = {}
    for s, k in enumerate(newest["owner"]):
        first.append(held.get(k, 0))
        held[k] = held.get(k, 0) + load.get(s, (0, 0))[0]
    lookup = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("virtual_slot"))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.col(key), F.col("text_crc32"), F.col("size"))) - 1
    return slotted.withColumns(
        {
            "law": F.lit("bytes"),
            "shard": lookup(newest["owner"], "int"),
            "slot": (lookup(first, "bigint") + within).cast("long"),
            "grown_shard": F.lit(None).cast("int"),
            "map_version": F.lit(newest["version"]),
        }
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, and its place there."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return sharded(docs, maps=map_folder(spark)).select("doc_id", *RESULTS)
