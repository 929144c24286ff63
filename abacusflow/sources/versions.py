"""Tables by key that are written in versions: a stream's batches are merged in once, readers see whole versions.

A table is cut into buckets by its keys. A version's data are the buckets that it
has touched; its manifest says for every bucket in which version's folder it is.
A version counts from the moment its manifest is complete, so a batch that fails on
the way changes nothing and is written again. A batch whose version is there has
been merged and is skipped: replays do no harm. A batch rewrites only the
buckets that it has rows for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import upserted

BUCKETS = 64


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of the shared store; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions of a table, in order (a number for each)."""
    names = [n for n in _listed(spark, f"{folder}/manifests") if n.startswith("v")]
    return sorted(int(n[1:]) for n in names if "_SUCCESS" in _listed(spark, f"{folder}/manifests/{n}"))


def _manifest(spark: SparkSession, folder: str, version: int | None) -> dict[int, int]:
    """Which version's folder each bucket is in: a row per bucket."""
    if version is None:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{folder}/manifests/v{version}").collect()}


def _read(spark: SparkSession, folder: str, places: dict[int, int], schema) -> DataFrame:
    paths = [f"{folder}/data/v{v}/bucket={b}" for b, v in sorted(places.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, folder: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last; no version yet: no rows."""
    there = versions(spark, folder)
    if version is not None and version not in there:
        raise ValueError(f"there is no version {version}; there are {there}")
    return _read(spark, folder, _manifest(spark, folder, version if version is not None else (there or [None])[-1]), schema)


def merge_batch(batch: DataFrame, number: int, folder: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> bool:
    """Merge a batch in as version ``number``: of its rows of a key the last by order replaces what the table has. False if that version, or a later one, is there already."""
    spark = batch.sparkSession
    there = versions(spark, folder)
    if there and there[-1] >= number:
        return False
    last = F.max_by(F.struct(*batch.columns), F.struct(*order, F.xxhash64(*batch.columns)))
    new = batch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(last.alias("_r")).select("_r.*")
    new = new.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    now = _manifest(spark, folder, there[-1] if there else None)
    touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
    old = _read(spark, folder, {b: v for b, v in now.items() if b in touched}, batch.schema)
    old = old.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    merged = upserted(old, new, keys)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/v{number}")
    places = now | {b: number for b in touched}
    spark.createDataFrame(sorted(places.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/v{number}")
    return True


def merging(folder: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: merge every batch in under its own number."""

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, folder, keys, order, buckets)

    return write


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete manifests of all but the last ``keep`` versions, and the data of versions that none of these refers to; returns the versions whose data went."""
    there = versions(spark, folder)
    if not there:
        return []
    kept = there[-keep:]
    used = {v for k in kept for v in _manifest(spark, folder, k).values()}
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    delete = lambda name: files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    for v in there[:-keep]:
        delete(f"manifests/v{v}")
    gone = [v for v in sorted(int(n[1:]) for n in _listed(spark, f"{folder}/data") if n.startswith("v")) if v not in used and v <= there[-1]]
    for v in gone:
        delete(f"data/v{v}")
    return gone
