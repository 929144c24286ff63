"""Removing repeated rows by key, sampling by strata, unique names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import running


def keep_one(rows: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """Of the rows with equal keys (nulls are equal) the last or the first by order; combined before the shuffle, so a busy key is no large group."""
    pick = F.max if last else F.min
    place = F.struct(*[F.col(c) for c in order], F.struct(*[c for c in rows.columns if c not in order]).alias("_rest"))
    packed = rows.groupBy(*[F.col(k).alias(f"_key_{n}") for n, k in enumerate(keys)]).agg(pick(place).alias("_p"))
    return packed.select(*[F.col(f"_p.{c}") if c in order else F.col(f"_p._rest.{c}") for c in rows.columns])


def sample_strata(rows: DataFrame, stratum: str, quota: int, order: list[str]) -> DataFrame:
    """The first ``quota`` rows of every stratum by order."""
    w = Window.partitionBy(stratum).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= quota).drop("_rank")


def unique_names(rows: DataFrame, name: str, order: list[str], cell: str | None = None) -> DataFrame:
    """Add ``unique_name``: the first keeps its name, others get " (2)", " (3)" and so on. ``cell``, a column that never falls in the order, cuts a name of very many rows."""
    if cell:
        rows = running(rows, [name], cell, order, {"_k": ("sum", F.lit(1))})
    else:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy(*order)))
    return rows.withColumn("unique_name", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(name, F.lit(" ("), F.col("_k").cast("string"), F.lit(")")))).drop("_k")
