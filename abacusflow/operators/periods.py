"""Declared totals against what files add up to, by period; merging extracts without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def declared_match(declared: DataFrame, rows: DataFrame, keys: list[str], period: str, goal: str, amount: str, is_withholding: Column, tolerance: float = 1.0) -> DataFrame:
    """For each declared total which sum of a key's rows meets it: withholdings, perceptions or both, in the same month, else in the month before or after.

    Adds scenario (with _near for a neighbouring month), withheld, perceived; null scenario: none.
    """
    money = "decimal(18,2)"
    sums = rows.withColumn("_w", is_withholding).groupBy(*keys, F.trunc(period, "MM").alias("_month")).agg(
        F.sum(F.when(F.col("_w"), F.col(amount)).otherwise(0)).cast(money).alias("withheld"), F.sum(F.when(F.col("_w"), 0).otherwise(F.col(amount))).cast(money).alias("perceived")
    )
    months = F.array(*[F.struct(F.lit(k).alias("rank"), F.add_months(F.trunc(period, "MM"), d).alias("m")) for k, d in enumerate((0, -1, 1))])
    asked = declared.withColumn("_p", F.explode(months)).withColumn("_month", F.col("_p.m")).withColumn("_rank", F.col("_p.rank")).drop("_p")
    met = asked.join(sums, [*keys, "_month"])
    close = lambda x: F.abs(x - F.col(goal)) <= tolerance
    scenario = F.when(close(F.col("withheld")), "withheld").when(close(F.col("perceived")), "perceived").when(close(F.col("withheld") + F.col("perceived")), "both")
    met = met.withColumn("scenario", F.concat(scenario, F.when(F.col("_rank") > 0, "_near").otherwise(""))).where("scenario is not null")
    best = met.groupBy(*keys, period).agg(F.min_by(F.struct("scenario", "withheld", "perceived"), "_rank").alias("_b"))
    return declared.join(best, [*keys, period], "left").select(*declared.columns, "_b.scenario", "_b.withheld", "_b.perceived")


def merged(old: DataFrame, new: DataFrame, keys: list[str], day: str, amount: str, tolerance: float = 0.02) -> DataFrame:
    """Old rows and those new rows that are not there yet: no old row of the key has their day and amount, and the key's month does not already add up to their amount. Repeated new rows come once."""
    month = lambda c: F.trunc(c, "MM")
    there = new.dropDuplicates([*keys, day, amount]).join(old.select(*keys, day, amount).distinct(), [*keys, day, amount], "left_anti")
    sums = old.groupBy(*keys, month(day).alias("_month")).agg(F.sum(amount).alias("_sum"))
    fresh = there.withColumn("_month", month(day)).join(sums, [*keys, "_month"], "left").where(F.coalesce(F.abs(F.col("_sum") - F.col(amount)) >= tolerance, F.lit(True)))
    return old.unionByName(fresh.select(*old.columns))


def state_priority(has_pending: Column, n_new: Column, n_done: Column) -> Column:
    """One state per client from counts, the most urgent first."""
    return F.when(has_pending, "PENDIENTE").when(n_new > n_done, "NOVEDADES").when(n_done > 0, "LIQUIDADO").otherwise("SIN_DATOS")
