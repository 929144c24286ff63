"""Ledgers with running balances: validation, repair, monthly control.

Rows: an account, a date, an order within it, a signed amount and a balance that
may be missing. ``cell`` splits long histories, see ``running``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .running import previous_known

TOLERANCE = 0.05


def validate(rows: DataFrame, keys: list[str], cell: str, order: list[str], amount: str, balance: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Per account: rows, failures, and the first row whose balance is not the previous one plus its amount; the first row is the anchor."""
    known = previous_known(rows, keys, cell, order, balance, "_previous")
    bad = F.abs(F.col("_previous") + F.coalesce(amount, F.lit(0)) - F.col(balance)) > tolerance
    place = F.struct(*order)
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(bad, 1)).alias("n_bad"), F.min(F.when(bad, place)).alias("first_bad"))


def repair_chain(rows: DataFrame, keys: list[str], cell: str, order: list[str], amount: str, balance: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``repaired``: where balances are known, they decide.

    The first balance keeps its amount (or 0); a later row's amount becomes the
    change of the balance if they differ by more than the tolerance, 0 if the
    balance stays; rows without a balance keep their amount.
    """
    known = previous_known(rows, keys, cell, order, balance, "_previous")
    change = F.col(balance) - F.col("_previous")
    fixed = (
        F.when(F.col(balance).isNull(), F.col(amount))
        .when(F.col("_previous").isNull(), F.coalesce(amount, F.lit(0).cast("decimal(18,2)")))
        .when(F.abs(change) < 0.005, F.lit(0).cast("decimal(18,2)"))
        .when(F.col(amount).isNull() | (F.abs(F.col(amount) - change) > tolerance), change)
        .otherwise(F.col(amount))
    )
    return known.withColumn("repaired", fixed.cast("decimal(18,2)")).drop("_previous")


def monthly_control(rows: DataFrame, keys: list[str], month: str, order: list[str], amount: str, balance: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Per account and month: opening, credits, debits, closing, what closing should be, and OK or ERROR; a month without balances is an ERROR."""
    place = F.struct(*order)
    has = F.col(balance).isNotNull()
    money = lambda c: c.cast("decimal(18,2)")
    out = rows.groupBy(*keys, month).agg(
        F.min_by(F.when(has, F.col(balance) - F.coalesce(amount, F.lit(0))), F.when(has, place)).alias("opening"),
        F.sum(F.when(F.col(amount) > 0, F.col(amount)).otherwise(0)).alias("credits"),
        F.sum(F.when(F.col(amount) < 0, -F.col(amount)).otherwise(0)).alias("debits"),
        F.max_by(F.when(has, F.col(balance)), F.when(has, place)).alias("closing"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    out = out.withColumn("computed", F.col("opening") + F.col("credits") - F.col("debits")).withColumn("difference", F.col("closing") - F.col("computed"))
    out = out.select(*keys, month, *[money(F.col(c)).alias(c) for c in ("opening", "credits", "debits", "closing", "computed", "difference")], "n_rows")
    return out.withColumn("state", F.when(F.abs("difference") <= tolerance, "OK").otherwise("ERROR"))


def continuity(control: DataFrame, keys: list[str], month: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``gap``: opening minus the closing of the month before, where that is there and of the same year; a gap beyond the tolerance makes the month an ERROR."""
    w = Window.partitionBy(*keys).orderBy(month)
    next_to = (F.lag(month).over(w) == F.add_months(month, -1)) & (F.month(month) > 1)
    out = control.withColumn("gap", F.when(next_to, F.col("opening") - F.lag("closing").over(w)).cast("decimal(18,2)"))
    return out.withColumn("state", F.when(F.abs("gap") > tolerance, "ERROR").otherwise(F.col("state")))


def reinforce(control: DataFrame, keys: list[str], month: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Take the closing of the month before as the opening, and judge again."""
    before = F.lag("closing").over(Window.partitionBy(*keys).orderBy(month))
    out = control.withColumn("opening", F.coalesce(before, "opening"))
    out = out.withColumn("computed", (F.col("opening") + F.col("credits") - F.col("debits")).cast("decimal(18,2)")).withColumn("difference", (F.col("closing") - F.col("computed")).cast("decimal(18,2)"))
    return out.withColumn("state", F.when(F.abs("difference") <= tolerance, "OK").otherwise("ERROR"))


def bridges(control: DataFrame, keys: list[str], month: str) -> DataFrame:
    """For months that are missing between two: one movement from the closing before to the opening after, flagged."""
    w = Window.partitionBy(*keys).orderBy(month)
    after = control.select(*keys, F.col(month).alias("after_month"), F.lead(month).over(w).alias("before_month"), (F.lead("opening").over(w) - F.col("closing")).cast("decimal(18,2)").alias("amount"))
    return after.where(F.col("before_month") > F.add_months("after_month", 1)).withColumn("bridge", F.lit(True))


def collapse_repeats(rows: DataFrame, keys: list[str], order: list[str], concept: str, amount: str, tolerance: float = 0.02) -> DataFrame:
    """Per group an array ``kept`` of (order, concept, amount) without rows that repeat the last kept one: same concept, amount less than the tolerance away.

    A group is one document's lines.
    """
    item = F.struct(F.struct(*order).alias("at"), F.col(concept).alias("concept"), F.col(amount).alias("amount"))
    gathered = F.sort_array(F.collect_list(item))
    last = lambda acc: F.element_at(acc, -1)
    repeats = lambda acc, x: (F.size(acc) > 0) & last(acc)["concept"].eqNullSafe(x["concept"]) & (F.abs(last(acc)["amount"] - x["amount"]) < tolerance)
    packed = rows.groupBy(*keys).agg(gathered.alias("_rows"))
    return packed.select(*keys, F.aggregate("_rows", F.slice("_rows", 1, 0), lambda acc, x: F.when(repeats(acc, x), acc).otherwise(F.array_append(acc, x))).alias("kept"))
