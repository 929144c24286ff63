"""Summaries: totals by category, control of reported against computed, calendars, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY


def by_category(rows: DataFrame, category: str, credit: str, debit: str, total: str = "TOTAL", missing: str = "(sin categoría)") -> DataFrame:
    """count, credits, debits and net per category, and a total row."""
    named = rows.withColumn(category, F.coalesce(category, F.lit(missing)))
    out = named.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.sum(credit).cast(MONEY).alias("credits"), F.sum(debit).cast(MONEY).alias("debits"), F.grouping(category).alias("_total"))
    out = out.withColumn(category, F.when(F.col("_total") == 1, total).otherwise(F.col(category))).drop("_total")
    return out.withColumn("net", (F.col("credits") - F.col("debits")).cast(MONEY))


def in_sets(rows: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Several groupings in one pass; a column that a grouping leaves out is null there, and ``level`` tells them apart."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*aggregates, F.grouping_id().alias("level"))


def control(rows: DataFrame, keys: list[str], reported: dict[str, str], computed: dict[str, Column], tolerance: float = 0.01) -> DataFrame:
    """Per key each reported figure (a column that repeats), what the rows add up to, and OK or DIFFERENCE."""
    out = rows.groupBy(*keys).agg(*[F.max(c).alias(f"{n}_reported") for n, c in reported.items()], *[c.alias(f"{n}_computed") for n, c in computed.items()])
    off = F.greatest(*[F.abs(F.col(f"{n}_reported") - F.col(f"{n}_computed")) for n in reported], F.lit(0))
    return out.withColumn("state", F.when(off <= tolerance, "OK").otherwise("DIFFERENCE"))


def compare_periods(one: DataFrame, two: DataFrame, keys: list[str], period: str, value: str, tolerance: float = 1.0) -> DataFrame:
    """Month by month from the first to the last of a key: both values, their difference, and OK, ERROR, MISSING_ONE, MISSING_TWO or MISSING_BOTH."""
    sums = [d.groupBy(*keys, F.trunc(period, "MM").alias("period")).agg(F.sum(value).alias(n)) for d, n in ((one, "one"), (two, "two"))]
    ends = sums[0].select(*keys, "period").unionByName(sums[1].select(*keys, "period")).groupBy(*keys).agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
    spine = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("period"))
    out = spine.join(sums[0], [*keys, "period"], "left").join(sums[1], [*keys, "period"], "left")
    state = (
        F.when(F.col("one").isNull() & F.col("two").isNull(), "MISSING_BOTH")
        .when(F.col("one").isNull(), "MISSING_ONE")
        .when(F.col("two").isNull(), "MISSING_TWO")
        .when(F.abs(F.col("one") - F.col("two")) <= tolerance, "OK")
        .otherwise("ERROR")
    )
    return out.withColumn("state", state)


def month_grid(rows: DataFrame, concept: str, month_number: str, value: str, before: DataFrame | None = None) -> DataFrame:
    """A row per concept, columns m1 to m12; months without rows keep the grid from before."""
    grid = rows.groupBy(concept).pivot(month_number, list(range(1, 13))).agg(F.sum(value))
    grid = grid.select(concept, *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])
    if before is None:
        return grid
    loaded = rows.select(F.collect_set(month_number).alias("_loaded")).first()[0]  # twelve at most
    both = grid.alias("g").join(before.alias("b"), concept, "full")
    return both.select(concept, *[F.col(f"{'g' if m in loaded else 'b'}.m{m}").alias(f"m{m}") for m in range(1, 13)])


def missing_months(rows: DataFrame, keys: list[str], day: str, first: str, last: str) -> DataFrame:
    """Months from first to last ("yyyy-MM-dd") in which a key has no row."""
    spine = rows.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month"))
    return spine.join(rows.select(*keys, F.trunc(day, "MM").alias("month")).distinct(), [*keys, "month"], "left_anti")


def share_of(part: Column, whole: Column) -> Column:
    """Percent, null where the whole is 0."""
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), 4)


def from_grid(grid: DataFrame, concept: str, parts: dict[str, list[str]]) -> DataFrame:
    """(month, a column per part) from a grid of m1 to m12: each part sums some concepts of a month; months without any value are left out."""
    months = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.col(f"m{m}").alias("v")) for m in range(1, 13)]))
    rows = grid.select(concept, months.alias("_m")).select(concept, "_m.month", "_m.v").where("v is not null")
    return rows.groupBy("month").agg(*[F.coalesce(F.sum(F.when(F.col(concept).isin(*names), F.col("v"))), F.lit(0)).cast(MONEY).alias(n) for n, names in parts.items()])


def suggested_balances(paid: DataFrame, opening: DataFrame, bank: str, capital: str, balance: str) -> DataFrame:
    """Per bank the capital paid back and what should be left of its opening balance, never below 0."""
    sums = paid.groupBy(bank).agg(F.sum(capital).cast(MONEY).alias("paid"))
    out = sums.join(opening.select(bank, F.col(balance).alias("opening")), bank, "left")
    return out.withColumn("left", F.when(F.col("opening").isNotNull(), F.greatest(F.lit(0).cast(MONEY), F.col("opening") - F.col("paid")).cast(MONEY)))


def wanted_rows(label: Column, deny: str, allow: str) -> Column:
    """Whether a row of balances counts: its label is no total, footer or control line, or is allowed all the same."""
    from ..functions.text import fold

    told = fold(label)
    return (told != "") & (~told.rlike(deny) | told.rlike(allow))
