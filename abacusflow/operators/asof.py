"""As-of join: the value in force at a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(probes: DataFrame, quotes: DataFrame, at: str, quote_at: str, value: str, keys: list[str] | None = None, name: str = "value") -> DataFrame:
    """Add the quote on or before each probe's date; before the series starts, its first quote. Of several quotes on a date the largest counts.

    Only the distinct dates of a key are put in order, in month cells; probes get
    the answer by an equi-join on the date, so a busy key or day is no large group.
    """
    keys = keys or []
    per_day = quotes.groupBy(*keys, F.col(quote_at).alias("_at")).agg(F.max(value).alias("_quote"))
    days = probes.select(*keys, F.col(at).alias("_at")).where("_at is not null").distinct()
    spine = days.join(per_day, [*keys, "_at"], "full").withColumn("_cell", F.trunc("_at", "MM"))
    here = Window.partitionBy(*keys, "_cell").orderBy("_at")
    cells = spine.where("_quote is not null").groupBy(*keys, "_cell").agg(F.max_by("_quote", "_at").alias("_last"))
    cells = spine.select(*keys, "_cell").distinct().join(cells, [*keys, "_cell"], "left")
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*keys, "_cell", carried.alias("_carried"))
    first = per_day.groupBy(*keys).agg(F.min_by("_quote", "_at").alias("_first"))
    found = spine.withColumn("_found", F.last("_quote", ignorenulls=True).over(here)).join(cells, [*keys, "_cell"])
    found = found.join(first, keys, "left") if keys else found.crossJoin(F.broadcast(first))  # one row
    answer = found.select(*keys, F.col("_at").alias(at), F.coalesce("_found", "_carried", "_first").alias(name))
    return probes.join(answer, [*keys, at], "left")
