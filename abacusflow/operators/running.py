"""Running values over long histories, without sorting a whole key in one task.

One account may hold a third of all rows. A history is split into cells by an
ordered column (such as the month); running values are those within the cell
plus what earlier cells come to, which is a window over one row per key and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def _joined(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    named = cells.select(*[F.col(k).alias(f"_cell_{n}") for n, k in enumerate(keys)], *[c for c in cells.columns if c not in keys])
    on = None
    for n, k in enumerate(keys):
        same = rows[k].eqNullSafe(named[f"_cell_{n}"])
        on = same if on is None else on & same
    return rows.join(named, on, "left").drop(*[f"_cell_{n}" for n in range(len(keys))])


def running(rows: DataFrame, keys: list[str], cell: str, order: list, columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running aggregates, this row included: name -> ("sum" | "max" | "min", expression). ``order`` must be total within a cell."""
    for name, (_, value) in columns.items():
        rows = rows.withColumn(f"_of_{name}", value)
    cells = rows.groupBy(*keys, cell).agg(*[_AGGREGATES[kind](f"_of_{name}").alias(f"_in_{name}") for name, (kind, _) in columns.items()])
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, cell, *[_AGGREGATES[kind](f"_in_{name}").over(earlier).alias(f"_before_{name}") for name, (kind, _) in columns.items()])
    here = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for name, (kind, _) in columns.items():
        rows = rows.withColumn(name, _AGGREGATES[kind](f"_of_{name}").over(here))
    rows = _joined(rows, cells, [*keys, cell])
    for name, (kind, _) in columns.items():
        both = {"sum": F.col(name) + F.coalesce(f"_before_{name}", F.lit(0)), "max": F.greatest(name, f"_before_{name}"), "min": F.least(name, f"_before_{name}")}[kind]
        rows = rows.withColumn(name, both).drop(f"_before_{name}", f"_of_{name}")
    return rows


def previous_known(rows: DataFrame, keys: list[str], cell: str, order: list, value: str, name: str = "previous") -> DataFrame:
    """Add the last value before this row that is not null."""
    last = F.max_by(value, F.struct(*order))
    cells = rows.where(F.col(value).isNotNull()).groupBy(*keys, cell).agg(last.alias("_last"))
    spine = rows.select(*keys, cell).distinct()
    cells = _joined(spine, cells, [*keys, cell])
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, cell, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    here = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(name, F.last(value, ignorenulls=True).over(here))
    return _joined(rows, cells, [*keys, cell]).withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


def numbered(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Add each row's number (from 1) within its key, in a total order. Rows are dealt by ranges of key and order, so a key of any size is as many tasks as it has ranges; a number is that within the range and the rows of the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = _joined(dealt.withColumn("_here", here), sizes, [*keys, "_range"])
    return out.withColumn(name, (F.col("_before") + F.col("_here")).cast("long")).drop("_range", "_here", "_before")
