"""First-in first-out lots as intervals of cumulative quantities.

An exit takes the units that entered first: with running totals of what came in
and of what went out, lot and exit meet where their intervals overlap. An exit
beyond what is there loses the uncovered part, so running exits are lowered by
the largest excess so far. No queue, no row loop.

Rows: keys, a cell for long histories, an order, ``entry`` and ``exit``
quantities (decimals, one of them 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import previous_known, running

UNITS = "decimal(28,6)"


def intervals(rows: DataFrame, keys: list[str], cell: str, order: list[str], entry: str = "entry", leave: str = "exit") -> DataFrame:
    """Add in_total, out_total and lost_total (running), and covered_to: the units that exits have taken so far."""
    zero = F.lit(0).cast(UNITS)
    rows = running(rows, keys, cell, order, {"in_total": ("sum", F.col(entry).cast(UNITS)), "out_total": ("sum", F.col(leave).cast(UNITS))})
    rows = running(rows, keys, cell, order, {"lost_total": ("max", F.greatest(zero, F.col("out_total") - F.col("in_total")))})
    return rows.withColumn("covered_to", F.col("out_total") - F.col("lost_total"))


def applications(rows: DataFrame, keys: list[str], cell: str, order: list[str], entry: str = "entry", leave: str = "exit", lot_columns: tuple[str, ...] = (), exit_columns: tuple[str, ...] = (), per_range: int = 32) -> DataFrame:
    """(keys, lot, exit_row, quantity): which exit takes how much of which lot; ``lot`` and ``exit_row`` hold the order and the columns asked for.

    Overlaps are found by an equi-join: the units of a key are cut into equal
    ranges, one for every ``per_range`` rows of the key, and only intervals in the
    same range meet. Lots and exits each cover the units once, so they fall into
    as many ranges as there are rows and ranges together.
    """
    placed = intervals(rows, keys, cell, order, entry, leave)
    totals = placed.groupBy(*keys).agg(F.max("in_total").alias("_all"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_range)).cast("int").alias("_ranges"))
    placed = placed.join(totals, keys).where("_all > 0")
    exits = placed.where(F.col(leave) > 0).withColumnRenamed("covered_to", "_to")
    part = lambda x: F.least(F.col("_ranges") - 1, F.floor(x * F.col("_ranges") / F.col("_all"))).cast("int")
    lots = placed.where(F.col(entry) > 0).select(*keys, F.struct(*order, *lot_columns).alias("lot"), (F.col("in_total") - F.col(entry)).alias("_lot_from"), F.col("in_total").alias("_lot_to"), "_all", "_ranges")
    lots = lots.withColumn("_part", F.explode(F.sequence(part(F.col("_lot_from")), part(F.col("_lot_to"))))).drop("_all", "_ranges")
    # what an exit covers ends at its running total, and starts where that of the exit before ended
    exits = previous_known(exits, keys, cell, order, "_to", "_from").withColumn("_from", F.coalesce("_from", F.lit(0).cast(UNITS)))
    outs = exits.where("_to > _from").select(*keys, F.struct(*order, *exit_columns).alias("exit_row"), F.col("_from").alias("_exit_from"), F.col("_to").alias("_exit_to"), F.explode(F.sequence(part(F.col("_from")), part(F.col("_to")))).alias("_part"))
    met = lots.join(outs, [*keys, "_part"]).where("_lot_from < _exit_to and _exit_from < _lot_to")
    start = F.greatest("_lot_from", "_exit_from")
    all_of = met.withColumn("quantity", (F.least("_lot_to", "_exit_to") - start).cast(UNITS))
    return all_of.select(*keys, "lot", "exit_row", "quantity").distinct()


def slices(rows: DataFrame, keys: list[str], cell: str, order: list[str], cost: str, price: str, amount: str, entry: str = "entry", leave: str = "exit") -> DataFrame:
    """Applications with ``lot_cost``, ``price``, ``cost`` and ``interest`` (price less cost a unit, of the slice) and ``amount``, in cents.

    Amounts are quantity times price; an exit's last slice takes what is left of the exit's own amount.
    """
    found = applications(rows, keys, cell, order, entry, leave, (cost,), (price, amount))
    cents = lambda c: F.round(c.cast("decimal(38,8)"), 2).cast("decimal(18,2)")
    found = found.withColumns({"lot_cost": F.col(f"lot.{cost}"), "price": F.col(f"exit_row.{price}")})
    found = found.withColumns({"cost": cents(F.col("quantity") * F.col("lot_cost")), "interest": cents(F.col("quantity") * (F.col("price") - F.col("lot_cost"))), "_plain": cents(F.col("quantity") * F.col("price"))})
    last = found.groupBy(*keys, "exit_row").agg(F.max("lot").alias("_last"), F.sum("_plain").alias("_sum"))
    found = found.join(last, [*keys, "exit_row"])
    rest = (F.col(f"exit_row.{amount}") - (F.col("_sum") - F.col("_plain"))).cast("decimal(18,2)")
    return found.withColumn("amount", F.when(F.col("lot") == F.col("_last"), rest).otherwise(F.col("_plain"))).drop("_plain", "_sum", "_last")


def exit_results(rows: DataFrame, keys: list[str], cell: str, order: list[str], cost: str, price: str, amount: str, entry: str = "entry", leave: str = "exit") -> DataFrame:
    """Every exit with ``covered`` units, their ``cost``, ``interest`` over the lots' unit values, ``result`` and ``state``.

    The result is the exit's amount, in the share that is covered, less cost;
    ``full_result`` charges the full amount even where units are missing.
    State: SALIDA, or SIN_STOCK where units are missing.
    """
    found = applications(rows, keys, cell, order, entry, leave, (cost,), (price,))
    exact = lambda c: F.sum(c.cast("decimal(38,8)"))
    told = found.groupBy(*keys, *[F.col(f"exit_row.{c}").alias(c) for c in order]).agg(
        F.sum("quantity").alias("covered"), exact(F.col("quantity") * F.col(f"lot.{cost}")).alias("_cost"), exact(F.col("quantity") * (F.col(f"exit_row.{price}") - F.col(f"lot.{cost}"))).alias("_interest")
    )
    cents = lambda c: F.round(F.coalesce(c, F.lit(0)).cast("decimal(38,8)"), 2).cast("decimal(18,2)")
    exits = rows.where(F.col(leave) > 0).select(*keys, *order, F.col(leave).alias("_leave"), F.col(price).alias("price"), F.col(amount).alias("_amount")).join(told, [*keys, *order], "left")
    exits = exits.withColumn("covered", F.coalesce("covered", F.lit(0)).cast(UNITS))
    applied = F.when(F.col("covered") < F.col("_leave"), cents(F.col("_amount") * F.col("covered") / F.col("_leave"))).otherwise(F.col("_amount"))
    return exits.select(
        *keys,
        *order,
        "covered",
        cents(F.col("_cost")).alias("cost"),
        F.round(F.try_divide(F.col("_cost"), F.col("covered")).cast("decimal(38,10)"), 6).cast("decimal(18,6)").alias("average_cost"),
        cents(F.col("_interest")).alias("interest"),
        F.when(F.col("covered") > 0, cents(applied - F.col("_cost"))).otherwise(F.lit(0)).cast("decimal(18,2)").alias("result"),
        (F.col("_amount") - cents(F.col("_cost"))).cast("decimal(18,2)").alias("full_result"),
        F.when(F.col("covered") < F.col("_leave"), "SIN_STOCK").otherwise("SALIDA").alias("state"),
    )


def open_lots(rows: DataFrame, keys: list[str], cell: str, order: list[str], entry: str = "entry", leave: str = "exit") -> DataFrame:
    """The lots that have units left, with ``left``."""
    placed = intervals(rows, keys, cell, order, entry, leave)
    used = placed.groupBy(*keys).agg(F.max(F.when(F.col(leave) > 0, F.col("covered_to"))).alias("_used"))
    lots = placed.where(F.col(entry) > 0).join(used, keys)
    left = F.greatest(F.lit(0).cast(UNITS), F.least(F.col(entry).cast(UNITS), F.col("in_total") - F.coalesce("_used", F.lit(0).cast(UNITS))))
    return lots.withColumn("left", left.cast(UNITS)).where("left > 0").drop("_used", "in_total", "out_total", "lost_total", "covered_to")


def consolidated(lots: DataFrame, keys: list[str], day: str, cost: str, origin: str) -> DataFrame:
    """Open lots of one day, unit value (to 8 decimals) and origin as one: ``units`` to 4 decimals, ``cost`` in cents."""
    unit = F.round(F.col(cost).cast("decimal(28,10)"), 8).cast("decimal(28,8)")
    out = lots.groupBy(*keys, day, unit.alias("unit_value"), origin).agg(F.sum("left").alias("_units"), F.sum((F.col("left") * F.col(cost)).cast("decimal(38,8)")).alias("_cost"))
    return out.select(*keys, day, "unit_value", origin, F.round("_units", 4).cast("decimal(28,4)").alias("units"), F.round("_cost", 2).cast("decimal(18,2)").alias("cost"))


def holding_result(lots: DataFrame, keys: list[str], closing: Column) -> DataFrame:
    """Per key the consolidated lots' units and cost, their value at the closing unit value, and value less cost."""
    out = lots.groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("cost").alias("cost"))
    out = out.withColumn("value", F.round((F.col("units") * closing).cast("decimal(38,8)"), 2).cast("decimal(18,2)"))
    return out.withColumn("result", (F.col("value") - F.col("cost")).cast("decimal(18,2)"))


def positions(rows: DataFrame, keys: list[str], cell: str, order: list[str], cost: str, entry: str = "entry", leave: str = "exit") -> DataFrame:
    """Per key: units left, their cost (``cost`` is per unit), the average, and how many lots are open."""
    placed = intervals(rows, keys, cell, order, entry, leave)
    used = placed.groupBy(*keys).agg(F.max(F.when(F.col(leave) > 0, F.col("covered_to"))).alias("_used"))
    lots = placed.where(F.col(entry) > 0).join(used, keys)
    left = F.greatest(F.lit(0).cast(UNITS), F.least(F.col(entry).cast(UNITS), F.col("in_total") - F.coalesce("_used", F.lit(0).cast(UNITS))))
    lots = lots.withColumn("_left", left)
    out = lots.groupBy(*keys).agg(F.sum("_left").alias("units"), F.sum((F.col("_left") * F.col(cost)).cast("decimal(28,6)")).alias("_cost"), F.count(F.when(F.col("_left") > 0, 1)).alias("open_lots"))
    return out.select(*keys, F.col("units").cast(UNITS).alias("units"), F.round("_cost", 2).cast("decimal(18,2)").alias("cost"), F.round(F.try_divide(F.col("_cost").cast("double"), F.col("units").cast("double")), 6).alias("average_cost"), "open_lots")
