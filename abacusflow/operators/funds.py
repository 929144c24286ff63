"""A fund's years by FIFO, from stored lots to stored lots.

A period starts from the lots that the one before left, each with the day and
unit value it entered at, and hands on those that it leaves: two half-years give
the lots of the whole. The first period starts from what a return declares.

Lots: keys, day, seq, units, unit_value, origin. Movements: keys, day, seq, side
("S" puts units in, "R" takes them out), units, price, amount; (day, seq) is a
total order of a key's rows.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.text import fold
from . import lots

OPENING = "Saldo inicial"
BOUGHT = "Suscripción"
#: The day of lots that were there before all movements.
BEFORE_ALL = datetime.date(1900, 1, 1)
ORDER = ["day", "seq"]


def declared_funds(returns: DataFrame, text: str = "text") -> DataFrame:
    """Add ``funds`` to each return: (name, cost, units) of each block on common investment funds in its text.

    The cost is the amount at the end of the latest year told; the units are the
    first quantity that can be one (a hundred or more, or not whole), as forms
    number their rows in the same column. Blocks without a name or with a cost
    under 10 are no holdings; of one name the first block counts.
    """
    number = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".").cast("decimal(18,6)")
    blocks = F.slice(F.split(F.col(text), "(?i)fondos comunes de inversi[oó]n"), 2, 1 << 30)

    def told(block: Column) -> Column:
        amounts = F.transform(F.regexp_extract_all(block, F.lit(r"(?is)importe al 31/12/(20\d\d.{0,180}?\$\s*[\d.]+,\d\d)"), 1), lambda a: F.struct(F.left(a, F.lit(4)).alias("year"), number(F.regexp_extract(a, r"([\d.]+,\d\d)$", 1)).alias("amount")))
        latest = F.array_max(F.transform(amounts, lambda a: F.struct(a["year"], F.lit(1).alias("k"), a["amount"])))
        quantities = F.transform(F.regexp_extract_all(block, F.lit(r"(?i)(?<!tipo )cantidad(?: nominal)?\D{0,20}?([\d.]+(?:,\d+)?)"), 1), number)
        units = F.get(F.filter(quantities, lambda q: (q >= 100) | ((q >= 1) & (q != F.floor(q)))), F.lit(0))
        name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(block, r"(?i)(fima[^\n]{0,60})", 1), r"\s+", " "), r"[ -]*\d*$", ""))
        return F.struct(name.alias("name"), latest["amount"].cast(MONEY).alias("cost"), units.alias("units"))

    found = F.filter(F.transform(blocks, told), lambda b: (b["name"] != "") & (b["cost"] >= 10))
    first = F.filter(F.transform(found, lambda b, k: F.struct(k.alias("k"), b.alias("b"))), lambda x: ~F.exists(F.slice(found, F.lit(1), x["k"]), lambda y: fold(y["name"]) == fold(x["b"]["name"])))
    return returns.withColumn("funds", F.coalesce(F.transform(first, lambda x: x["b"]), F.array()))


def opening_lots(positions: DataFrame, keys: list[str], units: str, cost: str, value_type: str = "decimal(18,8)") -> tuple[DataFrame, DataFrame]:
    """Lots for declared positions with units, at cost by unit, and the positions without, which are for review and seed no lot."""
    has = F.coalesce(F.col(units) > 0, F.lit(False))
    value = F.round(F.coalesce(F.col(cost), F.lit(0)).cast("decimal(28,10)") / F.col(units).cast("decimal(18,6)"), 6).cast(value_type)
    seeded = positions.where(has).select(*keys, F.lit(BEFORE_ALL).alias("day"), F.lit(0).cast("long").alias("seq"), F.col(units).cast(lots.UNITS).alias("units"), value.alias("unit_value"), F.lit(OPENING).alias("origin"))
    return seeded, positions.where(~has)


def period(moves: DataFrame, opening: DataFrame, keys: list[str], first: Column, last: Column) -> tuple[DataFrame, DataFrame]:
    """(exits, lots) of a period: what each exit of its days made of the lots (as ``lots.exit_results``), and the lots that are left at its end."""
    none = F.lit(None)
    value = opening.schema["unit_value"].dataType.simpleString()
    zero = F.lit(0).cast(lots.UNITS)
    before = opening.select(*keys, *ORDER, F.col("units").cast(lots.UNITS).alias("entry"), zero.alias("exit"), F.col("unit_value").alias("cost"), none.cast(value).alias("price"), none.cast(MONEY).alias("amount"), "origin")
    units, price = F.col("units").cast(lots.UNITS), F.col("price").cast(value)
    own = moves.where((F.col("day") >= first) & (F.col("day") <= last) & (F.col("units") > 0))
    own = own.select(*keys, *ORDER, F.when(F.col("side") == "S", units).otherwise(zero).alias("entry"), F.when(F.col("side") == "R", units).otherwise(zero).alias("exit"), price.alias("cost"), price.alias("price"), F.col("amount").cast(MONEY).alias("amount"), F.lit(BOUGHT).alias("origin"))
    rows = before.unionByName(own).withColumn("_cell", F.trunc("day", "MM"))
    exits = lots.exit_results(rows, keys, "_cell", ORDER, "cost", "price", "amount")
    left = lots.open_lots(rows, keys, "_cell", ORDER)
    return exits, left.select(*keys, *ORDER, F.col("left").alias("units"), F.col("cost").alias("unit_value"), "origin")


def _held(state: DataFrame, keys: list[str], closing: Column) -> DataFrame:
    one = lots.consolidated(state.withColumnRenamed("units", "left"), keys, "day", "unit_value", "origin")
    return lots.holding_result(one, keys, closing)


def control(moves: DataFrame, opening: DataFrame, exits: DataFrame, left: DataFrame, closings: DataFrame, keys: list[str], first: Column, last: Column, value: str, stated: str) -> DataFrame:
    """Per key of ``closings`` (closing unit value, and the valuation that the extract states, null: units times value) the year's equation.

    opening + subscriptions + interest + holding to book - redemptions = valuation,
    where the holding to book is that of the lots plus ``adjustment``, what rounding
    and missing movements leave open.
    """
    inside = moves.where((F.col("day") >= first) & (F.col("day") <= last) & (F.col("units") > 0))
    moved = inside.groupBy(*keys).agg(F.sum(F.when(F.col("side") == "S", F.col("amount"))).alias("subscriptions"), F.sum(F.when(F.col("side") == "R", F.col("amount"))).alias("redemptions"))
    start = _held(opening, keys, F.lit(0)).select(*keys, F.col("cost").alias("opening"))
    interest = exits.groupBy(*keys).agg(F.sum("interest").alias("interest"))
    out = closings.select(*keys, F.col(value).alias("_value"), F.col(stated).alias("_stated"))
    end = left.join(out.select(*keys, "_value"), keys)
    held = lots.consolidated(end.withColumnRenamed("units", "left"), [*keys, "_value"], "day", "unit_value", "origin")
    held = lots.holding_result(held, [*keys, "_value"], F.col("_value")).select(*keys, "units", F.col("value").alias("_valued"), F.col("result").alias("holding"))
    for part in (start, moved, interest, held):
        out = out.join(part, keys, "left")
    money = ("opening", "subscriptions", "redemptions", "interest", "holding")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast(MONEY) for c in money})
    out = out.withColumn("valuation", F.coalesce(F.col("_stated"), F.col("_valued"), F.lit(0)).cast(MONEY))
    out = out.withColumn("adjustment", (F.col("valuation") - (F.col("opening") + F.col("subscriptions") + F.col("interest") + F.col("holding") - F.col("redemptions"))).cast(MONEY))
    return out.select(*keys, F.coalesce("units", F.lit(0)).cast("decimal(28,4)").alias("units"), *money, "adjustment", (F.col("holding") + F.col("adjustment")).cast(MONEY).alias("to_book"), "valuation")


def hand_on(state: DataFrame, folder: str, name: str) -> None:
    """Store a period's lots under its name; a name that is there already is an error, so that no period is closed twice."""
    state.write.mode("errorifexists").parquet(f"{folder}/lots/{name}")


def taken_over(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The lots that a period has handed on."""
    return spark.read.parquet(f"{folder}/lots/{name}")
