"""Charts of accounts as trees: parents, roll-ups, and entries that may not be posted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..sources.scratch import stored
from ..sources.tables import nullified, resolve

# Headers that charts use, and how they write that an account takes no entries.
HEADERS = {"code": ["codigo", "cuenta", "cod"], "name": ["descripcion", "nombre", "denominacion"], "postable": ["imputable", "recibe asientos"]}
NOT_POSTABLE = ("NO", "N", "FALSE", "0", "MADRE", "RUBRO", "TITULO")


def chart_of(cells: DataFrame) -> DataFrame:
    """(code, name, postable) of a chart as it is read: headers by alias, of repeated headers the first, accounts are postable unless told otherwise; of a code that stands twice the first name in order."""
    once = cells.toDF(*[c if c not in cells.columns[:k] else f"{c}__{k}" for k, c in enumerate(cells.columns)])
    found = resolve(once, HEADERS, ("code",))
    has = lambda c: F.col(c) if c in found.columns else F.lit(None)
    code = nullified(F.regexp_replace(F.col("code").cast("string"), r"\.0$", ""))
    told = F.upper(F.trim(has("postable").cast("string")))
    rows = found.select(code.alias("code"), F.trim(has("name").cast("string")).alias("name"), (~F.coalesce(told.isin(*NOT_POSTABLE), F.lit(False))).alias("postable"))
    return rows.where("code is not null").groupBy("code").agg(F.min("name").alias("name"), F.min("postable").alias("postable"))


def with_parents(chart: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``parent``, the longest code of the same chart (``keys``) that the code begins with, null at the top, and ``leaf``.

    A code asks for each of its beginnings: an equi-join, as many rows as codes are long.
    """
    keys = keys or []
    starts = chart.where(F.length("code") > 1).select(*keys, "code", F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda n: F.substring("code", F.lit(1), n))).alias("parent"))
    parents = starts.join(chart.select(*keys, F.col("code").alias("parent")), [*keys, "parent"]).groupBy(*keys, "code").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    tree = chart.join(parents, [*keys, "code"], "left")
    inner = parents.select(*keys, F.col("parent").alias("code")).distinct().withColumn("_inner", F.lit(True))
    return tree.join(inner, [*keys, "code"], "left").withColumn("leaf", F.col("_inner").isNull()).drop("_inner")


def ancestors(tree: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, code, ancestor, steps) of a tree (code, parent): every account with itself and all above it.

    Ways are doubled in each round, so a chart as deep as n takes log n rounds. A
    tree in which an account is above itself is an error.
    """
    keys = keys or []
    same = stored(tree.select(*keys, "code", F.col("code").alias("ancestor"), F.lit(0).alias("steps")))
    ways = stored(tree.where("parent is not null").select(*keys, "code", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")))
    reach, most, n = 1, tree.count(), ways.count()
    while True:
        far = ways.select(*keys, F.col("code").alias("ancestor"), F.col("ancestor").alias("_top"), F.col("steps").alias("_more"))
        longer = ways.where(F.col("steps") == reach).join(far, [*keys, "ancestor"]).select(*keys, "code", F.col("_top").alias("ancestor"), (F.col("steps") + F.col("_more")).alias("steps"))
        ways = stored(ways.unionByName(longer))
        if (now := ways.count()) == n:
            return same.unionByName(ways)
        if not ways.where(F.col("steps") >= most).isEmpty():
            raise ValueError("an account is above itself")
        reach, n = 2 * reach, now


def rolled_up(lines: DataFrame, tree: DataFrame, code: str, debit: str, credit: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, code, name, level, leaf, own, total) of every account: its balance by its own lines, and with all below it.

    Lines are summed by account before they go up, so an account with a third of all
    lines sends one row to each account above it.
    """
    keys = keys or []
    own = lines.groupBy(*keys, F.col(code).alias("code")).agg(F.sum(F.coalesce(debit, F.lit(0)) - F.coalesce(credit, F.lit(0))).cast(MONEY).alias("own"))
    up = stored(ancestors(tree, keys))
    totals = own.join(up, [*keys, "code"]).groupBy(*keys, F.col("ancestor").alias("code")).agg(F.sum("own").cast(MONEY).alias("total"))
    levels = up.groupBy(*keys, "code").agg(F.max("steps").alias("level"))
    out = tree.join(levels, [*keys, "code"]).join(own, [*keys, "code"], "left").join(totals, [*keys, "code"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast(MONEY).alias(c)
    return out.select(*keys, "code", "name", "level", "leaf", zero("own"), zero("total"))


def not_postable(lines: DataFrame, chart: DataFrame, code: str, keys: list[str] | None = None) -> DataFrame:
    """The lines on accounts that take no entries, with ``reason``; accounts that the chart does not know are no error here."""
    keys = keys or []
    closed = chart.where(~F.col("postable")).select(*keys, F.col("code").alias("_code"))
    same = lines[code] == closed["_code"]
    for k in keys:
        same = same & (lines[k] == closed[k])
    found = lines.join(closed, same)
    for k in keys:
        found = found.drop(closed[k])
    return found.drop("_code").withColumn("reason", F.lit("cuenta madre o rubro: no imputable"))


def exported(lines: DataFrame, chart: DataFrame, entry: list[str], order: list[str], code: str, debit: str, credit: str, tolerance: float = 5.0) -> DataFrame:
    """Lines of entries as they may be exported, with ``state``: LISTO; NO IMPUTABLE for all lines of an entry with a line on a closed account; DESBALANCEADO beyond the tolerance.

    What rounding has left too much on one side is taken off that side's largest line.
    """
    closed = not_postable(lines, chart, code).select(*entry).distinct().withColumn("_closed", F.lit(True))
    off = lines.groupBy(*entry).agg((F.sum(debit) - F.sum(credit)).cast(MONEY).alias("_off"), F.max(F.struct(F.col(debit).alias("x"), *order)).alias("_d"), F.max(F.struct(F.col(credit).alias("x"), *order)).alias("_c"))
    out = lines.join(off, entry).join(closed, entry, "left")
    small = F.abs("_off") <= tolerance
    ready = small & F.col("_closed").isNull()
    place: Column = F.struct(*order)
    less = lambda column, most, by: F.when(ready & (by > 0) & (place == F.struct(*[F.col(f"{most}.{c}") for c in order])), F.col(column) - by).otherwise(F.col(column)).cast(MONEY)
    state = F.when(F.col("_closed").isNotNull(), "NO IMPUTABLE").when(~small, "DESBALANCEADO").otherwise("LISTO")
    return out.withColumns({"state": state, debit: less(debit, "_d", F.col("_off")), credit: less(credit, "_c", -F.col("_off"))}).drop("_off", "_d", "_c", "_closed")
