"""Tables on pages: from words with places to rows with named columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold

#: A place across the page is between columns if at most this share of a table's lines has ink there.
INK = 0.2
#: Gaps up to so many points are blanks between words.
BLANK = 6


def columns_of(words: DataFrame, table: list[str], line: str, left: str, right: str, ink: float = INK, blank: int = BLANK) -> DataFrame:
    """(table, column, from, to): the columns of a table, by the gaps that its lines leave.

    Each line inks the places that its words cover. Places that few lines ink are
    gaps, and what is between gaps is a column; so one cell that runs into the next
    column does not join the two. A column that hardly any line fills is none: its words
    go to the nearest. Ink is counted from where words begin and end, which is as many
    rows as a page is points wide, whatever the table's length; words of one line
    do not lie upon each other.
    """
    begin = F.floor(left).cast("int")
    end = F.greatest(begin + 1, F.ceil(right).cast("int"))
    edges = words.select(*table, F.explode(F.array(F.struct(begin.alias("from"), F.lit(1).alias("d")), F.struct(end.alias("from"), F.lit(-1).alias("d")))).alias("_e")).select(*table, "_e.*")
    edges = edges.groupBy(*table, "from").agg(F.sum("d").alias("_d"))
    lines = words.groupBy(*table).agg(F.count_distinct(line).alias("_lines"))
    along = Window.partitionBy(*table).orderBy("from")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    inked = edges.withColumn("_n", F.sum("_d").over(so_far)).withColumn("to", F.lead("from").over(along))
    held = inked.join(lines, table).where(F.col("_n") > ink * F.col("_lines"))
    new = F.coalesce(F.col("from") - F.lag("to").over(along) > blank, F.lit(True)).cast("int")
    numbered = held.withColumn("_new", new).withColumn("column", F.sum("_new").over(so_far).cast("int"))
    return numbered.groupBy(*table, "column").agg(F.min("from").alias("from"), F.max("to").alias("to"))


def cells_of(words: DataFrame, columns: DataFrame, table: list[str], line: str, left: str, right: str, text: str) -> DataFrame:
    """(table, line, column, value): each word in the column that it covers most of, the nearest if it covers none; words of a cell from left to right."""
    bounds = columns.groupBy(*table).agg(F.sort_array(F.collect_list(F.struct("column", "from", "to"))).alias("_columns"))  # as many as a page has columns
    shared = lambda c: F.least(F.col(right), c["to"]) - F.greatest(F.col(left), c["from"])
    best = F.array_max(F.transform("_columns", lambda c: F.struct(shared(c).alias("s"), (-c["column"]).alias("c"))))
    placed = words.join(bounds, table).withColumn("column", -best["c"])
    own = F.sort_array(F.collect_list(F.struct(F.col(left).alias("x"), F.col(text).alias("t"))))
    return placed.groupBy(*table, line, "column").agg(F.array_join(F.transform(own, lambda w: w["t"]), " ").alias("value"))


def _names(value: Column, rules: list[tuple[str, tuple[str, ...], tuple[str, ...]]]) -> Column:
    """Which field a header cell names: the first rule one of whose words it holds and none of whose other words."""
    told = fold(value)
    any_of = lambda words: F.lit(False) if not words else told.rlike("|".join(words))
    out = None
    for name, words, but in rules:
        holds = any_of(words) & ~any_of(but)
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def header_map(cells: DataFrame, table: list[str], line: str, rules: list[tuple[str, tuple[str, ...], tuple[str, ...]]], needed: str, least: int = 3, within: int = 2) -> DataFrame:
    """(table, header, column, field): which column holds which field, from the first line if it names the needed field and at least so many, else from the first of the next that names the needed one; of two columns for a field the left one."""
    first = cells.groupBy(*table).agg(F.min(line).alias("_first"))
    named = cells.join(first, table).where(F.col(line) < F.col("_first") + within).withColumn("field", _names(F.col("value"), rules)).where("field is not null")
    fields = named.groupBy(*table, F.col(line).alias("header"), "_first", "field").agg(F.min("column").alias("column"))
    good = fields.groupBy(*table, "header", "_first").agg(F.count(F.lit(1)).alias("_n"), F.max((F.col("field") == needed).cast("int")).alias("_has"))
    good = good.where((F.col("_has") == 1) & ((F.col("_n") >= least) | (F.col("header") > F.col("_first"))))
    chosen = good.groupBy(*table).agg(F.min("header").alias("header"))
    return fields.join(chosen, [*table, "header"]).drop("_first")


def mapped(cells: DataFrame, header: DataFrame, table: list[str], line: str, fields: list[str]) -> DataFrame:
    """(table, line, one column per field): the lines below the header; fields that a line or a table lacks are null."""
    below = cells.join(header, [*table, "column"]).where(F.col(line) > F.col("header"))
    return below.groupBy(*table, line).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


# Headers of fund movements; of a cell the first that fits.
FUND_HEADERS = [
    ("date", ("FECHA",), ("LIQ",)),
    ("concept", ("DESCRIP", "CONCEPTO", "TIPO", "OPERACION", "MOVIM"), ()),
    ("units", ("CANTIDAD", "CUOTA"), ("VALOR",)),
    ("value", ("VALOR", "VCP", "PRECIO", "COTIZ"), ()),
    ("total", ("MONTO", "TOTAL", "IMPORTE", "NETO"), ()),
]


def completed(units: Column, value: Column, total: Column) -> tuple[Column, Column]:
    """(units, total) of a movement of which one of the two may be missing: total = units x value, in cents; units = total / value, to 4 decimals; null where both are missing."""
    has = lambda c: F.coalesce(c, F.lit(0)) != 0
    whole = F.when(has(total), total).when(has(units) & has(value), F.round((units * value).cast("decimal(38,8)"), 2)).cast("decimal(18,2)")
    count = F.when(has(units), units).when(has(total) & has(value), F.round((total / value).cast("decimal(38,10)"), 4)).cast("decimal(28,4)")
    return count, whole
