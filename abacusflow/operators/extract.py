"""From lines of text to records: sections, blocks, inherited values, patterns.

Lines are rows (document, line number, line). A marker is a condition on a line;
what holds for the lines after it is a running value within the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _so_far(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def sections(lines: DataFrame, keys: list[str], order: str, start: Column, end: Column, name: str = "in_section") -> DataFrame:
    """Add whether a line comes after a start marker and before the end marker that follows; marker lines themselves do not count."""
    marker = F.when(end, False).when(start, True)
    return lines.withColumn("_m", marker).withColumn(name, F.coalesce(F.last("_m", ignorenulls=True).over(_so_far(keys, order)), F.lit(False)) & F.col("_m").isNull()).drop("_m")


def blocks(lines: DataFrame, keys: list[str], order: str, line: str, anchor: Column) -> DataFrame:
    """(keys, block, first_line, text): an anchor line with the lines below it up to the next anchor, joined by blanks. Lines before the first anchor are block 0."""
    numbered = lines.withColumn("block", F.sum(anchor.cast("int")).over(_so_far(keys, order)))
    told = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("t"))))
    out = numbered.groupBy(*keys, "block").agg(told.alias("_t"))
    return out.select(*keys, "block", F.get("_t", F.lit(0))["o"].alias("first_line"), F.array_join(F.transform("_t", lambda x: x["t"]), " ").alias("text"))


def inherited(lines: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Add the last value told at or above a line (a date, a month, a heading)."""
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(_so_far(keys, order)))


def records(docs: DataFrame, keys: list[str], text: str, pattern: str, names: list[str]) -> DataFrame:
    """A row per match of a pattern, with a column per group and the match's number."""
    groups = [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(k + 1)) for k in range(len(names))]
    rows = docs.select(*keys, F.posexplode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names, strict=True)])).alias("match", "_r"))
    return rows.select(*keys, "match", *[F.col("_r")[n].alias(n) for n in names])


def first_of(text: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that is found, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def column_by_kind(rows: DataFrame, keys: list[str], label: str, amount: str, kinds: dict[str, str], other: str = "other") -> DataFrame:
    """A row per key and a sum per kind: a label is of the first kind whose pattern fits, else ``other``; ``unknown`` counts those."""
    kind = F.coalesce(*[F.when(F.col(label).rlike(p), k) for k, p in kinds.items()], F.lit(other))
    sums = [F.sum(F.when(F.col("_kind") == k, F.col(amount))).alias(k) for k in [*kinds, other]]
    return rows.withColumn("_kind", kind).groupBy(*keys).agg(*sums, F.count(F.when(F.col("_kind") == other, 1)).alias("unknown"))


def number_roles(numbers: Column) -> Column:
    """(units, value, total) of two or three numbers in a line, null of fewer.

    Of three, the value per unit is the one with the most decimals, small ones
    first; of the others the larger is the total. Of two, the smaller magnitude
    below 10,000 is the value and units are total by value. ``numbers`` are
    strings with a point.
    """
    scale = lambda x: F.length(F.regexp_extract(x, r"\.(\d+)$", 1))
    size = lambda x: F.abs(x.cast("double"))
    told = F.transform(F.slice(numbers, 1, 3), lambda x, k: F.struct(scale(x).alias("d"), (size(x) < 100_000).cast("int").alias("s"), (-k).alias("k"), x.cast("decimal(28,8)").alias("x")))
    best = F.array_max(told)
    rest = F.sort_array(F.transform(F.filter(told, lambda t: t["k"] != best["k"]), lambda t: F.struct(F.abs(t["x"]).alias("a"), t["x"].alias("x"))), asc=False)
    a, b = F.get(told, F.lit(0))["x"], F.get(told, F.lit(1))["x"]
    first = (F.abs(a) < 10_000) & (F.abs(b) >= F.abs(a))
    value = F.when(first, a).when(F.abs(b) < 10_000, b).otherwise(a)
    total = F.when(first, b).when(F.abs(b) < 10_000, a).otherwise(b)
    two = F.when(value != 0, F.struct((total / value).cast("decimal(28,8)").alias("units"), value.alias("value"), total.alias("total")))
    three = F.struct(F.get(rest, F.lit(1))["x"].cast("decimal(28,8)").alias("units"), best["x"].alias("value"), F.get(rest, F.lit(0))["x"].alias("total"))
    return F.when(F.size(numbers) >= 3, three).when(F.size(numbers) == 2, two)


def best_form(forms: dict[str, Column], least: int = 1, forced: str | None = None) -> Column:
    """(form, found) of several readings of one text, each a struct of fields in the order of priority.

    The reading with the most fields that are there wins, the earlier one of
    equals; a forced one wins if it has any. There is no form below ``least`` fields.
    """
    read = []
    for k, (name, fields) in enumerate(forms.items()):
        found = F.size(F.filter(F.map_values(F.from_json(F.to_json(fields), "map<string,string>")), lambda x: x.isNotNull() & (x != "")))
        found = F.when(found < 0, 0).otherwise(found)
        weight = found + F.when(F.lit(name == forced) & (found > 0), 1000).otherwise(0)
        read.append((weight, found, k, name))
    best = F.array_max(F.array(*[F.struct(w.alias("w"), F.lit(-k).alias("k"), f.alias("found"), F.lit(n).alias("form")) for w, f, k, n in read]))
    return F.struct(F.when(best["found"] >= least, best["form"]).alias("form"), best["found"].alias("found"))
