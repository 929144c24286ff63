"""Reading tables with unknown headers, and writing by key.

Files are read as text with explicit columns; aliases are resolved from the
column names alone; nothing is inferred from data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_words

SEPARATORS = (";", ",", "\t")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all tasks, for work that is much for the bytes it is read from: a small file is otherwise one task's, whatever its rows grow into."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def nullified(text: Column) -> Column:
    """None for the ways in which sheets write that nothing is there."""
    trimmed = F.trim(text.cast("string"))
    return F.when(~F.lower(trimmed).isin("", "nan", "none", "null", "nat"), trimmed)


def separator_of(spark: SparkSession, path: str, least: int = 5) -> str:
    """The first separator that cuts the header line into enough fields, else the one that cuts it most."""
    header = spark.read.text(path).limit(1).collect()
    line = header[0][0] if header else ""
    counts = {s: len(line.split(s)) for s in SEPARATORS}
    return next((s for s in SEPARATORS if counts[s] >= least), max(SEPARATORS, key=lambda s: counts[s]))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file whose separator is found from its header; without a schema all columns are text."""
    reader = spark.read.option("header", True).option("sep", separator_of(spark, path)).option("multiLine", False)
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table in parallel ranges of a numeric column; filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": parts, **options}.items():
        reader = reader.option(k, v)
    return reader.load()


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, sha1, first): files below a folder; ``first`` marks one of those with equal content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    files = files.select("path", "content", F.sha1("content").alias("sha1"))
    firsts = files.groupBy("sha1").agg(F.min("path").alias("_first"))
    return files.join(firsts, "sha1").withColumn("first", F.col("path") == F.col("_first")).drop("_first")


def resolve(df: DataFrame, aliases: dict[str, list[str]], needed: tuple[str, ...] = ()) -> DataFrame:
    """Rename columns by alias lists (the first alias that is there wins, without accents, case or punctuation); others are left out."""
    known: dict[str, str] = {}
    for c in df.columns:
        known.setdefault(_plain(c), c)
    found = {name: next((known[_plain(a)] for a in [name, *names] if _plain(a) in known), None) for name, names in aliases.items()}
    missing = [n for n in needed if found.get(n) is None]
    if missing:
        raise ValueError(f"no column for {missing}; there are {df.columns}")
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items() if c is not None])


def _plain(name: str) -> str:
    import unicodedata

    text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).upper()
    return " ".join("".join(c if c.isalnum() else " " for c in text).split())


def header_row(cells: DataFrame, words: list[str], within: int = 25) -> DataFrame:
    """(sheet, row): of a cell table (sheet, row, col, value) the first of the top rows with the most of these words."""
    hit = F.coalesce(*[F.when(fold_words(F.col("value")).contains(w), 1) for w in words], F.lit(0))
    scored = cells.where(F.col("row") < within).groupBy("sheet", "row").agg(F.sum(hit).alias("_n"))
    return scored.groupBy("sheet").agg(F.max_by("row", F.struct("_n", -F.col("row"))).alias("row"), F.max("_n").alias("hits"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of new, and those of old whose keys new does not have: to be written as the next version of the table."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns)
    return kept.unionByName(new.select(*old.columns))


def seeded(old: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and the seed rows whose keys are not there."""
    return old.unionByName(seed.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write, replacing only the partitions (by keys) that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def lines_from_words(words: DataFrame, doc: str, page: str, x: str, y: str, text: str, height: int = 15) -> DataFrame:
    """(doc, page, line, text): words on pages gathered into lines of a height, left to right."""
    line = F.floor(F.col(y) / height).cast("long")
    own = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t"))))
    return words.groupBy(doc, page, line.alias("line")).agg(F.array_join(F.transform(own, lambda w: w["t"]), " ").alias("text"))
