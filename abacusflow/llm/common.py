"""What the operators of this subpackage share: small column helpers, and ``cut``, which writes a table to the run's folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import run_folder, shared_folder
from ..sources.scratch import stored as cut

__all__ = ["WORD", "ascii_lower", "cut", "run_folder", "shared_folder", "table", "word_count"]

#: Words `[^\x20\x09-\x0D]+`, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with just these columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """How many `[^\\x20\\x09-\\x0D]+` a text has; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
