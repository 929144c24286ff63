"""The corpus pipeline: documents in, sharded training documents out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next one; all but the last return the columns
of ``documents``.

1. quality rules: documents that the rules reject go;
2. near duplicates: of each group of word-shingle similarity 0.8 or more, the
   document with the smallest id stays;
3. decontamination: documents in which a benchmark window occurs go;
4. mixing: sources are brought to their target weights, by leaving documents
   out or repeating them;
5. sharding: every row gets its shard of 16 and its place there.

A stage writes tables for itself in the shared folder. They are deleted when a later
stage begins and the DataFrame that the stage returned is no longer held by anyone, nor
read by that later stage: so results of several stages, or of several pipelines in one
session, can be read side by side.
"""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from abacusflow.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from abacusflow.llm.common import cut, table
from abacusflow.sources import scratch

#: Percent of word-shingle similarity from which documents are near duplicates.
NEAR_PERCENT = 80


def _unread(spark: SparkSession, docs: DataFrame) -> list[str]:
    """Tables of stages whose results nobody holds and ``docs`` does not read."""
    context = spark.sparkContext
    kept, gone = [], []
    for result, tables in getattr(context, "_corpus_pipeline_stages", []):
        (gone if result() is None else kept).append((result, tables))
    if gone:
        read = docs.inputFiles()
        used = [s for s in gone if any(f"/{t.rsplit('/', 1)[-1]}/" in path for t in s[1] for path in read)]
        kept, gone = kept + used, [s for s in gone if s not in used]
    context._corpus_pipeline_stages = kept
    return [t for _, tables in gone for t in tables]


def _stage(f: Callable) -> Callable:
    """A stage that first deletes what stages before it wrote for themselves and nobody reads any more."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.dropped(spark, _unread(spark, docs))
        before = len(scratch.made(spark))
        out = f(spark, docs, sf_dir)
        spark.sparkContext._corpus_pipeline_stages.append((weakref.ref(out), scratch.made(spark)[before:]))
        return out

    return run


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs, percent=NEAR_PERCENT)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@_stage
def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs, maps=sharding.map_folder(spark))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The stages fit a model, use seeded hashes and balance by greedy choice: not in SQL. Tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
