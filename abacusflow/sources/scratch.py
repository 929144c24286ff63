"""Tables that a run writes for itself, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where none is set, a local session gets a temporary one; a cluster must name one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or getattr(context, "_abacusflow_scratch", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = context._abacusflow_scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return folder


def run_folder(spark: SparkSession) -> str:
    """Where this application's tables go."""
    return f"{shared_folder(spark)}/abacusflow-{spark.sparkContext.applicationId}"


def made(spark: SparkSession) -> list[str]:
    """The tables that this application has written for itself so far, in order."""
    context = spark.sparkContext
    if not hasattr(context, "_abacusflow_tables"):
        context._abacusflow_tables = []
    return context._abacusflow_tables


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the run's folder and read it back: what follows starts from files that outlive executors."""
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    made(df.sparkSession).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, tables: list[str]) -> None:
    """Delete tables of ``made``; what is read from them must have been written elsewhere by then."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gone = set(tables)
    made(spark)[:] = [t for t in made(spark) if t not in gone]


def clear(spark: SparkSession) -> None:
    """Delete all tables of this application, as ``dropped``."""
    dropped(spark, [*made(spark), run_folder(spark)])
