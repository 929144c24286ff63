"""Ledgers, invoices and the like, derived from the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators.running import running

ORDER = ["ts", "event_id"]


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, month, day, ts, event_id, kind, amount: purchases and signups come in, other events go out."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    value = F.col("value").cast(MONEY)
    signed = F.when(F.col("event_type").isin("purchase", "signup"), value).otherwise(-value).cast(MONEY)
    return e.select(F.col("user_id").alias("account"), F.trunc("ts", "MM").alias("month"), F.col("ts").cast("date").alias("day"), "ts", "event_id", F.col("event_type").alias("kind"), signed.alias("amount"))


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements with a running balance, as a bad scan gives them: every seventh amount has the wrong sign, every eleventh balance is missing."""
    rows = running(movements(spark, sf_dir), ["account"], "month", ORDER, {"total": ("sum", F.col("amount"))})
    balance = F.when(F.col("event_id") % 11 != 0, F.col("total")).cast(MONEY)
    amount = F.when(F.col("event_id") % 7 == 0, -F.col("amount")).otherwise(F.col("amount")).cast(MONEY)
    return rows.withColumn("balance", balance).withColumn("amount", amount).drop("total")


MOVEMENTS = """mov as (
  select user_id as account, cast(date_trunc('month', ts) as date) as month, cast(ts as date) as day, ts, event_id, event_type as kind,
    cast(case when event_type in ('purchase', 'signup') then 1 else -1 end * cast(value as decimal(18,2)) as decimal(18,2)) as amount
  from events)"""

STATEMENT = (
    MOVEMENTS
    + """,
st as (
  select account, month, ts, event_id, kind, case when event_id % 7 = 0 then -amount else amount end as amount,
    case when event_id % 11 <> 0 then sum(amount) over (partition by account order by ts, event_id rows unbounded preceding) end as balance
  from mov),
known as (select *, last_value(balance ignore nulls) over (partition by account order by ts, event_id rows between unbounded preceding and 1 preceding) as prev from st)"""
)
