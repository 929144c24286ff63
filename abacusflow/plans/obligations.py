"""Queries on obligations, withholdings and debits in passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.money import MONEY
from ..operators import obligations
from .inputs import read
from .invoices import debits, invoices
from .registry import greedy_sql, query


@query()
def obligations_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as obligations, bundled by customer and month where their key is odd, and debits for some of them: bundles, singles by total or base, and last resorts."""
    inv = invoices(spark, sf_dir)
    bundle = F.when(F.col("invoice") % 2 == 1, F.date_format("day", "yyyyMM"))
    owed = inv.select(F.col("invoice").alias("obligation"), F.col("customer").alias("party"), bundle.alias("bundle"), "day", F.col("amount").alias("total"), F.round(F.col("amount") * F.lit("0.9").cast("decimal(3,2)"), 2).cast(MONEY).alias("base"))
    single = owed.where("obligation % 2 = 0 and obligation % 5 > 0").select(
        (F.col("obligation") * 10).alias("debit"), "party", F.date_add("day", F.when(F.col("obligation") % 4 == 0, 200).otherwise(3)).alias("paid_day"), F.when(F.col("obligation") % 3 == 0, F.col("base")).otherwise(F.col("total")).alias("paid"), F.lit("PAGO SINDICATO").alias("text")
    )
    whole = owed.where("bundle is not null").groupBy("party", "bundle").agg(F.max("day").alias("paid_day"), F.sum("total").cast(MONEY).alias("paid"), F.min("obligation").alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    whole = whole.select((F.col("o") * 10 + 1).alias("debit"), "party", "paid_day", "paid", F.lit("DEBITO").alias("text"))
    return obligations.settled(owed, single.unionByName(whole), ("SINDICATO", "PAGO"))


@query(
    f"""
with recursive it as (select o_orderkey as invoice, o_custkey as party, cast(o_orderdate as date) as day, cast(o_totalprice as decimal(18,2)) as net, cast(round(cast(o_totalprice as decimal(18,2)) * 0.21, 2) as decimal(18,2)) as vat from orders join customer on o_custkey = c_custkey),
wh as (select invoice + 1000000 as withholding, party, day + cast(invoice % 40 as integer) as held_day, cast(round(net * 0.01, 2) as decimal(18,2)) as ss, cast(round(vat * 0.80, 2) as decimal(18,2)) as iva, cast(round(net * 0.02, 2) as decimal(18,2)) as gan from it where invoice % 3 = 0),
pr as (select wh.party, withholding, invoice, cast(abs(ss - round(net * 0.01, 2)) + abs(iva - round(vat * 0.80, 2)) + abs(gan - round(net * 0.02, 2)) + date_diff('day', day, held_day) * 10 as decimal(18,2)) as score
  from wh join it on wh.party = it.party and day <= held_day and date_diff('day', day, held_day) <= 45),
{greedy_sql('took', 'pr', 'party', 'withholding', 'invoice', 'score, ')}
select withholding, invoice, cast(score as double) as score from took"""
)
def withholding_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withholdings of customers, each with the invoice of the 45 days before that it fits best."""
    inv = invoices(spark, sf_dir).select("invoice", F.col("customer").alias("party"), "day", F.col("amount").alias("net"), F.round(F.col("amount") * F.lit("0.21").cast("decimal(4,2)"), 2).cast(MONEY).alias("vat"))
    share = lambda c, p: F.round(F.col(c) * F.lit(p).cast("decimal(4,2)"), 2).cast(MONEY)
    held = inv.where("invoice % 3 = 0").select((F.col("invoice") + 1_000_000).alias("withholding"), "party", F.date_add("day", (F.col("invoice") % 40).cast("int")).alias("held_day"), share("net", "0.01").alias("ss"), share("vat", "0.80").alias("iva"), share("net", "0.02").alias("gan"))
    return obligations.scored_assignment(held, inv).withColumn("score", F.col("score").cast("double"))


@query()
def debit_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debits and invoices by name, by amount, late by name, and two for one."""
    inv = invoices(spark, sf_dir).where("status <> 'P'").drop("customer", "status")
    paid = debits(spark, sf_dir).drop("customer")
    late = F.when(F.col("debit") % 3 == 0, F.date_add("paid_day", 40)).otherwise(F.col("paid_day"))
    paid = paid.withColumn("paid_day", late).withColumn("text", F.when(F.col("debit") % 4 == 0, "TRF / sin datos / 0").otherwise(F.col("text")))
    return obligations.matched_by_passes(paid, inv, (T.fold(T.second_field(F.col("text"))), T.fold(F.col("name"))))
