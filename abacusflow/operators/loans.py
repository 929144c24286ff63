"""Loan schedules, rounded at every step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, money

_ROW = "struct<n:int,interest:decimal(18,2),capital:decimal(18,2),vat:decimal(18,2),due:decimal(18,2),balance:decimal(18,2)>"


def _dated(rows: DataFrame, start: str) -> DataFrame:
    return rows.withColumn("due_date", F.add_months(start, F.col("n") - 1))


def french(loans: DataFrame, keys: list[str], capital: str, n: str, yearly_rate: str, start: str, vat_rate: float = 0.21) -> DataFrame:
    """A row per installment of equal payments: interest on the rounded balance, the last one pays what is left, tax on interest.

    The rounded balance depends on every step before, so a loan's rows come from
    a fold over its installments (at most hundreds), inside one expression.
    """
    rate = F.col(yearly_rate) / 12
    payment = F.when(rate == 0, F.col(capital).cast("double") / F.col(n)).otherwise(F.col(capital).cast("double") * rate / (1 - F.pow(1 + rate, -F.col(n))))
    out = loans.select(*keys, F.col(capital).cast(MONEY).alias("_capital"), F.col(n).cast("int").alias("_n"), rate.cast("decimal(18,12)").alias("_rate"), F.round(payment.cast("decimal(28,10)"), 8).cast("decimal(28,8)").alias("_payment"), F.col(start).alias("_start"))
    first = F.struct(F.col("_capital").alias("balance"), F.array().cast(f"array<{_ROW}>").alias("rows"))

    def step(state, i):
        interest = money(state["balance"] * F.col("_rate"))
        part = F.when(i == F.col("_n"), state["balance"]).otherwise(money(F.col("_payment") - interest)).cast(MONEY)
        vat = money(interest * F.lit(vat_rate).cast("decimal(9,4)"))
        left = (state["balance"] - part).cast(MONEY)
        row = F.struct(i.alias("n"), interest.alias("interest"), part.alias("capital"), vat.alias("vat"), (part + interest + vat).cast(MONEY).alias("due"), F.greatest(left, F.lit(0).cast(MONEY)).alias("balance"))
        return F.struct(left.alias("balance"), F.array_append(state["rows"], row.cast(_ROW)).alias("rows"))

    folded = F.aggregate(F.sequence(F.lit(1), F.col("_n")), first, step, lambda s: s["rows"])
    return _dated(out.where("_n > 0").select(*keys, "_start", F.inline(folded)), "_start").drop("_start")


def german(loans: DataFrame, keys: list[str], capital: str, n: str, yearly_rate: str, start: str, vat_rate: float = 0.21) -> DataFrame:
    """A row per installment of equal capital, in closed form: the balance before installment i is capital less (i - 1) rounded parts."""
    rows = loans.where(F.col(n) > 0).select(*keys, F.col(capital).cast(MONEY).alias("_capital"), F.col(n).cast("int").alias("_n"), (F.col(yearly_rate) / 12).cast("decimal(18,12)").alias("_rate"), F.col(start).alias("_start"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_part", money(F.col("_capital") / F.col("_n").cast("decimal(9,0)")))
    rows = rows.withColumn("_before", (F.col("_capital") - (F.col("n") - 1).cast("decimal(9,0)") * F.col("_part")).cast(MONEY))
    part = F.when(F.col("n") == F.col("_n"), F.col("_before")).otherwise(F.col("_part")).cast(MONEY)
    rows = rows.withColumn("interest", money(F.col("_before") * F.col("_rate"))).withColumn("capital", part)
    rows = rows.withColumn("vat", money(F.col("interest") * F.lit(vat_rate).cast("decimal(9,4)")))
    rows = rows.withColumn("due", (F.col("capital") + F.col("interest") + F.col("vat")).cast(MONEY)).withColumn("balance", F.greatest((F.col("_before") - F.col("capital")).cast(MONEY), F.lit(0).cast(MONEY)))
    return _dated(rows, "_start").select(*keys, "n", "interest", "capital", "vat", "due", "balance", "due_date")
