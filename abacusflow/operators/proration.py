"""Splitting totals over rows to the cent, and tax on invoice lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import MONEY, money, part_of


def spread(rows: DataFrame, keys: list[str], order: list[str], weight: str, total: str, name: str = "share") -> DataFrame:
    """Add each row's share of its group's ``total`` by weight, rounded; the last row takes the cents that are left. A group without weight gets 0, its last row all."""
    sums = rows.groupBy(*keys).agg(F.sum(weight).alias("_weights"), F.max(F.struct(*order)).alias("_last"))
    out = rows.join(sums, keys).withColumn("_is_last", F.struct(*order) == F.col("_last"))
    part = F.coalesce(part_of(F.col(total), F.col(weight), F.col("_weights")), F.lit(0).cast(MONEY))
    out = out.withColumn("_part", part)
    others = out.where("not _is_last").groupBy(*keys).agg(F.sum("_part").alias("_others"))
    out = out.join(others, keys, "left")
    rest = F.col(total) - F.coalesce("_others", F.lit(0).cast(MONEY))
    return out.withColumn(name, F.when(F.col("_is_last"), rest).otherwise(F.col("_part")).cast(MONEY)).drop("_weights", "_last", "_is_last", "_part", "_others")


def discounted(rows: DataFrame, keys: list[str], order: list[str], amount: str, discount: str, name: str = "net") -> DataFrame:
    """Add each line's amount after a discount on the group: line times (1 - discount / sum), rounded; the last line takes the difference. No discount or no positive sum: unchanged."""
    sums = rows.groupBy(*keys).agg(F.sum(amount).alias("_sum"), F.max(F.struct(*order)).alias("_last"))
    out = rows.join(sums, keys)
    applies = (F.col(discount) > 0) & (F.col("_sum") > 0)
    cut = part_of(F.col(amount), F.col("_sum") - F.col(discount), F.col("_sum"))
    out = out.withColumn("_part", F.when(applies, cut).otherwise(F.col(amount)))
    done = out.groupBy(*keys).agg(F.sum("_part").alias("_done"))
    out = out.join(done, keys)
    delta = F.when(applies & (F.struct(*order) == F.col("_last")), F.col("_sum") - F.col(discount) - F.col("_done")).otherwise(0)
    return out.withColumn(name, (F.col("_part") + delta).cast(MONEY)).drop("_sum", "_last", "_part", "_done")


def vat_split(amount: Column, rate: Column, gross: Column) -> tuple[Column, Column, Column]:
    """(net, vat, total): from a net amount, or where ``gross`` from one that holds the tax. Rates in percent."""
    r = rate.cast("decimal(9,4)") / 100
    value = amount.cast(MONEY)
    net = F.when(gross, money(value / (1 + r))).otherwise(value)
    vat = F.when(gross, value - net).otherwise(money(value * r)).cast(MONEY)
    return net, vat, (net + vat).cast(MONEY)


def rate_for(line: Column, learned: Column, hint: Column, default: float = 21.0) -> tuple[Column, Column]:
    """(rate, estimated): printed on the line, learned from other invoices, hinted by the name, else the default, which is an estimate."""
    return F.coalesce(line, learned, hint, F.lit(default)).cast("decimal(9,4)"), F.coalesce(line, learned, hint).isNull()


def learned_rates(rows: DataFrame, code: str, rate: str, order: list[str]) -> DataFrame:
    """(code, rate): the last rate seen of each code."""
    return rows.where(F.col(code).isNotNull() & F.col(rate).isNotNull()).groupBy(code).agg(F.max_by(rate, F.struct(*order)).alias(rate))


def balanced_entry(rows: DataFrame, keys: list[str], order: list[str], debit: str, credit: str, tolerance: float = 5.0) -> DataFrame:
    """Add the cents that an entry lacks to its last line's lighter side, up to the tolerance; ``balanced`` says whether it balances then."""
    sums = rows.groupBy(*keys).agg((F.sum(debit) - F.sum(credit)).cast(MONEY).alias("_off"), F.max(F.struct(*order)).alias("_last"))
    out = rows.join(sums, keys)
    small = F.abs("_off") <= tolerance
    last = small & (F.struct(*order) == F.col("_last"))
    zero = F.lit(0).cast(MONEY)
    out = out.withColumn(credit, (F.col(credit) + F.when(last, F.greatest("_off", zero)).otherwise(zero)).cast(MONEY))
    out = out.withColumn(debit, (F.col(debit) + F.when(last, F.greatest(-F.col("_off"), zero)).otherwise(zero)).cast(MONEY))
    return out.withColumn("balanced", small).drop("_off", "_last")
