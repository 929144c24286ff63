"""Closing entries, residual taxes, plausibility of schedules, fund years, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import MONEY


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def closing_difference(total: Column, received: Column, withheld: list[Column], levy: Column) -> tuple[Column, Column]:
    """(residual levy, difference): what a sale's total leaves after money and withholdings, never below 0, and what is then still open against the known levy."""
    rest = total - received
    for w in withheld:
        rest = rest - F.coalesce(w, zero())
    residual = F.greatest(zero(), rest).cast(MONEY)
    return residual, (residual - F.coalesce(levy, zero())).cast(MONEY)


def closes(a: Column, b: Column, least: float = 50.0, share: float = 0.001) -> Column:
    """Equal within the larger of a fixed tolerance and a share of the first."""
    return F.abs(a - b) <= F.greatest(F.lit(least), F.abs(a.cast("double")) * share)


def plausible_schedule(rows: DataFrame, keys: list[str], amount: str, due: str) -> DataFrame:
    """Per schedule ``verdict``: EMPTY, NEGATIVE, ZERO_AMOUNTS (more than half), MISSING_DATES (more than half) or OK."""
    share = lambda c: F.avg(c.cast("int"))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max((F.col(amount) < 0).cast("int")).alias("_neg"), share(F.coalesce(F.col(amount), zero()) == 0).alias("_zero"), share(F.col(due).isNull()).alias("_undated")
    )
    verdict = F.when(F.col("n_rows") == 0, "EMPTY").when(F.col("_neg") == 1, "NEGATIVE").when(F.col("_zero") > 0.5, "ZERO_AMOUNTS").when(F.col("_undated") > 0.5, "MISSING_DATES").otherwise("OK")
    return out.withColumn("verdict", verdict).drop("_neg", "_zero", "_undated")


def vat_closing(rows: DataFrame, keys: list[str], rate: str, debit: str, credit: str, previous: str) -> DataFrame:
    """The closing entry of a period: what was charged per rate is debited, what was paid is credited, the balance carried from before is used up, and the rest goes to what is owed or what is carried on.

    (keys, line, debit, credit), whose debits and credits are equal.
    """
    by_rate = rows.groupBy(*keys, rate).agg(F.sum(debit).cast(MONEY).alias("_charged"), F.sum(credit).cast(MONEY).alias("_paid"))
    told = F.array(
        F.struct(F.concat(F.lit("charged "), F.col(rate).cast("string")).alias("line"), F.col("_charged").alias("debit"), zero().alias("credit")),
        F.struct(F.concat(F.lit("paid "), F.col(rate).cast("string")).alias("line"), zero().alias("debit"), F.col("_paid").alias("credit")),
    )
    lines = by_rate.select(*keys, F.inline(told)).where("debit <> 0 or credit <> 0")
    sums = rows.groupBy(*keys).agg((F.sum(debit) - F.sum(credit)).cast(MONEY).alias("_due"), F.max(previous).cast(MONEY).alias("_before"))
    rest = F.col("_due") - F.coalesce("_before", zero())
    ends = F.array(
        F.struct(F.lit("carried from before").alias("line"), zero().alias("debit"), F.coalesce("_before", zero()).alias("credit")),
        F.struct(F.when(rest >= 0, "owed").otherwise("carried on").alias("line"), F.greatest(-rest, zero()).cast(MONEY).alias("debit"), F.greatest(rest, zero()).cast(MONEY).alias("credit")),
    )
    return lines.unionByName(sums.select(*keys, F.inline(ends)).where("debit <> 0 or credit <> 0"))


def fund_year(months: DataFrame, keys: list[str], month: str, units_close: str, value_close: str, moved_units: str, moved_amount: str, tolerance: float = 0.01) -> DataFrame:
    """Month by month of a fund: opening units from the month before, units that should be there, the holding result (closing less opening less what moved) and OK or ERROR.

    The last extract of a month wins where several tell it (``months`` has one row each).
    """
    w = Window.partitionBy(*keys).orderBy(month)
    out = months.withColumn("units_open", F.coalesce(F.lag(units_close).over(w), F.lit(0))).withColumn("amount_close", F.round(F.col(units_close) * F.col(value_close), 2).cast(MONEY))
    out = out.withColumn("amount_open", F.coalesce(F.lag("amount_close").over(w), zero()))
    out = out.withColumn("result", (F.col("amount_close") - F.col("amount_open") - F.coalesce(moved_amount, zero())).cast(MONEY))
    off = F.abs(F.col("units_open") + F.coalesce(moved_units, F.lit(0)) - F.col(units_close))
    return out.withColumn("state", F.when(off <= tolerance, "OK").otherwise("ERROR"))


def last_told(rows: DataFrame, keys: list[str], order: list[str], value: str, listed: str) -> DataFrame:
    """Several extracts of one month as one: all listed movements together, and the last position that is told."""
    place = F.struct(*order)
    return rows.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias(value), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*order, listed))), lambda x: x[listed])).alias(listed))


def consolidated_loans(installments: DataFrame, loan: str, number: str, order: list[str], capital: str, balance: str, told: str) -> DataFrame:
    """A row per loan: its installments without repeats (the first of a number), and its capital: as told, else the highest balance, else the sum of capital."""
    from .dedup import keep_one

    own = keep_one(installments, [loan, number], order, last=False)
    some = lambda c: F.when(c != 0, c)
    return own.groupBy(loan).agg(F.count(F.lit(1)).alias("n_installments"), F.coalesce(some(F.max(told)), some(F.max(balance)), F.sum(capital)).cast(MONEY).alias("capital"))


def debt_at(parts: Column) -> Column:
    """The sum of a map's amounts; null if all are 0 or there are none."""
    total = F.aggregate(F.map_values(parts), zero(), lambda s, x: (s + F.coalesce(x, zero())).cast(MONEY))
    return F.when(total != 0, total)


def journal_lines(entries: DataFrame, kinds: dict[str, str], day: str, kind: str, account: str, debit: str, credit: str) -> DataFrame:
    """One text line per journal row for an import: date as yyyyMMdd, mapped kind, account, amounts with a point, separated by semicolons."""
    mapped = F.coalesce(*[F.when(F.col(kind) == k, v) for k, v in kinds.items()], F.col(kind))
    amount = lambda c: F.col(c).cast(MONEY).cast("string")
    return entries.select(F.concat_ws(";", F.date_format(day, "yyyyMMdd"), mapped, account, amount(debit), amount(credit)).alias("value"))


def installments_paid(due: DataFrame, paid: DataFrame, keys: list[str], tolerance: float = 0.5, days: int = 4) -> DataFrame:
    """Installments (installment, due, due_date) with the bank debit (debit, paid, paid_day) that pays each, nearest day first, one to one, and ``matched``."""
    from .matching import amount_band, apart, one_to_one

    pairs = amount_band(due, paid, "due", "paid", tolerance, keys).withColumn("_days", F.abs(F.datediff("paid_day", "due_date"))).where(F.col("_days") <= days)
    taken = one_to_one(pairs.select("installment", "debit", "_days", F.abs(F.col("due") - F.col("paid")).alias("_off")), "installment", "debit", [F.col("_days"), F.col("_off")])
    return due.join(apart(taken.select("installment", "debit")), "installment", "left").withColumn("matched", F.col("debit").isNotNull())
