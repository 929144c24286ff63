"""Counts, clusters, checks and numbering that closings and reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import MONEY
from .running import numbered


def state_summary(rows: DataFrame, state: str, amount: str, order: list[str]) -> DataFrame:
    """n and total per state, with ``place``: its place in ``order``, others behind."""
    place = F.coalesce(*[F.when(F.col(state) == s, k) for k, s in enumerate(order)], F.lit(len(order)))
    return rows.groupBy(state).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).cast(MONEY).alias("total")).withColumn("place", place)


def value_counts(rows: DataFrame, columns: list[str], distinct: str) -> DataFrame:
    """How often each combination occurs (nulls are a value), and how many different values another column has there."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(distinct).alias("n_distinct"))


def modal(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the value that occurs most often, the least of equals; nulls do not count. Counted before keys meet, so a busy key is no large group."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_m")).select(*keys, F.col("_m.v").alias(value), (-F.col("_m.n")).alias("n"))


def coverage(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Per key the first and the last day, and the days between, both counted."""
    out = rows.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return out.withColumn("days", F.datediff("last_day", "first_day") + 1)


def covered(day: Column, first: Column, last: Column, margin: int = 7) -> Column:
    """Whether a day lies in what a statement covers, with so many days more on both sides; without a day or a bound it does not."""
    return F.coalesce((day >= F.date_sub(first, margin)) & (day <= F.date_add(last, margin)), F.lit(False))


def clusters(rows: DataFrame, day: str, party: str, voucher: str, kind: str, amount: str, member: str, kinds: tuple[str, ...] = ("IVA", "GAN"), orphan: str = "SS") -> DataFrame:
    """Withholdings of a day, party and voucher as one: a sum per kind, ``ss`` and members.

    Rows of kind ``orphan`` have no voucher. The first of a day and party goes to
    the cluster with the largest sums, the next to the next, each cluster takes
    one; those left are clusters of their own.
    """
    zero = F.lit(0).cast(MONEY)
    told = rows.where(F.col(kind) != orphan)
    sums = [F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(amount))), zero).cast(MONEY).alias(k.lower()) for k in kinds]
    groups = told.groupBy(day, party, F.coalesce(voucher, F.lit("")).alias(voucher)).agg(*sums, F.sort_array(F.collect_list(member)).alias("members"))
    largest = -sum((F.col(k.lower()) for k in kinds[1:]), F.col(kinds[0].lower()))
    groups = groups.withColumn("_rank", F.row_number().over(Window.partitionBy(day, party).orderBy(largest, voucher)))
    alone = rows.where(F.col(kind) == orphan).select(day, party, F.col(member).alias("_member"), F.col(amount).alias("_ss"))
    alone = alone.withColumn("_rank", F.row_number().over(Window.partitionBy(day, party).orderBy("_member")))
    both = groups.join(alone, [day, party, "_rank"], "full")
    members = F.concat(F.coalesce("members", F.array().cast("array<bigint>")), F.when(F.col("_member").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("_member")))
    return both.select(day, party, F.coalesce(voucher, F.lit("")).alias(voucher), *[F.coalesce(k.lower(), zero).alias(k.lower()) for k in kinds], F.coalesce("_ss", zero).cast(MONEY).alias("ss"), members.alias("members"))


def first_known(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per key (such as bank and account of files) the first value of each column that is not null, in order, and the number of rows."""
    place = F.struct(*order)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def same_throughout(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key whether each column has one value alone (a file set must be of one id and one period); least and greatest tell, no set is gathered."""
    return rows.groupBy(*keys).agg(*[(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count(F.lit(1)))).alias(f"one_{c}") for c in columns])


def numbered_on(there: DataFrame, new: DataFrame, keys: list[str], number: str, order: list[str]) -> DataFrame:
    """New rows with numbers that go on from the largest of their key, from 0 where there is none. One writer at a time."""
    last = there.groupBy(*keys).agg(F.max(number).alias("_last"))
    return numbered(new, keys, order, "_k").join(last, keys, "left").withColumn(number, F.coalesce("_last", F.lit(-1)) + F.col("_k")).drop("_k", "_last")


def repeats_apart(rows: DataFrame, keys: list[Column], order: list[str], reason: str = "duplicado") -> DataFrame:
    """All rows with ``error``: null for the first of a key, a reason for the others; rows whose key has a null part are no repeats."""
    named = [f"_k{n}" for n in range(len(keys))]
    told = rows.select("*", *[k.alias(n) for k, n in zip(keys, named, strict=True)])
    whole = F.coalesce(*[F.when(F.col(n).isNull(), False) for n in named], F.lit(True))
    first = told.where(whole).groupBy(*named).agg(F.min(F.struct(*order)).alias("_first"))
    out = told.join(first, named, "left")
    return out.withColumn("error", F.when(whole & (F.struct(*order) != F.col("_first")), reason)).drop(*named, "_first")


def quotas(sizes: DataFrame, stratum: str, n: str, total: int, floor: int, priority: list[str]) -> DataFrame:
    """``quota`` per stratum of a sample of ``total`` rows: up to ``floor`` each, then the rest by priority as far as a stratum goes. A row per stratum."""
    place = F.coalesce(*[F.when(F.col(stratum) == s, k) for k, s in enumerate(priority)], F.lit(len(priority)))
    base = sizes.withColumn("_base", F.least(n, F.lit(floor))).withColumn("_place", place)
    every, before = Window.partitionBy(), Window.partitionBy().orderBy("_place", stratum).rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("_left", F.greatest(F.lit(0), F.lit(total) - F.sum("_base").over(every))).withColumn("_wants", F.col(n) - F.col("_base"))
    extra = F.greatest(F.lit(0), F.least(F.col("_wants"), F.col("_left") - F.coalesce(F.sum("_wants").over(before), F.lit(0))))
    return base.select(stratum, n, (F.col("_base") + extra).cast("long").alias("quota"))


def by_quota(rows: DataFrame, stratum: str, given: DataFrame, order: list[str]) -> DataFrame:
    """The first rows of every stratum, as many as its quota."""
    return numbered(rows, [stratum], order, "_rank").join(F.broadcast(given.select(stratum, "quota")), stratum).where("_rank <= quota").drop("_rank", "quota")


def signed_total(total: Column, kind: Column) -> Column:
    """Credit notes count against: their totals are negative."""
    return F.when(kind.startswith("NC"), -F.abs(total)).otherwise(total)


def lines_check(lines_sum: Column, total: Column, tolerance: float = 0.05) -> Column:
    """"ok" where lines add up to the document's total, else "revisar"."""
    return F.when(F.abs(F.abs(F.coalesce(lines_sum, F.lit(0))) - F.abs(total)) <= tolerance, "ok").otherwise("revisar")


def fee_sheet(gross: Column, vat: Column, deductions: list[Column]) -> tuple[Column, Column]:
    """(total, net) of a fee sheet: gross with VAT less deductions; net is that without VAT."""
    total = gross + vat
    for d in deductions:
        total = total - F.coalesce(d, F.lit(0))
    return total.cast(MONEY), (total - vat).cast(MONEY)


def interest_in(total: Column, base: Column) -> Column:
    """What a late payment has beyond the base owed."""
    return (total - base).cast(MONEY)


def difference_bucket(one: Column, two: Column, tolerance: float) -> Column:
    """OK, DIFERENCIA, or which side is missing."""
    return F.when(one.isNull(), "FALTA_UNO").when(two.isNull(), "FALTA_DOS").when(F.abs(one - two) > tolerance, "DIFERENCIA").otherwise("OK")


def single_payments(invoices: DataFrame, payments: DataFrame, party: str, day: str, amount: str, paid_day: str, paid: str, payment: str, tolerance: float) -> DataFrame:
    """Months of a party that one payment settles: the only one of the same month, else the only one of the next, within the tolerance of the month's invoices."""
    months = invoices.groupBy(party, F.trunc(day, "MM").alias("month")).agg(F.sum(amount).cast(MONEY).alias("owed"))
    single = payments.groupBy(party, F.trunc(paid_day, "MM").alias("_m")).agg(F.count(F.lit(1)).alias("_n"), F.min(payment).alias(payment), F.sum(paid).cast(MONEY).alias("paid")).where("_n = 1").drop("_n")
    found = months.join(single.withColumn("month", F.explode(F.array(F.col("_m"), F.add_months("_m", -1)))), [party, "month"])
    found = found.where(F.abs(F.col("owed") - F.col("paid")) <= tolerance).withColumn("later", F.col("_m") != F.col("month"))
    best = found.groupBy(party, "month").agg(F.min(F.struct("later", payment, "paid")).alias("_b"))
    return months.join(best, [party, "month"], "left").select(party, "month", "owed", F.col(f"_b.{payment}").alias(payment), F.col("_b.later").alias("next_month"))


def only_of(rows: DataFrame, keys: list[str], kind: str, allowed: tuple[str, ...]) -> DataFrame:
    """Per key whether all kinds are among the allowed ones; null kinds are not."""
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(kind).isin(*allowed), F.lit(False))).alias("only"))


def comparable_withholding(text: Column) -> Column:
    """A bank line that is a withholding and no perception."""
    told = F.upper(F.coalesce(text, F.lit("")))
    return told.rlike(r"RETENC|\bRET\b|SIRCREB") & ~told.rlike("PERCEP")


def journal_side(account: Column, amount: Column, debit_accounts: str = "15") -> tuple[Column, Column]:
    """(debe, haber) of an entry: accounts whose number starts with one of the digits grow by the debit, others by the credit; a negative amount turns the side."""
    is_debit = F.lit(debit_accounts).contains(F.left(account, F.lit(1)))
    side = is_debit == (amount >= 0)
    return F.when(side, F.abs(amount)).otherwise(F.lit(0).cast(MONEY)), F.when(~side, F.abs(amount)).otherwise(F.lit(0).cast(MONEY))


def not_yet(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an earlier, broken-off run has not written yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def fallback_sheets(movements: DataFrame, control: DataFrame, errors: DataFrame) -> dict[str, DataFrame]:
    """What a report holds where it cannot be filled in: errors with a reason, movements and control as they are."""
    return {"ERRORES": errors.select("*", F.coalesce(F.col("reason"), F.lit("sin detalle")).alias("detalle")).drop("reason"), "MOVIMIENTOS": movements, "CONTROL": control}
