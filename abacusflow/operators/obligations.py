"""Obligations, withholdings and invoices against what a bank debited, in the passes that bookkeepers make.

Candidates come from equi-joins on party and amount bands; each pass works on what
the ones before left, and takes each row once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import within_days_or_month
from ..sources.scratch import stored
from . import strips
from .matching import amount_band, apart, leftovers, one_to_one, subset_sums

PAID, PARTLY, OPEN, UNCOVERED = "PAGADO", "PARCIAL", "FALTA", "SIN EXTRACTO"


def preference(text: Column, keywords: tuple[str, ...]) -> Column:
    """The place of the first keyword that a text has, their number where it has none; less is better."""
    return F.coalesce(*[F.when(text.contains(w), k) for k, w in enumerate(keywords)], F.lit(len(keywords)))


def _near(obligations: DataFrame, debits: DataFrame, target: str, keywords: tuple[str, ...], tolerance: float) -> DataFrame:
    pairs = amount_band(obligations, debits, target, "paid", tolerance, ["party"]).where(within_days_or_month(F.col("day"), F.col("paid_day")))
    return pairs.withColumns({"_word": preference(F.col("text"), keywords), "_days": F.abs(F.datediff("day", "paid_day")), "_off": F.abs(F.col(target) - F.col("paid"))})


def settled(obligations: DataFrame, debits: DataFrame, keywords: tuple[str, ...] = (), tolerance: float = 1.0) -> DataFrame:
    """Every obligation with ``debit``, ``state``, ``stage`` and ``candidates``: how many debits would have done for it alone.

    Obligations: obligation, party, bundle, day, total, base. Debits: debit, party,
    paid_day, paid, text. First whole bundles (of two or more) that one debit pays;
    then single ones by their total (PAGADO) or base (PARCIAL); last, an amount of
    any date with a keyword, if it is the only candidate. Within a pass: better
    keyword, fewer days, less difference. What is open is SIN EXTRACTO where its
    day is in no month that the party has debits of, else FALTA.
    """
    order = [F.col("_word"), F.col("_days"), F.col("_off")]
    sums = obligations.where("bundle is not null").groupBy("party", "bundle").agg(F.sum("total").alias("total"), F.max("day").alias("day"), F.count(F.lit(1)).alias("_n"), F.min("obligation").alias("_first")).where("_n > 1")
    pairs = _near(sums, debits, "total", keywords, tolerance).select("_first", "debit", "party", "bundle", "_word", "_days", "_off")
    bundles = stored(one_to_one(pairs, "_first", "debit", order).select("party", "bundle", "debit"))
    in_bundle = stored(obligations.join(apart(bundles), ["party", "bundle"]).select("obligation", "debit", F.lit(PAID).alias("state"), F.lit("bundle").alias("stage")))
    left, free = stored(obligations.join(apart(in_bundle.select("obligation")), "obligation", "left_anti")), stored(debits.join(apart(bundles.select("debit")), "debit", "left_anti"))
    both = None
    for target, state in (("total", PAID), ("base", PARTLY)):
        one = _near(left.where(F.col(target).isNotNull()), free, target, keywords, tolerance).select("obligation", "debit", *order, F.lit(state).alias("state"))
        both = one if both is None else both.unionByName(one)
    both = stored(both.withColumn("_paid", (F.col("state") != PAID).cast("int")))
    candidates = both.groupBy("obligation").agg(F.count_distinct("debit").alias("candidates"))
    best = both.groupBy("obligation", "debit").agg(F.min(F.struct("_word", "_days", "_off", "_paid", "state")).alias("_b")).select("obligation", "debit", "_b.*")
    single = stored(one_to_one(best, "obligation", "debit", [*order, F.col("_paid")]).select("obligation", "debit", "state", F.lit("single").alias("stage")))
    left, free = leftovers(left, free, single, "obligation", "debit")
    late = stored(amount_band(left, free, "total", "paid", tolerance, ["party"]).where(preference(F.col("text"), keywords) < len(keywords)).select("obligation", "debit"))
    alone = late.groupBy("obligation").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("obligation")
    last = one_to_one(late.join(apart(alone), "obligation", "left_semi"), "obligation", "debit", []).select("obligation", "debit", F.lit(PAID).alias("state"), F.lit("only").alias("stage"))
    months = debits.select("party", F.trunc("paid_day", "MM").alias("_m")).distinct().withColumn("_there", F.lit(True))
    out = obligations.join(apart(in_bundle.unionByName(single).unionByName(last)), "obligation", "left").join(apart(candidates), "obligation", "left")
    out = out.withColumn("_m", F.trunc("day", "MM")).join(apart(months), ["party", "_m"], "left")
    state = F.coalesce("state", F.when(F.col("_there").isNull(), UNCOVERED).otherwise(OPEN))
    return out.select("obligation", F.coalesce("debit", F.lit(0)).alias("debit"), state.alias("state"), F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def scored_assignment(withheld: DataFrame, invoices: DataFrame, days: int = 45, per_day: int = 10) -> DataFrame:
    """(withholding, invoice, score) of withholdings (withholding, party, held_day, ss, iva, gan) and invoices (invoice, party, day, net, vat) of the ``days`` before them.

    The score adds how far social security is from 1 % of the net, VAT from 80 %
    of the tax and income tax from 2 % of the net, and some for every day; all
    pairs are taken in order of the score, each row once. Pairs meet by party and
    stretches of days.
    """
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days).cast("long")
    wide = withheld.withColumn("_s", F.explode(F.array(stretch("held_day") - 1, stretch("held_day"))))
    pairs = wide.join(apart(invoices.withColumn("_s", stretch("day"))), ["party", "_s"]).withColumn("_days", F.datediff("held_day", "day")).where(F.col("_days").between(0, days))
    share = lambda c, part: F.round(F.col(c) * F.lit(part).cast("decimal(4,2)"), 2)
    off = [F.abs(F.col(a) - share(c, p)) for a, c, p in (("ss", "net", "0.01"), ("iva", "vat", "0.80"), ("gan", "net", "0.02"))]
    pairs = pairs.withColumn("score", (off[0] + off[1] + off[2] + F.col("_days") * per_day).cast("decimal(18,2)"))
    return one_to_one(pairs.select("withholding", "invoice", "score"), "withholding", "invoice", [F.col("score")]).select("withholding", "invoice", "score")


def _scored_passes(debits: DataFrame, invoices: DataFrame, score: Column, tolerance: float, least: float) -> DataFrame:
    """The passes over single rows, for a score that is any column over both: all pairs are made."""
    days = F.abs(F.datediff("paid_day", "day"))

    def only(found: DataFrame) -> DataFrame:
        for side in ("debit", "invoice"):
            found = found.join(apart(found.groupBy(side).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(side)), side, "left_semi")
        return found

    passes = [
        ("name", lambda p: p.where(f"_days <= 3 and _score >= {least}"), [F.col("_days"), -F.col("_score")]),
        ("amount", lambda p: p.where("_days <= 3"), [F.col("_days")]),
        ("unique", lambda p: only(p.where("_days <= 15")), []),
        ("late", lambda p: p.where(f"_score >= {least}"), [-F.col("_score"), F.col("_days")]),
    ]
    out = None
    pairs = amount_band(debits, invoices, "paid", "amount", tolerance).withColumn("_days", days).withColumn("_score", score)
    scored = stored(pairs.select("debit", "invoice", "_days", "_score"))  # once for all passes
    for name, keep, order in passes:
        found = stored(one_to_one(keep(scored), "debit", "invoice", order).select("debit", "invoice", F.lit(name).alias("stage")))
        out = found if out is None else out.unionByName(found)
        scored = stored(scored.join(apart(found.select("debit")), "debit", "left_anti").join(apart(found.select("invoice")), "invoice", "left_anti"))
    return out


def _only_candidates(debits: DataFrame, invoices: DataFrame, tolerance: float, days: int) -> DataFrame:
    """(debit, invoice) of debits with one invoice within the tolerance and some days, where no other such debit has it. Rows of one amount and day meet as one."""
    stretch = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (days + 1)).cast("long")
    kinds = lambda df, own, amount, day: df.where(F.col(day).isNotNull()).groupBy(amount, day).agg(F.min(own).alias(own), F.count(F.lit(1)).alias(f"_n_{own}"))
    mine, theirs = kinds(debits.where("debit is not null"), "debit", "paid", "paid_day"), kinds(invoices, "invoice", "amount", "day")
    wide = mine.withColumn("_s", F.explode(F.array(*[stretch("paid_day") + k for k in (-1, 0, 1)])))
    pairs = amount_band(wide, theirs.withColumn("_s", stretch("day")), "paid", "amount", tolerance, ["_s"]).where(F.abs(F.datediff("paid_day", "day")) <= days)
    one = pairs.groupBy("debit", "_n_debit").agg(F.sum("_n_invoice").alias("_n"), F.min("invoice").alias("invoice")).where("_n = 1")
    return one.groupBy("invoice").agg(F.sum("_n_debit").alias("_n"), F.min("debit").alias("debit")).where("_n = 1 and invoice is not null").select("debit", "invoice")


def _named_passes(debits: DataFrame, invoices: DataFrame, tolerance: float, least: float) -> DataFrame:
    """The passes over single rows, for the score of the names ``_left`` and ``_right``: strip by strip of amounts."""
    left = lambda df: df.select(F.col("debit").alias("id"), F.col("paid").alias("amount"), F.col("paid_day").alias("day"), F.col("_left").alias("name"))
    right = lambda df: df.select(F.col("invoice").alias("id"), "amount", "day", F.col("_right").alias("name"))
    stage = lambda found, name: found.select(F.col("l").alias("debit"), F.col("r").alias("invoice"), name.alias("stage"))
    out = stage(strips.settled(left(debits), right(invoices), tolerance, strips.near_days(least, 3)), F.when(F.col("tag") == 0, "name").otherwise("amount"))
    debits, invoices = (stored(x) for x in leftovers(debits, invoices, out, "debit", "invoice"))
    found = stored(_only_candidates(debits, invoices, tolerance, 15).select("debit", "invoice", F.lit("unique").alias("stage")))
    debits, invoices = leftovers(debits, invoices, found, "debit", "invoice")
    late = strips.settled(left(debits), right(invoices), tolerance, strips.any_day(least))
    return out.unionByName(found).unionByName(stage(late, F.lit("late")))


def matched_by_passes(debits: DataFrame, invoices: DataFrame, score: Column | tuple[Column, Column], tolerance: float = 1.0, least: float = 62.0) -> DataFrame:
    """(debit, invoice, stage) of debits (debit, paid_day, paid, text) and invoices (invoice, day, amount, name).

    ``score`` is a column over both or, so that no pairs of rows need be made, the folded name that a
    debit and that an invoice has, scored by their words (0 to 100; amounts of two decimals then).

    name: amount within the tolerance, three days and a score; amount: the same
    without a score, or within 15 days if neither side has another candidate;
    late: a score and the amount, at any date; sums: two invoices for one debit, or
    two debits for one invoice, of the same day's week.
    """
    if isinstance(score, Column):
        out = _scored_passes(debits, invoices, score, tolerance, least)
    else:
        debits = stored(debits.select("debit", "paid_day", "paid", score[0].alias("_left")))
        invoices = stored(invoices.select("invoice", "day", "amount", score[1].alias("_right")))
        out = _named_passes(debits, invoices, tolerance, least)
    debits, invoices = (stored(x) for x in leftovers(debits, invoices, out, "debit", "invoice"))
    for name, goals, items, goal, item, paid, amount, when, then in (("two_invoices", debits, invoices, "debit", "invoice", "paid", "amount", "paid_day", "day"), ("two_debits", invoices, debits, "invoice", "debit", "amount", "paid", "day", "paid_day")):
        week = lambda df, c: df.withColumn("_week", F.date_trunc("week", c))
        sums = subset_sums(week(items, then), week(goals, when), ["_week"], item, amount, goal, paid, tolerance, most=2).where(F.size("members") == 2)
        found = stored(sums.select(F.col("target").alias(goal), F.explode("members").alias(item), "off"))
        # an item serves one sum: the one with the least difference
        first = found.groupBy(item).agg(F.min(F.struct("off", goal)).alias("_f")).select(item, F.col("_f")[goal].alias(goal))
        whole = first.groupBy(goal).agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select(goal)
        taken = stored(first.join(apart(whole), goal, "left_semi").select("debit", "invoice", F.lit(name).alias("stage")))
        out = out.unionByName(taken)
        debits, invoices = (stored(x) for x in leftovers(debits, invoices, taken, "debit", "invoice"))
    return out
