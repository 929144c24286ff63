"""Which invoices one credit pays, when withholdings were taken off on the way.

The credit, the national withholdings known of the invoices and the provincial
one, which is only estimated, should add up to the invoices' totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored
from .matching import apart

# The pool, the largest set, and what an equation may be off (at least, and as a share of the invoices).
POOL, MOST = 10, 7
LEAST_OFF, SHARE_OFF = 50.0, 0.001
#: A credit below this share of the invoices is unlikely: so much is withheld nowhere.
COVERAGE = 0.75


def expected_provincial(total: Column, net: Column) -> Column:
    """8 % of the net amount, or of the total less 21 % where that is unknown, in cents."""
    base = F.when(F.coalesce(net, F.lit(0)) > 0, net.cast("decimal(18,2)")).otherwise(F.round(total.cast("decimal(28,10)") / F.lit(1.21).cast("decimal(3,2)"), 2).cast("decimal(18,2)"))
    return F.round(base * F.lit(0.08).cast("decimal(3,2)"), 2).cast("decimal(18,2)")


def closing_score(credit: Column, total: Column, withheld: Column, monthly: Column, expected: Column) -> Column:
    """How well a set of invoices closes with a credit (0: to the cent), null if it does not.

    With the provincial withholding of the month, the expected one or none, the
    equation is off by less than 50 or 0.1 % of the total; else what is missing is
    taken for that withholding, if it is not above the largest of 1.2 times
    either estimate and 12 % of the total. A coverage under 75 % costs extra.
    """
    credit, total, withheld, monthly, expected = (c.cast("double") for c in (credit, total, withheld, monthly, expected))
    allowed = F.greatest(F.lit(LEAST_OFF), F.abs(total) * SHARE_OFF)
    off = F.least(*[F.abs(credit + withheld + x - total) for x in (monthly, expected, F.lit(0.0))])
    missing = F.round(total - credit - withheld, 2)
    largest = F.greatest(monthly * 1.2, expected * 1.2, total * 0.12, allowed)
    guessed = F.least(F.abs(missing - monthly), F.abs(missing - expected), F.abs(missing)) * 0.01
    score = F.when(off <= allowed, off).when((missing >= -allowed) & (missing <= largest), guessed)
    covered = F.when(total != 0, credit / total).otherwise(0.0)
    return score + F.when(covered < COVERAGE, (COVERAGE - covered) * total * 0.01).otherwise(0.0)


def credit_subset(items: DataFrame, credits: DataFrame, keys: list[str], item: str, total: str, withheld: str, monthly: str, net: str, credit: str, amount: str) -> DataFrame:
    """(keys, credit, members, score): for each credit the set of two to seven of the key's ten largest items that closes best with it; the larger sum, then the larger set on a tie.

    The pool is part of the rule, so a key is ten rows whatever it has. Its subsets
    are numbered and tried in one expression; items of equal total go by id.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(total).desc(), F.col(item)))
    cents = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)")
    slim = items.select(*keys, F.col(item).alias("_id"), cents(total).alias("_t"), cents(withheld).alias("_w"), cents(monthly).alias("_m"), expected_provincial(F.col(total), F.col(net)).alias("_e"), place.alias("_place")).where(F.col("_place") <= POOL)
    pools = slim.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_place", "_id", "_t", "_w", "_m", "_e"))).alias("_pool"))
    met = credits.select(*keys, F.col(credit).alias("credit"), F.col(amount).alias("_amount")).join(pools.where(F.size("_pool") > 1), keys)
    # the first of the pool is the highest bit, so that of sets of one size the larger number is the earlier one
    picked = lambda mask: F.filter("_pool", lambda p: F.getbit(mask.cast("long"), F.size("_pool") - p["_place"]) == 1)
    sums = lambda chosen: F.aggregate(chosen, F.struct(*[F.lit(0).cast("decimal(28,2)").alias(c) for c in "twme"]), lambda s, p: F.struct(*[(s[c] + p[f"_{c}"]).cast("decimal(28,2)").alias(c) for c in "twme"]))
    numbered = F.transform(F.expr(f"filter(sequence(1, shiftleft(1, size(_pool)) - 1), m -> bit_count(m) between 2 and {MOST})"), lambda m: F.struct(m.alias("mask"), sums(picked(m)).alias("s")))
    tried = F.transform("_tried", lambda x: F.struct(closing_score(F.col("_amount"), x["s"]["t"], x["s"]["w"], x["s"]["m"], x["s"]["e"]).alias("score"), (-x["s"]["t"]).alias("t"), (-F.bit_count(x["mask"])).alias("n"), (-x["mask"]).alias("mask")))
    best = met.withColumn("_tried", numbered).withColumn("_best", F.array_min(F.filter(tried, lambda x: x["score"].isNotNull())))
    return best.where("_best is not null").select(*keys, "credit", F.transform(picked(-F.col("_best.mask")), lambda p: p["_id"]).alias("members"), F.col("_best.score").alias("score"))


# What a group of withholdings is of the invoices, how long it may come after them, and what it may be off.
SOCIAL_SHARE, VAT_SHARE = "100", "1.25"
DAYS, NEAREST = 45, 18
AT_ONCE, AT_BEST = 2, 5


#: In cents, more than four amounts of decimal(18,2) come to.
_BEYOND = 4_900_000_000_000_000_000


@cache
def _sets(n: int) -> np.ndarray:
    """The sets of two to four of n places, smaller ones first, then in order; place n stands for none."""
    rows = [[*c, *[n] * (4 - k)] for k in (2, 3, 4) for c in combinations(range(n), k)]
    return np.array(rows, np.int64).reshape(len(rows), 4)


def _closest_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, ids, places, off in 1/10,000) of groups for which a set closes; amounts and goals are cents, f what a goal has beyond them."""
    far = 1_000_000
    for batch in batches:
        kept, places, offs = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("n", "v", "gn", "gv", "f")]
        for k, (n, v, gn, gv, f) in enumerate(zip(*columns, strict=True)):
            tried = _sets(len(n))
            miss = [np.clip(goal - np.array([*x, 0], np.int64)[tried].sum(axis=1), -far, far) * 100 for goal, x in ((gn, n), (gv, v))]
            off = np.abs(miss[0]) + np.abs(miss[1] + f)
            at = int(np.argmax(off <= AT_ONCE * 10_000))
            if off[at] > AT_ONCE * 10_000:
                at = int(np.argmin(off))
            if off[at] <= AT_BEST * 10_000:
                kept.append(k)
                places.append([x for x in tried[at].tolist() if x < len(n)])
                offs.append(int(off[at]))
        chosen = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("g").take(chosen), batch.column("ids").take(chosen), pa.array(places, pa.list_(pa.int32())), pa.array(offs, pa.int64())], names=["g", "ids", "places", "off"])


def combined_withholdings(items: DataFrame, groups: DataFrame, party: str, item: str, day: str, total: str, net: str, vat: str, group: str, group_day: str, social: str, group_vat: str) -> DataFrame:
    """(group, members, off): the two to four invoices of a party that one group of withholdings was made of.

    Both amounts must fit at once: the nets come to 100 times the social security
    withheld, the VAT to 1.25 times the VAT withheld, and ``off`` is the sum of both
    differences. The first set (smaller sets first, then in the pool's order) that is
    off by 2 or less is taken, else the one that is off least, up to 5. The pool, part of
    the rule, is the 18 invoices of the 45 days up to the group that are nearest to
    it, of one day the larger.

    Of a party's day only its 18 largest can be in a pool, and groups of a party and day
    have one pool, which is made once and packed. What is tried for a group is the sets
    of its 18 rows, in the task that holds it: no pair or set of rows is a row of a table.
    """
    cents = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,2)")
    largest = F.row_number().over(Window.partitionBy(party, day).orderBy(F.col(total).desc(), F.col(item)))
    own = items.select(F.col(party).alias("p"), F.col(day).alias("_day"), F.col(item).alias("id"), F.col(total).alias("_total"), cents(net).alias("n"), cents(vat).alias("v"), largest.alias("_largest")).where(F.col("_largest") <= NEAREST)
    wanted = groups.where((F.col(social) > 0) & (F.col(group_vat) > 0)).select(F.col(party).alias("p"), F.col(group).alias("g"), F.col(group_day).alias("_until"), (cents(social) * F.lit(SOCIAL_SHARE).cast("decimal(4,0)")).cast("decimal(20,2)").alias("gn"), (cents(group_vat) * F.lit(VAT_SHARE).cast("decimal(3,2)")).cast("decimal(20,4)").alias("gv"))
    block = lambda c: F.floor(F.unix_date(c) / (DAYS + 1))
    times = wanted.select("p", "_until").distinct().withColumn("_block", F.explode(F.array(block(F.col("_until")), block(F.col("_until")) - 1)))
    near = times.join(apart(own.withColumn("_block", block(F.col("_day")))), ["p", "_block"])
    near = near.where((F.col("_day") <= F.col("_until")) & (F.datediff("_until", "_day") <= DAYS))
    place = F.row_number().over(Window.partitionBy("p", "_until").orderBy(F.datediff("_until", "_day"), F.col("_total").desc(), F.col("id")))
    whole = lambda c: (F.col(c) * 100).cast("decimal(20,0)").cast("long")
    pools = near.withColumn("i", place).where(F.col("i") <= NEAREST).groupBy("p", "_until").agg(F.sort_array(F.collect_list(F.struct("i", "id", whole("n").alias("n"), whole("v").alias("v")))).alias("_pool"))
    # goals beyond what any four amounts come to are cut there, so that cents fit a long
    goal = lambda c: F.least(F.floor(F.col(c) * 100).cast("decimal(22,0)"), F.lit(_BEYOND).cast("decimal(22,0)")).cast("long")
    fraction = ((F.col("gv") * 100 - F.floor(F.col("gv") * 100)) * 100).cast("long")
    met = wanted.join(apart(stored(pools)), ["p", "_until"]).select("g", F.transform("_pool", lambda x: x["id"]).alias("ids"), F.transform("_pool", lambda x: x["n"]).alias("n"), F.transform("_pool", lambda x: x["v"]).alias("v"), goal("gn").alias("gn"), goal("gv").alias("gv"), fraction.alias("f"))
    met = met.where(F.size("ids") > 1)
    schema = met.select("g", "ids", F.array(F.lit(0)).alias("places"), F.lit(0).cast("long").alias("off")).schema
    best = met.mapInArrow(_closest_sets, schema)
    return best.select(F.col("g").alias(group), F.transform("places", lambda k: F.get("ids", k)).alias("members"), (F.col("off").cast("decimal(16,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(20,4)").alias("off"))
