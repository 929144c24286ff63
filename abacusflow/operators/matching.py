"""Matching rows of two tables by amounts, dates, keys and names, each row used once where asked.

Candidates come from equi-joins (amounts by whole units, keys by priority); who
gets whom is settled in rounds of asking and keeping. With a strict total order
this gives what a pass over all pairs in that order would, without gathering a
group in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored


def apart(rows: DataFrame) -> DataFrame:
    """One side of a join whose sides are both dealt by key. The size of its files, which is all that a plan goes by, says little: a few MB of packed ids or of rows that grow on the way would be sent whole through the driver to every executor."""
    return rows.hint("merge")


def amount_band(left: DataFrame, right: DataFrame, left_amount: str, right_amount: str, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """Pairs whose amounts differ by at most the tolerance (and whose keys are equal): an equi-join on bands a little wider than the tolerance, on the amounts themselves where there is none."""
    width = 1.01 * max(tolerance, 0.01)
    band = lambda c: F.floor(F.col(c) / width).cast("long") if tolerance else F.col(c)
    wide = left.withColumn("_band", F.explode(F.array(band(left_amount) - 1, band(left_amount), band(left_amount) + 1)) if tolerance else band(left_amount))
    return wide.join(apart(right.withColumn("_band", band(right_amount))), [*(keys or []), "_band"]).where(F.abs(F.col(left_amount) - F.col(right_amount)) <= tolerance).drop("_band")


def one_to_one(pairs: DataFrame, left: str, right: str, order: list[Column]) -> DataFrame:
    """The pairs a greedy pass in the given order would take, each left and right at most once. Ties of the order go to the smaller left, then right.

    A round lets every left ask for its best pair; a right keeps the best that asks
    and drops all pairs that are worse, and so the other way round: what is dropped
    can be in no result. Where all lefts that have pairs ask different rights, they get
    them. Pairs that are best for both sides are settled at once. Rows that tie
    with each other and have nothing better, all with all, are taken in one round too,
    in the order of their ids.
    """
    told = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.lit(0).alias("o"))
    rest = stored(pairs.withColumn("_told", told).withColumn("_l", F.col(left)).withColumn("_r", F.col(right)))
    place = F.struct("_told", "_l", "_r")
    taken = None
    while True:
        best_left = rest.groupBy("_l").agg(F.min("_told").alias("_tl"), F.min(place).alias("_bl"))
        best_right = rest.groupBy("_r").agg(F.min("_told").alias("_tr"), F.min(place).alias("_br"))
        told_both = stored(rest.join(apart(best_left), "_l").join(apart(best_right), "_r"))
        asking = told_both.where(place == F.col("_bl"))
        n_left, n_asked = asking.agg(F.count(F.lit(1)), F.countDistinct("_r")).first()
        if n_left == n_asked:  # none at all, too
            last = asking.select(*rest.columns)
            return (last if taken is None else taken.unionByName(last)).drop("_told", "_l", "_r")
        new = stored(told_both.where((place == F.col("_bl")) & (place == F.col("_br"))).select(*rest.columns))
        # where few are settled, rows may be waiting for their equals
        if 4 * new.count() < n_left:
            new = stored(new.unionByName(_tied(told_both, rest.columns)).dropDuplicates(["_l", "_r"]))
        taken = new if taken is None else taken.unionByName(new)
        kept_right = asking.groupBy("_r").agg(F.min(place).alias("_kr"))
        kept_left = told_both.where(place == F.col("_br")).groupBy("_l").agg(F.min(place).alias("_kl"))
        alive = told_both.join(apart(kept_right), "_r", "left").join(apart(kept_left), "_l", "left").where((F.col("_kr").isNull() | (place <= F.col("_kr"))) & (F.col("_kl").isNull() | (place <= F.col("_kl"))))
        rest = stored(alive.select(*rest.columns).join(apart(new.select("_l")), "_l", "left_anti").join(apart(new.select("_r")), "_r", "left_anti"))


def _tied(told: DataFrame, columns: list[str]) -> DataFrame:
    """Of groups of lefts and rights that have nothing better than each other, all with all and all alike: the first left with the first right, the second with the second."""
    best = told.where((F.col("_told") == F.col("_tl")) & (F.col("_told") == F.col("_tr")))
    lefts = best.groupBy("_l").agg(F.min("_r").alias("_r0"), F.count(F.lit(1)).alias("_nr"))
    rights = best.groupBy("_r").agg(F.min("_l").alias("_l0"), F.count(F.lit(1)).alias("_nl"))
    # a left must have no equally good pair with a right that has better ones, and the other way round
    all_left = told.where(F.col("_told") == F.col("_tl")).groupBy("_l").agg(F.count(F.lit(1)).alias("_all_r"))
    all_right = told.where(F.col("_told") == F.col("_tr")).groupBy("_r").agg(F.count(F.lit(1)).alias("_all_l"))
    rows = best.join(apart(lefts.join(apart(all_left), "_l")), "_l").join(apart(rights.join(apart(all_right), "_r")), "_r")
    group = ["_told", "_l0", "_r0"]
    whole = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_nr").alias("_kr"), F.max("_nr").alias("_kr2"), F.min("_nl").alias("_kl"), F.max("_nl").alias("_kl2"), F.max("_all_r").alias("_ar"), F.max("_all_l").alias("_al")
    )
    whole = whole.where("_kr = _kr2 and _kl = _kl2 and _ar = _kr and _al = _kl and _n = _kr * _kl and _n > 1").select(*group)
    rows = rows.join(apart(whole), group, "left_semi")
    # ranks within a group: a left's is that of its pair with the group's first right, and so for rights
    ranks = lambda own, first: rows.where(F.col(first[0]) == F.col(first[1])).select(own, F.row_number().over(Window.partitionBy(*group).orderBy(own)).alias(f"{own}_rank"))
    return rows.join(apart(ranks("_l", ("_r", "_r0"))), "_l").join(apart(ranks("_r", ("_l", "_l0"))), "_r").where("_l_rank = _r_rank").select(*columns)


def ranked(rows: DataFrame, keys: list[str], number: str, name: str, grain: int = 100_000, cells: int = 1024) -> DataFrame:
    """Add the rank (from 1) of each row within its key by a distinct number. Where a key has more than ``grain`` rows, keys are cut into cells of the number, so that none is one task's sort."""
    most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(number).alias("a"), F.max(number).alias("b")).agg(F.max("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b")).first()  # one row
    if (most["n"] or 0) <= grain:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(number)).cast("long"))
    width = max(1, (int(most["b"]) - int(most["a"])) // cells + 1)
    placed = rows.withColumn("_cell", F.floor((F.col(number) - int(most["a"])) / width))
    counts = placed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.join(counts.select(*keys, "_cell", before.alias("_before")), [*keys, "_cell"])
    here = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(number))
    return placed.withColumn(name, (F.col("_before") + here).cast("long")).drop("_cell", "_before")


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keys: list[list[Column]], right_keys: list[list[Column]]) -> DataFrame:
    """(left_id, right_id, level): rows matched on the first of several keys, by priority, each row once; a key with a null part never matches.

    All rows with equal keys fit each other, so a pass in the order of ids pairs
    the first left with the first right and so on: both sides are ranked within
    their key and joined on key and rank, with no pair more than is taken. A level
    works on what the ones before left. Ids are distinct numbers.
    """
    names = [[f"_k{level}_{n}" for n in range(len(parts))] for level, parts in enumerate(left_keys)]

    def slim(df: DataFrame, own: str, keys: list[list[Column]]) -> DataFrame:
        return stored(df.select(own, *[c.alias(n) for parts, told in zip(keys, names, strict=True) for c, n in zip(parts, told, strict=True)]))

    left, right = slim(left, left_id, left_keys), slim(right, right_id, right_keys)
    out = None
    for level, on in enumerate(names):

        def keyed(df: DataFrame, own: str) -> DataFrame:
            rest = df if out is None else df.join(apart(out.select(own)), own, "left_anti")  # noqa: B023
            return ranked(rest.select(own, *on).dropna(subset=on), on, own, "_rank")  # noqa: B023

        found = stored(keyed(left, left_id).join(apart(keyed(right, right_id)), [*on, "_rank"]).select(left_id, right_id, F.lit(level).alias("level")))
        out = found if out is None else out.unionByName(found)
    return out


def best_of(pairs: DataFrame, left: str, order: list[Column], columns: list[str]) -> DataFrame:
    """For each left row its best pair; rights may be used again."""
    return pairs.groupBy(left).agg(F.min_by(F.struct(*columns), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)])).alias("_b")).select(left, "_b.*")


def leftovers(left: DataFrame, right: DataFrame, matches: DataFrame, left_id: str, right_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows of either side that no match uses."""
    return left.join(apart(matches.select(left_id)), left_id, "left_anti"), right.join(apart(matches.select(right_id)), right_id, "left_anti")


def staged(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list) -> DataFrame:
    """Several matchers, each on what the ones before left over. A pass: (name, f(left, right) -> pairs, order)."""
    out = None
    for name, find, order in passes:
        # only what ranks a pair goes through the rounds
        told = [f"_order{k}" for k in range(len(order))]
        pairs = find(left, right).select(left_id, right_id, *[c.alias(n) for c, n in zip(order, told, strict=True)])
        found = stored(one_to_one(pairs, left_id, right_id, [F.col(n) for n in told]).select(left_id, right_id).withColumn("stage", F.lit(name)))
        out = found if out is None else out.unionByName(found)
        left, right = (stored(x) for x in leftovers(left, right, found, left_id, right_id))
    return out


def released(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list, release: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(left_id, right_id, stage, round): ``staged``, again and again: after each round ``release`` names matches that do not hold (of left_id, right_id, stage), their rows are free again and all free rows are offered anew.

    A pair that was released is never offered again, so every round that releases
    anything leaves fewer pairs to try, and the rounds end. What a round has kept
    stays.
    """
    kept, barred, number = None, None, 0
    free_left, free_right = left, right
    while True:
        number += 1

        def open_pairs(find, barred=barred):
            return find if barred is None else lambda p, q: find(p, q).join(barred, [left_id, right_id], "left_anti")

        found = stored(staged(free_left, free_right, left_id, right_id, [(name, open_pairs(find), order) for name, find, order in passes]))
        back = stored(release(found).select(left_id, right_id).distinct())
        held = found.join(back, [left_id, right_id], "left_anti").withColumn("round", F.lit(number))
        kept = stored(held if kept is None else kept.unionByName(held))
        if back.isEmpty():
            return kept
        barred = stored(back if barred is None else barred.unionByName(back))
        free_left, free_right = (stored(x) for x in leftovers(left, right, kept, left_id, right_id))


def _blocked(items: DataFrame, keys: list[str], item: str, grain: int) -> tuple[DataFrame, DataFrame]:
    """Items with a block of about ``grain`` items of their key, and (keys, _block): every block of every key."""
    counts = items.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / grain).cast("int").alias("_blocks"))
    blocks = counts.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    return items.join(counts, keys).withColumn("_block", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int")).drop("_blocks"), blocks


def subset_sums(items: DataFrame, targets: DataFrame, keys: list[str], item: str, amount: str, target: str, goal: str, tolerance: float, most: int = 3, grain: int = 256) -> DataFrame:
    """(keys, target, members): the sets of up to ``most`` (1 to 4) items of a key whose amounts, of any sign, add up to a target; the closest, then the smallest set, then the least ids.

    All items of a key are tried. What a target still lacks after its first item
    meets single items and sums of two by amount bands, for four after its first
    two. The sums of two are all pairs of a key, made once and not per target; a
    key is dealt in blocks of ``grain`` items. Larger sets are only looked for
    where smaller ones are not exact, and must be closer.
    """
    if not 1 <= most <= 4:
        raise ValueError("most must be 1 to 4")
    base, blocks = _blocked(items.select(*keys, F.col(item).alias("a"), F.col(amount).alias("xa")), keys, "a", grain)
    base = stored(base)
    one = base.drop("_block")
    two = one.select(*keys, F.col("a").alias("b"), F.col("xa").alias("xb"))
    goals = targets.select(*keys, F.col(target).alias("target"), F.col(goal).alias("goal"))
    met = ["off", "n", "members"]

    def best(found: DataFrame, off: Column, members: list[str]) -> DataFrame:
        told = F.struct(F.abs(off).alias("off"), F.lit(len(members)).alias("n"), F.array(*members).alias("members"))
        return found.groupBy(*keys, "target").agg(F.min(told).alias("_b")).select(*keys, "target", "_b.*")

    def less(done: DataFrame) -> DataFrame:
        return done.groupBy(*keys, "target").agg(F.min(F.struct(*met)).alias("_b")).select(*keys, "target", "_b.*")

    def still(done: DataFrame) -> DataFrame:
        reached = done.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("target").alias("_t"), F.col("off").alias("_reached"))
        same = F.col("target") == F.col("_t")
        for n, k in enumerate(keys):
            same = same & (F.col(k) == F.col(f"_k{n}"))
        return goals.join(reached, same, "left").where("_reached is null or _reached > 0").select(*goals.columns, "_reached")

    def first(wanted: DataFrame) -> DataFrame:
        return wanted.join(blocks, keys).join(base, [*keys, "_block"]).drop("_block").withColumn("rest", F.col("goal") - F.col("xa"))

    closer = lambda off: F.col("_reached").isNull() | (F.abs(off) < F.col("_reached"))
    off = F.col("goal") - F.col("xa")
    done = best(amount_band(goals, one, "goal", "xa", tolerance, keys), off, ["a"])
    if most >= 2:
        off = F.col("rest") - F.col("xb")
        done = stored(less(done.unionByName(best(amount_band(first(goals), two, "rest", "xb", tolerance, keys).where("a < b"), off, ["a", "b"]))))
    if most >= 3:
        pairs = base.join(two.join(blocks, keys), [*keys, "_block"]).where("a < b").withColumn("sum", F.col("xa") + F.col("xb"))
        last = pairs.select(*keys, F.col("a").alias("c"), F.col("b").alias("d"), F.col("sum").alias("xcd"))
        off = F.col("rest") - F.col("xcd")
        trio = amount_band(first(still(done)), last, "rest", "xcd", tolerance, keys).where(F.expr("a < c") & closer(off))
        done = stored(less(done.unionByName(best(trio, off, ["a", "c", "d"]))))
    if most >= 4:
        half = still(done).join(blocks, keys).join(pairs, [*keys, "_block"]).withColumn("rest", F.col("goal") - F.col("sum")).select(*keys, "target", "_reached", "a", "b", "rest")
        four = amount_band(half, last, "rest", "xcd", tolerance, keys).where(F.expr("b < c") & closer(off))
        done = less(done.unionByName(best(four, off, ["a", "b", "c", "d"])))
    return done.select(*keys, "target", "members", "off")


def shared_words(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_name: Column, right_name: Column, least: int = 2, longer_than: int = 3) -> DataFrame:
    """(left_id, right_id, shared): names that share at least so many words of some length.

    Names that share ``least`` words share one of each name's rarest words, all but
    its ``least`` - 1 most common. So names meet on these alone, and a word that most
    names have ("sociedad") brings none together but those that have nothing rarer.
    """

    def worded(df: DataFrame, own: str, name: Column, side: str) -> DataFrame:
        words = F.array_distinct(F.filter(F.split(name, " "), lambda x: F.length(x) > longer_than))
        return df.select(F.col(own).alias("_id"), words.alias("_words"), F.lit(side).alias("_side")).where(F.size("_words") >= least)

    both = stored(worded(left, left_id, left_name, "l").unionByName(worded(right, right_id, right_name, "r")))
    each = both.select("_side", "_id", F.explode("_words").alias("_word"))
    counts = each.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    order = F.array_sort(F.collect_list(F.struct("_n", "_word")))
    rare = each.join(counts, "_word").groupBy("_side", "_id").agg(order.alias("_o")).select("_side", "_id", F.explode(F.slice("_o", F.lit(1), F.size("_o") - (least - 1))).alias("_w"))
    rare = stored(rare.select("_side", "_id", "_w._word"))
    side = lambda name, own: rare.where(F.col("_side") == name).select(F.col("_id").alias(own), "_word")
    met = side("l", "_l").join(side("r", "_r"), "_word").select("_l", "_r").distinct()
    words = lambda name, own, as_: both.where(F.col("_side") == name).select(F.col("_id").alias(own), F.col("_words").alias(as_)).dropDuplicates([own])
    told = met.join(words("l", "_l", "_a"), "_l").join(words("r", "_r", "_b"), "_r").withColumn("shared", F.size(F.array_intersect("_a", "_b")).cast("long"))
    return told.where(F.col("shared") >= least).select(F.col("_l").alias(left_id), F.col("_r").alias(right_id), "shared")


def closest_subset(items: DataFrame, targets: DataFrame, keys: list[str], item: str, amount: str, target: str, goal: str, order: list[str], pool: int = 10, most: int = 7) -> DataFrame:
    """(keys, target, members, off): of the first ``pool`` items of a key by order, the subset of up to ``most`` whose amounts come closest to the goal.

    The pool is part of the rule; its subsets are numbered and tried in one
    expression, at most 2 ** pool of them.
    """
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, item))).where(F.col("_rank") <= pool)
    packed = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", F.col(item).alias("id"), F.col(amount).alias("x")))).alias("_pool"))
    met = targets.select(*keys, F.col(target).alias("target"), F.col(goal).alias("_goal")).join(packed, keys)
    picked = lambda mask: F.filter("_pool", lambda p: F.getbit(mask.cast("long"), p["_rank"] - 1) == 1)
    total = lambda chosen: F.aggregate(chosen, F.lit(0).cast("decimal(28,2)"), lambda s, p: (s + p["x"]).cast("decimal(28,2)"))
    tried = F.transform(F.sequence(F.lit(1), F.expr("shiftleft(1, size(_pool)) - 1")), lambda m: F.struct(F.abs(F.col("_goal") - total(picked(m))).alias("off"), F.bit_count(m).alias("n"), m.alias("mask")))
    best = F.array_min(F.filter(tried, lambda t: t["n"] <= most))
    out = met.withColumn("_best", best)
    return out.select(*keys, "target", F.transform(picked(F.col("_best.mask")), lambda p: p["id"]).alias("members"), F.col("_best.off").alias("off"))


def by_amount_else(rows: DataFrame, ledger: DataFrame, row_id: str, ledger_id: str, amount: str, account: str, fallback: Column) -> DataFrame:
    """Add ``account``: of the ledger row with the same amount, each used once in the order of ids; else the fallback."""
    pairs = rows.select(row_id, amount).join(ledger.select(ledger_id, amount, account), amount)
    taken = one_to_one(pairs, row_id, ledger_id, []).select(row_id, account)
    return rows.withColumn("_fallback", fallback).join(taken, row_id, "left").withColumn(account, F.coalesce(account, "_fallback")).drop("_fallback")


def payment_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_number: str, right_number: str, left_amount: str, right_amount: str, left_day: str, right_day: str, tolerance: float = 1.0, days: int = 3) -> DataFrame:
    """(left_id, right_id, by, off): each left row's payment, by its number whatever amount and day, else the closest amount within the tolerance and some days. A payment may serve several."""
    both = [left_id, right_id, left_amount, right_amount]
    numbered = left.where((F.col(left_number) != "") & F.col(left_number).isNotNull())
    by_number = numbered.join(right, numbered[left_number] == right[right_number]).select(*both, F.lit("number").alias("by"))
    near = amount_band(left, right, left_amount, right_amount, tolerance).where(F.abs(F.datediff(left_day, right_day)) <= days).select(*both, F.lit("amount").alias("by"))
    found = by_number.unionByName(near).withColumn("off", F.abs(F.col(left_amount) - F.col(right_amount)))
    return best_of(found, left_id, [F.col("by") != "number", F.when(F.col("by") == "amount", F.col("off")), F.col(right_id)], [right_id, "by", "off"])
