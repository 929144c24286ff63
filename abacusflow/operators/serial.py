"""Row-by-row assignment, worked out for all rows together.

A loop takes the left rows in the order of their ids; each takes the first right
row, by its own list of keys, that no earlier left has taken. A key that a later
left holds may thus be lost to an earlier one on a worse key of its own. The same
result comes from proposals: every left asks the first right that has not refused
it, a right keeps the earliest left that has asked it so far and refuses the
others, and those ask on. As all rights rank lefts alike, the outcome does not
depend on who asks when, so any number may ask at once.

A round settles each key by itself: a sweep over its rights, in order, gives each
the earliest asking left, past rights that an earlier left holds. Rights that two
keys have given away go to the earlier left; who loses or is pushed out asks again
in the next round. Lefts with equal keys, however many, are thus settled in one
round. Where a key has over ``GRAIN`` rows, its lefts and rights are numbered in
cells, and a round takes the first cell of lefts that ask and the first cell of rights
that has one for them.

After the keys come softer rules, worked out for those lefts alone that need them:
lists of pairs, and at the very end a right that is the only one left of its key.
Whether it is the only one depends on what all earlier lefts take. So it is assumed
of those of whom it seems so, all is worked out, and what turned out wrong is taken
back, until all assumptions hold; each pass settles at least one more left in order.

Ids are distinct numbers and order both sides.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .matching import amount_band, apart, ranked

GRAIN = 200_000
#: Rows of small keys that are settled together, about.
TOGETHER = 1 << 14
SOFT, LONE = 1_000, 1_000_000
_FREE = np.iinfo(np.int64).max


def _swept(rights: list[tuple], asking: list[tuple[int, int]], more: bool) -> list[tuple[int, int, int | None, bool]]:
    """(left, level, right or None, waits) of all that ask, and of those they push out of the same key. A right: (id, holder, level if the holder has it by this key)."""
    out, at = [], 0
    heapq.heapify(asking)
    while asking:
        left, level = heapq.heappop(asking)
        while at < len(rights) and rights[at][1] < left:
            at += 1
        if at == len(rights):
            out.append((left, level, None, more))
            continue
        right, holder, by = rights[at]
        if by is not None:
            heapq.heappush(asking, (holder, by))
        out.append((left, level, right, False))
        at += 1
    return out


def _settled(table: pa.Table) -> pa.Table:
    """The sweep of every key of a table (key, r, l, level, more): rights with their holder (l is null where free), and asking lefts (r is null)."""
    table = table.sort_by([("key", "ascending"), ("r", "ascending")])
    keys, found = table.column("key").to_pylist(), []
    rows = list(zip(*(table.column(c).to_pylist() for c in ("r", "l", "level", "more")), strict=True))
    at = 0
    while at < len(keys):
        to = at
        rights, asking, more = [], [], False
        while to < len(keys) and keys[to] == keys[at]:
            r, left, level, goes_on = rows[to]
            if r is None:
                asking.append((left, level))
            else:
                rights.append((r, _FREE if left is None else left, level))
                more = more or goes_on
            to += 1
        found += [(keys[at], *x) for x in _swept(rights, asking, more)]
        at = to
    columns = list(zip(*found, strict=True)) if found else [[]] * 5
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("key", "l", "level", "r", "waits"), columns, kinds, strict=True)})


def _in_cells(rows: DataFrame, number: str, grain: int) -> DataFrame:
    """Add ``cell``: which ``grain`` rows of its key, by number, a row belongs to."""
    return ranked(rows, ["key"], number, "_rank", grain).withColumn("cell", F.floor((F.col("_rank") - 1) / grain).cast("int")).drop("_rank")


class _State:
    """Keys of both sides, who holds what, and who asks next."""

    def __init__(self, lefts: DataFrame, rights: DataFrame, grain: int):
        self.grain = grain
        self.lefts, self.rights = stored(lefts), stored(rights)
        most = self.rights.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        asks = self.lefts.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        self.hot = max(most, asks) > grain
        if self.hot:
            self.lefts, self.rights = stored(_in_cells(self.lefts, "l", grain)), stored(_in_cells(self.rights, "r", grain))
        self.start()

    def start(self) -> None:
        """Nobody holds anything; everybody asks by the first key."""
        self.held = self.lefts.sparkSession.createDataFrame([], "r long, l long, level int, key string")
        self.asking = stored(self._first(self.lefts))

    def _first(self, rows: DataFrame) -> DataFrame:
        told = ["level", "key", *(["cell"] if self.hot else [])]
        return rows.groupBy("l").agg(F.min(F.struct(*told)).alias("_f")).select("l", "_f.*")

    def add(self, lefts: DataFrame, rights: DataFrame, asking: bool = True) -> None:
        """More keys, each of few rows; their lefts ask by the first of them."""
        cell = (lambda df: df.withColumn("cell", F.lit(0))) if self.hot else (lambda df: df)
        lefts, rights = cell(stored(lefts)), cell(stored(rights))
        self.lefts, self.rights = self.lefts.unionByName(lefts), self.rights.unionByName(rights)
        if asking:
            self.asking = stored(self.asking.unionByName(self._first(lefts)))

    def run(self) -> None:
        """Rounds until nobody asks."""
        while n := self.asking.count():
            self._round(n)

    def _round(self, n: int) -> None:
        asking, wait = self.asking, None
        keys = asking.select("key").distinct()
        rights = self.rights.join(keys, "key", "left_semi").join(self.held.select("r", "l", F.col("level").alias("_level"), F.col("key").alias("_by")), "r", "left")
        rights = rights.withColumn("level", F.when(F.col("_by") == F.col("key"), F.col("_level")))
        more = F.lit(False)
        if self.hot:
            asking = asking.join(asking.groupBy("key").agg(F.min("cell").alias("_cell")), "key")
            wait = asking.where("cell > _cell").drop("_cell")
            asking = stored(asking.where("cell = _cell").drop("_cell"))
            least = asking.groupBy("key").agg(F.min("l").alias("_least"))
            rights = stored(rights)
            cells = rights.groupBy("key", "cell").agg(F.max(F.coalesce("l", F.lit(_FREE))).alias("_top"))
            last = cells.groupBy("key").agg(F.max("cell").alias("_last"))
            chosen = cells.join(least, "key").where(F.col("_top") > F.col("_least")).groupBy("key").agg(F.min("cell").alias("cell")).join(last, "key")
            rights = rights.join(chosen, ["key", "cell"])
            more = F.col("cell") < F.col("_last")
        rows = rights.select("key", "r", "l", "level", more.alias("more")).unionByName(asking.select("key", F.lit(None).cast("long").alias("r"), "l", "level", F.lit(False).alias("more")))
        groups = max(1, n // TOGETHER)
        by = F.col("key") if self.hot else F.pmod(F.xxhash64("key"), F.lit(groups))
        out = stored(rows.withColumn("_group", by).groupBy("_group").applyInArrow(lambda t: _settled(t.drop_columns(["_group"])), "key string, l long, level int, r long, waits boolean"))
        best = out.where("r is not null").groupBy("r").agg(F.min(F.struct("l", "level", "key")).alias("_b")).select("r", "_b.*")
        told = ["l", "level", "key"]
        lost = out.where("r is not null").join(best.select("r", F.col("l").alias("_won")), "r").where("l > _won").select(*told)
        pushed = self.held.join(best.select("r"), "r", "left_semi").join(out.select("l"), "l", "left_anti").select(*told)
        waits = out.where("waits").select(*told)
        again = lost.unionByName(pushed).unionByName(waits)
        passed = out.where("r is null and not waits").select("l", F.col("level").alias("_past"))
        if self.hot:
            again = again.join(self.lefts.select("l", "key", "cell"), ["l", "key"])
        on = self._first(self.lefts.join(passed, "l").where("level > _past"))
        nxt = again.unionByName(on.select(*again.columns))
        if wait is not None:
            nxt = nxt.unionByName(wait.select(*nxt.columns))
        held = self.held.join(best.select("r"), "r", "left_anti").unionByName(best.select(*self.held.columns))
        # both in one table: who holds something has an r
        both = stored(held.unionByName(nxt, allowMissingColumns=True))
        self.held, self.asking = both.where("r is not null").select(*self.held.columns), both.where("r is null").select(*self.asking.columns)


def _tops(keys: DataFrame, held: DataFrame) -> DataFrame:
    """(key, most, next): of the rights (r, key) of each key the latest holder and the one after; a free right counts as held last of all."""
    rows = keys.join(held.select("r", "l"), "r", "left").select("key", F.struct(F.coalesce("l", F.lit(_FREE)).alias("l"), "r").alias("_h"))
    first = rows.groupBy("key").agg(F.max("_h").alias("_m"))
    second = rows.join(first, "key").where(F.col("_h") < F.col("_m")).groupBy("key").agg(F.max("_h.l").alias("next"))
    return first.join(second, "key", "left").select("key", F.col("_m.l").alias("most"), "next")


def serial_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_keys: Column, right_keys: Column, soft: list[Callable[[DataFrame], DataFrame]] | None = None, lone: tuple[Column, Column] | None = None, grain: int = GRAIN) -> DataFrame:
    """(left_id, right_id, key): what a loop over lefts would take, each right once.

    ``left_keys``: an array of strings, best first; ``right_keys``: an array of the
    strings a right is found by; nulls in them are no keys. ``soft``: functions from
    lefts to pairs (left_id, right_id), tried in order where no key has a free right,
    rights in order. ``lone``: at last, a right that is the only one not taken with
    the same value as the left. The key is "soft0", "soft1", .. and "lone" there.
    """
    lefts = left.select(F.col(left_id).cast("long").alias("l"), F.posexplode(F.array_distinct(F.filter(left_keys, lambda k: k.isNotNull()))).alias("level", "key"))
    rights = right.select(F.col(right_id).cast("long").alias("r"), F.explode(F.array_distinct(F.filter(right_keys, lambda k: k.isNotNull()))).alias("key"))
    lefts, rights = stored(lefts), stored(rights)
    state = _State(lefts.join(rights.select("key").distinct(), "key", "left_semi").select("l", "level", "key"), rights.join(lefts.select("key").distinct(), "key", "left_semi").select("r", "key"), grain)
    every = stored(left.select(F.col(left_id).cast("long").alias("l")))
    asked = every.limit(0)  # whose soft pairs are known

    def run() -> None:
        nonlocal asked
        while True:
            state.run()
            if not soft:
                return
            new = stored(every.join(state.held.select("l"), "l", "left_anti").join(asked, "l", "left_anti"))
            if new.isEmpty():
                return
            asked = asked.unionByName(new)
            mine, pairs = left.join(new, F.col(left_id).cast("long") == new["l"], "left_semi"), None
            for k, rule in enumerate(soft):
                found = rule(mine).select(F.col(left_id).cast("long").alias("l"), F.col(right_id).cast("long").alias("r"), F.lit(SOFT + k).alias("level"))
                pairs = found if pairs is None else pairs.unionByName(found)
            pairs = stored(pairs.withColumn("key", F.concat(F.lit("soft"), F.col("level") - SOFT, F.lit(":"), F.col("l"))))
            state.add(pairs.select("l", "level", "key").distinct(), pairs.select("r", "key"))

    run()
    if lone is not None:
        own = stored(left.select(F.col(left_id).cast("long").alias("l"), F.concat(F.lit("lone:"), lone[0]).alias("key")).where("key is not null"))
        theirs = stored(right.select(F.col(right_id).cast("long").alias("r"), F.concat(F.lit("lone:"), lone[1]).alias("key")).where("key is not null").join(own.select("key"), "key", "left_semi"))
        before, allowed, known = state.lefts, own.limit(0), False
        while True:
            tops = stored(_tops(theirs, state.held))
            wrong = stored(state.held.where(F.col("level") == LONE).join(tops, "key").where((F.col("most") > F.col("l")) | (F.col("next") >= F.col("l"))).select("l", "key"))
            free = own.join(state.held.select("l"), "l", "left_anti").join(allowed, ["l", "key"], "left_anti")
            new = stored(free.join(tops, "key").where((F.col("most") > F.col("l")) & (F.col("next").isNull() | (F.col("next") < F.col("l")))).select("l", "key"))
            back = not wrong.isEmpty()
            if not back and new.isEmpty():
                break
            allowed = stored(allowed.join(wrong, ["l", "key"], "left_anti").unionByName(new))
            if not known:
                state.add(allowed.limit(0).withColumn("level", F.lit(LONE)).select("l", "level", "key"), theirs.select("r", "key"), asking=False)
                known = True
            rows = lambda df: df.select("l", F.lit(LONE).alias("level"), "key", *([F.lit(0).alias("cell")] if state.hot else []))
            if back:  # all anew, as if those had never asked
                soft_lefts = state.lefts.where((F.col("level") >= SOFT) & (F.col("level") < LONE))
                state.lefts = stored(before.where(F.col("level") < SOFT).unionByName(soft_lefts).unionByName(rows(allowed)))
                state.start()
            else:
                state.lefts = stored(state.lefts.unionByName(rows(new)))
                state.asking = stored(rows(new).select(*state.asking.columns))
            run()
    name = F.when(F.col("level") >= LONE, F.lit("lone")).when(F.col("level") >= SOFT, F.concat(F.lit("soft"), F.col("level") - SOFT)).otherwise(F.col("key"))
    return state.held.select(F.col("l").alias(left_id), F.col("r").alias(right_id), name.alias("key"))


def invoice_keys(code: Column, issuer: Column, kind: Column, number: Column, day: Column, total: Column) -> Column:
    """What an invoice is looked up by, best first: its authorisation code of ten digits or more; issuer, kind and number; a shorter code; issuer and number; number; issuer, day and total; issuer and total. Empty parts make no key."""
    told = lambda c: F.when(c.cast("string") != "", c.cast("string"))
    code, issuer, kind, number, day = (told(c) for c in (code, issuer, kind, number, day))
    amount = F.when(total != 0, F.abs(total).cast("decimal(18,2)").cast("string"))
    part = lambda name, *cols: F.concat(F.lit(f"{name}:"), *[x for k, c in enumerate(cols) for x in ((F.lit("|"), c) if k else (c,))])
    by_code = part("code", code)
    return F.array(F.when(F.length(code) >= 10, by_code), part("issuer+kind+number", issuer, kind, number), by_code, part("issuer+number", issuer, number), part("number", number), part("issuer+day+total", issuer, day, amount), part("issuer+total", issuer, amount))


#: Rows of one issuer, both sides together, that are settled in one task.
MOST = 1 << 14
#: Keys that tell their issuer: no part of them has the mark between parts.
_WITHIN = r"^(issuer\+(kind\+number|day\+total):[^|]*\|[^|]*|issuer\+(number|total):[^|]*)\|[^|]*$"


def _shared(mine: DataFrame, theirs: DataFrame, most: int) -> tuple[int, DataFrame | None]:
    """How many rows both sides have, and (issuer) of those that are not settled by themselves, if there are any: with over ``most`` rows, or a key that another issuer, or none, has too."""
    counts = stored(mine.select("issuer").unionByName(theirs.select("issuer")).groupBy("issuer").agg(F.count(F.lit(1)).alias("n")))
    total, top = counts.agg(F.sum("n"), F.max(F.when(F.col("issuer").isNotNull(), F.col("n")))).first()
    keyed = lambda df: df.select("issuer", F.explode(F.filter("keys", lambda k: ~k.rlike(_WITHIN))).alias("key")).select("issuer", F.xxhash64("key").alias("key"))
    keys = keyed(mine).unionByName(keyed(theirs))
    # a hash that two keys share only makes issuers go the longer way
    met = keys.groupBy("key").agg(F.min("issuer").alias("_a"), F.max("issuer").alias("_b"), F.count_if(F.col("issuer").isNull()).alias("_none"))
    met = stored(met.where("_a < _b or (_a is not null and _none > 0)").select("key"))
    found = None
    if (top or 0) > most:
        found = counts.where(F.col("n") > most).select("issuer")
    if not met.isEmpty():
        linked = keys.join(apart(met), "key", "left_semi").select("issuer")
        found = linked if found is None else found.unionByName(linked)
    return total or 0, None if found is None else stored(found.where("issuer is not null").distinct())


def _looped(mine: pa.Table, theirs: pa.Table, tolerance: float, share: float) -> pa.Table:
    """The loop itself, over the invoices of some issuers that have no key in common: (l, r, key, off), with a null l or r for what is left; amounts are in cents."""
    rights, lefts = theirs.sort_by("id").to_pylist(), mine.sort_by("id").to_pylist()
    by_key, by_day, by_issuer = {}, {}, {}
    for k in reversed(range(len(rights))):  # the least id comes last
        x = rights[k]
        for key in set(x["keys"]):
            by_key.setdefault(key, []).append(k)
        by_issuer.setdefault(x["issuer"], []).append((x["signed"], k))
        if x["day"] is not None:
            by_day.setdefault((x["issuer"], x["day"]), []).append(k)
    for found in by_issuer.values():
        found.sort()
    used = bytearray(len(rights))
    free = {day: len(found) for day, found in by_day.items()}
    width = int(100 * tolerance) + 1

    def first(x: dict) -> tuple[int | None, str | None]:
        for key in x["keys"]:
            found = by_key.get(key)
            while found and used[found[-1]]:
                found.pop()
            if found:
                return found[-1], key
        day, amount = (x["issuer"], x["day"]), x["amount"]
        found = by_day.get(day, ())
        for k in reversed(found):
            if not used[k] and abs(rights[k]["signed"] - amount) / 100 <= max(tolerance, amount / 100 * share):
                return k, "soft0"
        if amount:
            near = by_issuer.get(x["issuer"], [])
            near = near[bisect.bisect_left(near, (amount - width,)) : bisect.bisect_left(near, (amount + width + 1,))]
            k = min((k for signed, k in near if not used[k] and abs(signed - amount) / 100 <= tolerance), default=None)
            if k is not None:
                return k, "soft1"
        if free.get(day) == 1:
            return next(k for k in found if not used[k]), "lone"
        return None, None

    out = []
    for x in lefts:
        k, key = first(x)
        if k is None:
            out.append((x["id"], None, None, None))
            continue
        used[k] = 1
        right = rights[k]
        if right["day"] is not None:
            free[right["issuer"], right["day"]] -= 1
        off = 0 if x["amount"] <= 0 < right["amount"] else x["amount"] - right["amount"]
        out.append((x["id"], right["id"], key, off))
    out.extend((None, x["id"], None, None) for k, x in enumerate(rights) if not used[k])
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["l", "r", "key", "off"])


def crossed(left: DataFrame, right: DataFrame, left_id: str, right_id: str, own_id: Column | None = None, tolerance: float = 0.05, most: int = MOST) -> DataFrame:
    """Invoices against the tax office's listing, both with (code, issuer, kind, number, day, total).

    Rows (left_id, right_id, state, key, difference): OK or DIFERENCIA for what was
    matched (an invoice without a total takes the listing's), REVISAR for invoices
    that are in no listing or, by ``own_id`` (false), were made out to somebody else,
    FALTA for listed ones without an invoice. After the keys: same issuer and day and
    a total within the tolerance or 2 %; same issuer and a total within the tolerance;
    the only listed invoice of that issuer and day.

    Only codes and numbers can be found with another issuer. An issuer of up to
    ``most`` rows whose codes and numbers nobody else has is settled by itself: the
    loop runs over some issuers at a time, and each row is dealt once. All others,
    and invoices without an issuer, are settled in rounds.
    """
    share = 0.02
    mine = left if own_id is None else left.where(F.coalesce(own_id, F.lit(True)))
    columns = [F.col(c) for c in ("code", "issuer", "kind", "number", "day", "total")]
    keyed = lambda df, own: df.select(own, "issuer", "day", F.abs(F.coalesce("total", F.lit(0))).cast("decimal(18,2)").alias("amount"), F.coalesce("total", F.lit(0)).cast("decimal(18,2)").alias("signed"), invoice_keys(*columns).alias("keys"))
    mine, theirs = stored(keyed(mine, left_id)), stored(keyed(right, right_id))
    kind = mine.schema["issuer"].dataType
    if kind != theirs.schema["issuer"].dataType or kind.simpleString() not in ("string", "bigint", "int"):
        return _in_rounds(left, right, mine, theirs, left_id, right_id, tolerance, share)
    total, shared = _shared(mine, theirs, most)

    def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of issuers that are settled by themselves, and all others."""
        known, unknown = df.where("issuer is not null"), df.where("issuer is null")
        if shared is None:
            return known, unknown
        return known.join(apart(shared), "issuer", "left_anti"), known.join(apart(shared), "issuer", "left_semi").select(*df.columns).unionByName(unknown)

    (mine, my_rest), (theirs, their_rest) = split(mine), split(theirs)
    cents = lambda c: (F.col(c) * 100).cast("long").alias(c)
    groups = max(1, total // TOGETHER)
    dealt = lambda df, own: df.select(F.pmod(F.xxhash64("issuer"), F.lit(groups)).alias("_group"), F.col(own).cast("long").alias("id"), "issuer", "day", cents("amount"), cents("signed"), F.filter("keys", lambda k: k.isNotNull()).alias("keys")).groupBy("_group")
    found = dealt(mine, left_id).cogroup(dealt(theirs, right_id)).applyInArrow(lambda a, b: _looped(a, b, tolerance, share), "l long, r long, key string, off long")
    difference = (F.col("off").cast("decimal(20,0)") / 100).cast("decimal(18,2)")
    state = F.when(F.col("l").isNull(), "FALTA").when(F.col("r").isNull(), "REVISAR").when(F.abs(difference) > tolerance, "DIFERENCIA").otherwise("OK")
    out = found.select(F.col("l").alias(left_id), F.col("r").alias(right_id), state.alias("state"), "key", difference.alias("difference"))
    if own_id is not None:
        none = lambda kind: F.lit(None).cast(kind)
        others = left.where(~F.coalesce(own_id, F.lit(True))).select(F.col(left_id).cast("long").alias(left_id), none("long").alias(right_id), F.lit("REVISAR").alias("state"), none("string").alias("key"), none("decimal(18,2)").alias("difference"))
        out = out.unionByName(others)
    if my_rest.isEmpty() and their_rest.isEmpty():
        return out
    my_rest, their_rest = stored(my_rest), stored(their_rest)
    return out.unionByName(_in_rounds(my_rest, their_rest, my_rest, their_rest, left_id, right_id, tolerance, share))


def _in_rounds(left: DataFrame, right: DataFrame, mine: DataFrame, theirs: DataFrame, left_id: str, right_id: str, tolerance: float, share: float) -> DataFrame:
    """``crossed`` by ``serial_match``; what of ``left`` is not in ``mine`` is REVISAR."""

    def near(rows: DataFrame, on: list[str], share: float) -> DataFrame:
        """Pairs of equal columns whose totals are within the tolerance or a share of the invoice's; a listed credit note is near to none."""
        known = rows.dropna(subset=on)
        listed = theirs.dropna(subset=on).select(*on, right_id, F.col("signed").alias("_listed"))
        if not share:
            return amount_band(known, listed, "amount", "_listed", tolerance, on).select(left_id, right_id)
        # bands of equal ratio: totals within the share are in the same or a neighbouring one
        step = 1.01 * share / (1 - share)
        band = lambda c: F.floor(F.log(F.greatest(F.col(c).cast("double"), F.lit(tolerance / share))) / F.log(F.lit(1 + step))).cast("long")
        wide = known.withColumn("_band", F.explode(F.array(band("amount") - 1, band("amount"), band("amount") + 1)))
        met = wide.join(listed.withColumn("_band", band("_listed")), [*on, "_band"])
        return met.where(F.abs(F.col("_listed") - F.col("amount")) <= F.greatest(F.lit(tolerance), F.col("amount").cast("double") * share)).select(left_id, right_id)

    rules = [lambda rows: near(rows, ["issuer", "day"], share), lambda rows: near(rows.where("amount <> 0"), ["issuer"], 0.0)]
    lone = F.concat(F.col("issuer").cast("string"), F.lit("|"), F.col("day").cast("string"))
    taken = stored(serial_match(mine, theirs, left_id, right_id, F.col("keys"), F.col("keys"), rules, (lone, lone)))
    both = taken.join(mine.select(left_id, "amount"), left_id).join(theirs.select(right_id, F.col("amount").alias("_listed")), right_id)
    difference = F.when((F.col("amount") <= 0) & (F.col("_listed") > 0), F.lit(0)).otherwise(F.col("amount") - F.col("_listed")).cast("decimal(18,2)")
    both = both.withColumn("difference", difference)
    both = both.select(left_id, right_id, F.when(F.abs("difference") > tolerance, "DIFERENCIA").otherwise("OK").alias("state"), "key", "difference")
    none = lambda kind: F.lit(None).cast(kind)
    rest = left.join(taken.select(left_id), left_id, "left_anti").select(left_id, none(right.schema[right_id].dataType.simpleString()).alias(right_id), F.lit("REVISAR").alias("state"), none("string").alias("key"), none("decimal(18,2)").alias("difference"))
    missing = right.join(taken.select(right_id), right_id, "left_anti").select(none(left.schema[left_id].dataType.simpleString()).alias(left_id), right_id, F.lit("FALTA").alias("state"), none("string").alias("key"), none("decimal(18,2)").alias("difference"))
    return both.unionByName(rest).unionByName(missing)
