"""Positions at moving average cost."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold
from .matching import stored
from .running import previous_known

_STATE = ["_units", "_whole", "_part"]


def _folded(moves: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, state, _result, _n) after each movement; rows without ``_own`` are the states that keys begin with.

    A key's movements come sorted and are passed one by one, so a task holds a batch and one state.
    """
    told = [*keys, *order]
    kinds = T.StructType([*[moves.schema[c] for c in told], *[T.StructField(c, T.LongType()) for c in (*_STATE, "_result", "_n")]])

    def half_up(n: int, d: int) -> int:
        q = (2 * abs(n) + d) // (2 * d)
        return q if n >= 0 else -q

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        last, units, rate, n = None, 0, 0, 0
        for batch in batches:
            column = lambda c: batch.column(c).to_pylist()  # noqa: B023, E731
            out: list[list] = [[], [], [], [], []]
            for key, own, m, r, entry, u, whole, part in zip(zip(*map(column, keys)), *map(column, ("_own", "_m", "_r", "_in", *_STATE))):
                if key != last:
                    last, units, rate, n = key, 0, 0, 0
                if not own:
                    units, rate = u, None if whole is None else whole * 10**10 + part
                    continue
                result = 0
                if entry:
                    new = None if r is None else r * 10**4
                    if new is not None and units > 0 and rate is not None and rate > 0:
                        new = half_up(units * rate + m * new, units + m)
                    units, rate = units + m, new
                else:
                    result = None if r is None or rate is None else half_up(m * (r * 10**4 - rate), 10**10)
                    units -= m
                n += 1
                for values, x in zip(out, (units, *((None, None) if rate is None else divmod(rate, 10**10)), result, n)):
                    values.append(x)
            kept = pa.Table.from_batches([batch.select(told)]).filter(pc.equal(batch.column("_own"), 1))
            for name, values in zip((*_STATE, "_result", "_n"), out):
                kept = kept.append_column(name, pa.array(values, pa.int64()))
            yield from kept.to_batches()

    dealt = moves.repartition(*keys) if keys else moves.coalesce(1)
    return dealt.sortWithinPartitions(*keys, "_own", *order, "_m", "_r", "_in").mapInArrow(fold, kinds)


def average_cost(rows: DataFrame, keys: list[str], order: list[str], amount: str, rate: str, is_entry: str, cell: str | None = None, grain: int = 1_000_000) -> DataFrame:
    """(keys, order, units, rate, result) after each movement.

    An entry moves the position's rate to the average by amount (its own rate if
    nothing is there); an exit leaves the rate and books amount times the
    difference of rates. Units are rounded at each step, rates to ten decimals,
    and units may become negative; movements of no positive amount are skipped.

    Every step needs the one before, so a key's movements pass one after another,
    whatever the number of machines: never as one row, but sorted, a batch at a
    time. ``cell`` (such as the month, never falling in the order): keys of more
    than ``grain`` movements are folded cell by cell, and a written table carries
    one row of state per key from cell to cell.
    """
    moves = rows.where(F.col(amount) > 0).select(
        *keys,
        *order,
        *([F.col(cell).alias("_cell")] if cell else []),
        F.lit(1).alias("_own"),
        (F.col(amount).cast("decimal(18,2)") * 100).cast("long").alias("_m"),
        (F.col(rate).cast("decimal(18,6)") * 1_000_000).cast("long").alias("_r"),
        F.coalesce(F.col(is_entry), F.lit(False)).alias("_in"),
        *[F.lit(None).cast("long").alias(c) for c in _STATE],
    )
    long = stored(moves.groupBy(*keys).count().where(F.col("count") > grain).select(*keys)) if cell and keys else None
    if long is None or long.isEmpty():
        out = _folded(moves.drop("_cell"), keys, order)
    else:
        out = _folded(moves.join(long, keys, "left_anti").drop("_cell"), keys, order)
        parts = stored(moves.join(long, keys, "left_semi"))
        state = None
        for (value,) in parts.select("_cell").distinct().orderBy("_cell").collect():
            part = parts.where(F.col("_cell").eqNullSafe(F.lit(value))).drop("_cell")
            if state is not None:
                part = part.unionByName(state.withColumn("_own", F.lit(0)), allowMissingColumns=True)
            done = stored(_folded(part, keys, order))
            out = out.unionByName(done)
            new = done.groupBy(*keys).agg(F.max_by(F.struct(*_STATE), "_n").alias("_s")).select(*keys, "_s.*")
            state = stored(new if state is None else new.unionByName(state.join(new, keys, "left_anti")))
    cents = lambda c: (F.col(c).cast("decimal(19,0)") * F.lit(Decimal("0.01"))).cast("decimal(18,2)")
    exact = F.col("_whole").cast("decimal(18,0)") + F.col("_part").cast("decimal(10,0)") * F.lit(Decimal("0.0000000001"))
    return out.select(*keys, *order, cents("_units").alias("units"), F.round(exact, 6).cast("decimal(18,6)").alias("rate"), cents("_result").alias("result"))


# Kinds of movements that bring dollars in and that take them out.
_INCOMING = ("INGRESO", "COMPRA", "CREDITO", "HABER", "RESCATE")
_OUTGOING = ("EGRESO", "VENTA", "DEBITO", "DEBE", "SUSCRIPCION")


def pocket_of(stated: Column | None = None) -> Column:
    """"fisico" where the file states cash (physical, in cash, notes), else "bancario". What a statement's text tells of is the bank's, a deposit of cash too."""
    if stated is None:
        return F.lit("bancario")
    return F.when(fold(stated).rlike("FISIC|EFECT|BILLETE"), "fisico").otherwise("bancario")


def direction_of(kind: Column, text: Column) -> Column:
    """"ingreso" or "egreso": by the stated kind, else by the text (a redemption comes in, a subscription goes out), else out."""
    told, said = fold(kind), fold(text)
    by_text = F.when(said.contains("SUSCRIP"), "egreso").when(said.contains("RESCATE"), "ingreso").otherwise("egreso")
    return F.when(told.isin(*_INCOMING), "ingreso").when(told.isin(*_OUTGOING), "egreso").otherwise(by_text)


def both_pockets(rows: DataFrame, keys: list[str], cell: str, order: list[str], physical: str, units: str, rate: str) -> DataFrame:
    """Add ``cost``: units times rate of the two pockets together, each as its last movement so far left it, in cents."""
    worth = (F.col(units) * F.col(rate)).cast("decimal(38,8)")
    for name, mine in (("_p", F.col(physical)), ("_b", ~F.col(physical))):
        rows = rows.withColumn(name, F.when(mine, worth))
        rows = previous_known(rows, keys, cell, order, name, f"{name}_before").withColumn(name, F.coalesce(name, f"{name}_before", F.lit(0)))
    return rows.withColumn("cost", F.round(F.col("_p") + F.col("_b"), 2).cast("decimal(18,2)")).drop("_p", "_b", "_p_before", "_b_before")
