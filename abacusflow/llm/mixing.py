"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a seeded shuffled queue. A document's virtual
finish time is the words of its source up to its own end, divided by the
source's target: a source at twice the target moves through its queue twice as
fast. A source whose target exceeds its size queues again for another epoch, up
to ``MAX_EPOCHS`` times. All copies are then range-sorted by finish time and cut
at the total budget, so every prefix of the mix has the sources in proportion.

Nothing is done per source in one task: a queue, in the order of a seeded md5 of
id and text, is split into 4,096 cells by the first digits of the hash, and places
in it are cell totals plus running sums within cells. The cut is found from the
totals of ``SLICES`` slices of virtual time and a running sum within the one
slice where the budget ends; the mix itself is dealt by range.

Targets share the budget by weight; no source gets more than ``MAX_EPOCHS``
times its size, what is over goes to the others by weight until none is above.

Defined cases: a null text has size 0; documents of size 0 take no words and
are not in the mix; a null source is a source of its own; a source of size 0
has target 0; repeated rows queue one by one; copies that finish at the very
moment of the cut all come; an empty table gives no rows; other columns may
have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table, word_count

MAX_EPOCHS = 3
SEED = 17
#: Hexadecimal digits of the hash that name a cell of a queue.
CELL_DIGITS = 3
SLICES = 8192


def weights_by_name(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights 1, 2, 3, repeating, for the distinct ``_source`` values in code point order, null last (a row per source)."""
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    return sources.withColumn("_weight", F.get(F.array(*[F.lit(float(x)) for x in cycle]), place % len(cycle)))


def with_targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``_target`` to sources (_source, _source_size, _weight): water-filling by scalar aggregates only.

    The level is what a unit of weight gets. Sources capped at the present level
    leave it, which only raises the level for the rest, so a few rounds do.
    """
    cap = F.col("_source_size") * float(max_epochs)
    budget = sources.agg(F.sum("_source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = (F.col("_weight") * level >= cap) if capped >= 0 else F.lit(False)
        row = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))), F.count(F.when(full, 1))).first()
        if row[2] == capped or not row[1]:
            return sources.withColumn("_target", F.least(cap, F.col("_weight") * level))
        capped, level = row[2], (budget - row[0]) / row[1]


def queued(docs: DataFrame, seed: int) -> DataFrame:
    """Add ``_end``: the words of the same source up to and with this row, in the shuffled order."""
    seeded = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit("|"), F.col("_tie"))
    rows = docs.withColumn("_order", F.md5(seeded.cast("binary"))).withColumn("_cell", F.left("_order", F.lit(CELL_DIGITS)))
    cells = rows.groupBy("_name", "_cell").agg(F.sum("_size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_name").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("_name", "_cell", before.alias("_before"))
    here = Window.partitionBy("_name", "_cell").orderBy("_order", "_key", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_within", F.sum("_size").over(here)).join(cells, ["_name", "_cell"])
    return rows.withColumn("_end", F.col("_within") + F.col("_before")).drop("_before", "_within", "_cell", "_order")


def _finish(epoch: Column) -> Column:
    """Virtual time from 0 to 1; the middle of a document counts, so a source is off its target by half a document at most."""
    passed = F.col("_end") - F.col("_size") / 2 + epoch * F.col("_source_size")
    return F.when((F.col("_target") > 0) & (F.col("_size") > 0), passed / F.col("_target"))


def finish_of_budget(queue: DataFrame, budget: int, max_epochs: int) -> float:
    """The virtual time at which the copies that have come reach the budget; 1 if they never do."""
    copies = queue.select("_key", "_tie", "_size", F.explode(F.array(*[_finish(F.lit(e)) for e in range(max_epochs)])).alias("_finish")).where(F.col("_finish") <= 1)
    copies = copies.withColumn("_slice", F.floor(F.col("_finish") * SLICES).cast("int"))
    spent = 0
    for k, total in sorted(map(tuple, copies.groupBy("_slice").agg(F.sum("_size")).collect())):
        if spent + total >= budget:
            running = F.sum("_size").over(Window.partitionBy("_slice").orderBy("_finish").rangeBetween(Window.unboundedPreceding, 0))
            last = copies.where(F.col("_slice") == k).withColumn("_running", running)
            return last.where(F.col("_running") >= budget - spent).agg(F.min("_finish")).first()[0]
        spent += total
    return 1.0


def taken(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, payload: bool = True) -> DataFrame:
    """A row per document: _key, _tie, _source, _size, _source_size, _target, _end, _copies (epochs that the mix takes) and, as asked, _row (its columns).

    ``weights``: (_source, _weight), no weight meaning 0; by default 1, 2, 3 by name.
    """
    row = [F.struct(*docs.columns).alias("_row")] if payload else []
    slim = docs.select(F.col(key).alias("_key"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_tie"), F.col(source).alias("_source"), F.concat(F.when(F.col(source).isNull(), "n").otherwise("s"), F.coalesce(source, F.lit(""))).alias("_name"), word_count(F.col(text)).alias("_size"), *row)
    queue = cut(queued(slim, seed))
    sources = queue.groupBy("_name").agg(F.first("_source").alias("_source"), F.sum("_size").alias("_source_size"))
    if weights is None:
        sources = weights_by_name(sources)
    else:
        given = weights.select(F.concat(F.when(F.col("_source").isNull(), "n").otherwise("s"), F.coalesce("_source", F.lit(""))).alias("_name"), F.col("_weight").cast("double"))
        sources = sources.join(given, "_name", "left").withColumn("_weight", F.coalesce("_weight", F.lit(0.0)))
    sources = cut(with_targets(cut(sources), max_epochs))
    queue = queue.join(sources.select("_name", "_source_size", "_target"), "_name").drop("_name")
    budget = sources.agg(F.sum("_source_size")).first()[0] or 0
    until = finish_of_budget(queue, budget, max_epochs)
    copies = sum((F.coalesce((_finish(F.lit(e)) <= until).cast("int"), F.lit(0)) for e in range(max_epochs)), F.lit(0))
    return queue.withColumn("_copies", copies)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix: the documents' own columns, a row per copy, dealt and sorted by virtual finish time."""
    rows = taken(docs, **how).where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    rows = rows.withColumn("_finish", _finish(F.col("_epoch")))
    order = ["_finish", "_key", "_tie"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    rows = taken(docs, payload=False)
    return rows.select(F.col("_key").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


ORACLE_SQL = {
    "op6_mixing": r"""
with recursive d as (select row_number() over () as r, doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, md5(coalesce(text, '')) as tie from documents),
o as (select *, md5('17|' || coalesce(cast(doc_id as varchar), '') || '|' || tie) as ord from d),
s as (select source, cast(sum(size) as bigint) as source_size, sum(size) * 3.0::double as cap, cast(1 + (row_number() over (order by source nulls last) - 1) % 3 as double) as w from d group by source),
lv as (select 0 as it, (select sum(source_size)::double / sum(w) from s) as level
  union all select it + 1, coalesce((select (sum(source_size)::double - sum(case when w * level >= cap then cap else 0 end)) / nullif(sum(case when w * level >= cap then 0 else w end), 0) from s), level) from lv where it < 60),
t as (select source, source_size, least(cap, w * (select level from lv where it = 60)) as target from s),
q as (select o.*, t.source_size, t.target, cast(sum(size) over (partition by o.source order by ord, doc_id, tie rows unbounded preceding) as bigint) as fin from o join t on o.source is not distinct from t.source),
c as (select r, size, (fin - size / 2 + e * source_size) / target as f from q, (values (0), (1), (2)) v(e) where size > 0 and target > 0),
run as (select f, sum(size) over (order by f range unbounded preceding) as spent from c where f <= 1),
until as (select coalesce(min(f), 1.0) as u from run where spent >= (select sum(size) from d)),
n as (select r, count(*) as copies from c where f <= (select u from until) group by r)
select doc_id, source, size, source_size, target, cast(size * coalesce(copies, 0) as bigint) as taken from q left join n using (r)
"""
}
