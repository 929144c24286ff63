r"""The trie of shared conversation prefixes, by partition refinement.

A node is a distinct sequence of first turns (role and text). All conversations
start in one class, that of the root. A round takes the next ``STRIDE`` turns of
the conversations still at work (twice as many in the round after, up to
``MOST_STRIDE``) and splits every class by them, turn by turn: those that go on with
the same turn are a class of the next depth. A conversation that is alone in its
class retires, and its other turns are emitted as a unary chain, without being
looked at again. So there are as many rounds as shared prefixes are long, not as
conversations are.

Sums over subtrees are folded back from the last round to the first. A node's
subtree holds exactly the nodes that its members represent (a node is represented by
its smallest member) at its own depth or below; so each round adds up, per member,
what the member represents, and hands one row per member to the round before.

A turn is known by the md5 of its role and text, a prefix within its class by two
64-bit hashes of its turns and their places. Texts are hashed where they are
read and moved by ``with_turns`` alone. Classes are counted by aggregates that are
combined before the shuffle, so a first turn that a third of all conversations share
is no one task's work; a conversation with a third of all turns is numbered in cells
of ``CELL`` turn numbers and is one class of one, so it retires early. The digest of
the members that end at a node is put together from pieces of 65,536 consecutive ids
and read piece by piece.

Defined cases: a null role or text is empty; null turn numbers come first; equal turn
numbers go by the md5 of role and text; repeated rows are turns of their own; rows
without a conv_id belong to no conversation; an empty table has no nodes; a table with
one conversation has a root and a chain; other columns may have any name; texts of any
length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

STRIDE = 8
MOST_STRIDE = 4096
CELL = 1024
#: Ids that one piece of a digest spans.
PIECE = 1 << 16
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def mark(role: Column, text: Column) -> Column:
    """What tells turns apart: a md5 of role and text."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def sequences(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", payload: bool = False) -> DataFrame:
    """(conv, pos, mark, bytes) of every turn, numbered from 1 in its conversation; ``payload`` adds role and text."""
    told = lambda c: F.coalesce(F.col(c), F.lit(""))
    carried = [told(role).alias("role"), told(text).alias("text")] if payload else []
    slim = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("_turn"), mark(told(role), told(text)).alias("mark"), F.octet_length(told(text)).cast("long").alias("bytes"), *carried)
    slim = slim.withColumn("_cell", F.coalesce(F.floor(F.col("_turn") / CELL), F.lit(-(1 << 62))))
    cells = slim.groupBy("conv", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("conv").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("conv", "_cell").orderBy(F.col("_turn").asc_nulls_first(), "mark"))
    numbered = slim.withColumn("_here", here).join(cells.select("conv", "_cell", before.alias("_before")), ["conv", "_cell"])
    return numbered.select("conv", (F.col("_before") + F.col("_here")).alias("pos"), "mark", "bytes", *[c for c in ("role", "text") if payload])


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, len) of every conversation that has turns."""
    return turns.groupBy("conv").agg(F.max("pos").alias("len"))


def rebuilt(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that start with the first h turns of a neighbour (conv - conv % every) and go on with their own after h; h is crc32(conv) % heads."""
    own = cut(lengths(turns))
    each = own.select("conv", (F.col("conv") - F.col("conv") % every).alias("_base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("_h"), "len")
    each = cut(each.join(own.select(F.col("conv").alias("_base"), F.col("len").alias("_has")), "_base", "left").withColumn("_taken", F.least("_h", F.coalesce("_has", F.lit(0)))))
    payload = [c for c in turns.columns if c not in ("conv", "pos")]
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv", "_base").join(each.where("_taken > 0").select("_base", "conv", "_taken"), "_base").where("pos <= _taken").select("conv", "pos", *payload)
    rest = turns.join(each.select("conv", "_h", "_taken"), "conv").where("pos > _h").select("conv", (F.col("pos") - F.col("_h") + F.col("_taken")).alias("pos"), *payload)
    return first.unionByName(rest), each.select("conv", (F.col("_taken") + F.greatest(F.col("len") - F.col("_h"), F.lit(0))).alias("len"))


def _split(turns: DataFrame, active: DataFrame, depth: int, stride: int) -> DataFrame:
    """Written (conv, cls, pos, len, bytes, n, rep, parent): the next turns of the active conversations, the size and smallest member of the class that each leads to, and of the class before."""
    along = Window.partitionBy("conv").orderBy("pos")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.where((F.col("pos") > depth) & (F.col("pos") <= depth + stride)).join(active, "conv")
    walked = cut(rows.select("conv", "cls", "pos", "len", "bytes", F.bit_xor(F.xxhash64("pos", "mark")).over(so_far).alias("x"), F.bit_xor(F.xxhash64("mark", "pos", F.lit(1))).over(so_far).alias("y")))
    key = ["cls", "pos", "x", "y"]
    classes = cut(walked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep")))
    found = walked.join(classes, key).drop("x", "y")
    return cut(found.withColumn("parent", F.coalesce(F.lag("rep").over(along), "cls")))


def refined(turns: DataFrame, lens: DataFrame, root: int, stride: int = STRIDE, most: int = MOST_STRIDE) -> list[DataFrame]:
    """The rounds of ``_split``, each a written table, until no class has two members that go on."""
    rounds, depth = [], 0
    active = lens.where("len > 0").select("conv", F.lit(root).cast("long").alias("cls"), "len")
    while not active.isEmpty():
        found = _split(turns, active, depth, stride)
        rounds.append(found)
        depth, stride = depth + stride, min(2 * stride, most)
        active = cut(found.where((F.col("n") > 1) & (F.col("pos") == depth) & (F.col("len") > depth)).select("conv", F.col("rep").alias("cls"), "len"))
    return rounds


def _digests(enders: DataFrame) -> DataFrame:
    """(rep, pos, ends_sha256) of (rep, pos, conv): SHA-256 of the comma-joined ids in ascending order, read in pieces."""
    pieces = enders.groupBy("rep", "pos", F.floor(F.col("conv") / PIECE).alias("_piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = pieces.repartition("rep", "pos").sortWithinPartitions("rep", "pos", "_piece")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "pos", "ends_sha256"])
        for batch in batches:
            for rep, pos, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "pos", "ids")), strict=True):
                if at != (rep, pos):
                    if at is not None:
                        yield told()
                    at, state = (rep, pos), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if at is not None:
            yield told()

    return dealt.select("rep", "pos", "ids").mapInArrow(task, "rep bigint, pos bigint, ends_sha256 string")


def _folded(rounds: list[DataFrame], leaves: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(rep, pos, n_leaves, saved_tokens) of the shared nodes, and per conversation (conv, leaves, saved) what it represents in all."""
    carry, out = leaves.select("conv", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")), None
    below = Window.partitionBy("conv").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    worth = F.when(F.col("conv") == F.col("rep"), (F.col("n") - 1) * F.col("bytes")).otherwise(0)
    for found in reversed(rounds):
        shared = found.where("n > 1").select("conv", "pos", "rep", worth.alias("_worth"))
        rows = shared.withColumn("_within", F.sum("_worth").over(below)).join(carry, "conv", "left")
        none = lambda c: F.coalesce(F.col(c), F.lit(0))
        sums = cut(rows.groupBy("rep", "pos").agg(F.sum(none("leaves")).alias("n_leaves"), F.sum(F.col("_within") + none("saved")).alias("saved_tokens")))
        out = sums if out is None else out.unionByName(sums)
        own = shared.groupBy("conv").agg(F.lit(0).cast("long").alias("leaves"), F.sum("_worth").alias("saved"))
        carry = cut(carry.unionByName(own).groupBy("conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    return out, carry


def trie(turns: DataFrame, lens: DataFrame, stride: int = STRIDE, most: int = MOST_STRIDE) -> DataFrame:
    """A row per node (``NODE``) of conversations given as turns (conv, pos, mark, bytes) and lengths (conv, len; 0 where there are no turns)."""
    turns, lens = cut(turns.select("conv", "pos", "mark", "bytes")), cut(lens)
    start = lens.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("rep")).first()
    rounds = refined(turns, lens, start["rep"], stride, most)
    blank = "conv long, cls long, pos long, len long, bytes long, n long, rep long, parent long"
    found = turns.sparkSession.createDataFrame([], blank)
    for r in rounds:
        found = found.unionByName(r.select(*found.columns))
    shared = found.where("n > 1")
    retired = cut(found.where("n = 1").groupBy("conv").agg(F.min("pos").alias("_from"), F.min_by("parent", "pos").alias("_parent"), F.first("len").alias("_len")))

    # shared nodes: what their smallest member says of them
    own = shared.where("conv = rep").select("rep", "pos", "parent", "n")
    children = own.select(F.col("parent").alias("rep"), (F.col("pos") - 1).alias("pos")).unionByName(retired.select(F.col("_parent").alias("rep"), (F.col("_from") - 1).alias("pos")))
    children = cut(children.groupBy("rep", "pos").agg(F.count(F.lit(1)).alias("n_children")))
    at_node = ["rep", "pos"]
    root = lens.agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 0").select("rep", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("parent"), "n")
    nodes = cut(root.unionByName(own).join(children, at_node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    leaves = retired.select("conv").unionByName(nodes.where("n_children = 0").select(F.col("rep").alias("conv")))
    sums, carry = _folded(rounds, leaves)
    top = [F.lit(start["rep"]).cast("long").alias("rep"), F.lit(0).cast("long").alias("pos")]
    whole = carry.agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens")).select(*top, "n_leaves", "saved_tokens")
    sums = whole if sums is None else sums.unionByName(whole)
    enders = shared.where("pos = len").select(*at_node, "conv").unionByName(lens.where("len = 0").select(*top, "conv"))
    none = F.sha2(F.lit(""), 256)
    nodes = nodes.join(sums, at_node).join(_digests(enders), at_node, "left")
    nodes = nodes.select(F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))

    # unary chains: a node per turn
    tail = turns.select("conv", "pos").join(retired, "conv").where("pos >= _from")
    last = F.col("pos") == F.col("_len")
    number = lambda x: F.lit(x).cast("long")
    chains = tail.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("_from"), F.col("_parent")).otherwise(F.col("conv")).alias("parent_conv_id"), number(1).alias("n_convs"), F.when(last, number(0)).otherwise(number(1)).alias("n_children"), number(1).alias("n_leaves"), number(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(none).alias("ends_sha256"))
    return nodes.unionByName(chains).select(*NODE)


def with_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with the role and text of their last turn (null for the root), from turns with payload."""
    told = turns.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "role", "text")
    return nodes.join(told, ["conv_id", "depth"], "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    turns = cut(sequences(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
    return trie(*rebuilt(turns))


ORACLE_SQL = {
    "op11_prefix_trie": r"""
with recursive tab as (select list(c order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
own as (select conv_id as c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as s from conversations where conv_id is not null group by conv_id),
h as (select c, s, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(c as varchar), ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, tab[xor(a & 255, b) + 1])), 4294967295) % 9 as h from own, tab),
seq as (select a.c, list_concat(case when b.s is null then [] else b.s[1:a.h] end, a.s[a.h + 1:len(a.s)]) as s from h a left join own b on b.c = a.c - a.c % 5),
member as (select c, d, s[1:d] as p, len(s) as l, case when d > 0 then strlen(s[d].t) else 0 end as b from (select c, s, unnest(range(0, len(s) + 1)) as d from seq)),
node as (select d, p, min(c) as conv_id, count(*) as n, any_value(b) as b, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where l = d), '') as ends from member group by d, p),
tree as (select node.*, up.conv_id as parent from node left join node up on up.d = node.d - 1 and up.p = node.p[1:node.d - 1] and node.d > 0),
kids as (select parent, d - 1 as d, count(*) as k from tree where d > 0 group by parent, d),
named as (select t.*, coalesce(k, 0) as k from tree t left join kids on kids.parent = t.conv_id and kids.d = t.d),
below as (select m.conv_id as top, m.d as deep, sum(case when n.k = 0 then 1 else 0 end) as leaves, sum((n.n - 1) * n.b) as saved
  from (select node.conv_id, node.d, member.c from node join member on member.d = node.d and member.p = node.p) m join named n on n.conv_id = m.c and n.d >= m.d group by m.conv_id, m.d)
select conv_id, cast(d as bigint) as depth, parent as parent_conv_id, n as n_convs, k as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(ends) as ends_sha256
from named join below on top = conv_id and deep = d
"""
}
