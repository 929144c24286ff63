r"""Near-duplicate documents by minhash with tensored banding.

Two small collections of ``HALVES`` half keys, each of ``ROWS`` minhashes, give
``HALVES`` ** 2 tables: a table's key combines one half key of each collection.
So 72 minhashes make 144 tables of 6 rows, which would else take 864.
Documents that share a key are candidates; links are confirmed on the full
sets. At similarity 0.85 a link is in no table with probability 2e-5, at 0.9
with 2e-7.

A document's set: its distinct ``WIDTH``-word shingles, compared by 64-bit
hashes; with fewer words, the whole sequence as one. Words are
``[^\x20\x09-\x0D]+`` after A-Z are lower-cased.

1. Documents with equal sets are one class, whatever their number.
2. Classes ask which of their keys other classes have too; only those become
   rows (bucket members).
3. A bucket's members join the star of its least member, once for each star. Two
   classes that share any bucket thus share that bucket's star, and a class whose
   buckets agree on their least member is in one star only.
4. A star of one block is compared in a task on full sets, all pairs at once by a
   matrix product over the shingles that at least two members have. In a larger
   star, members are first compared with its centre alone, in as many tasks as it
   has blocks. Members are then banded by their distance from the centre: 1 less
   the similarity is a metric, so members two bands apart cannot be linked, and
   those linked to the centre need not meet each other. What is left, pairs of
   blocks of the same or neighbouring bands, is compared as before. A task hands on
   a spanning forest of its links, at most one row per member; components are
   joined from these.

So all candidates are confirmed or refuted. In a star of n members that its centre
is linked to, n texts and a centre per block move. Where many members are near the
centre without being linked to it, each of their blocks meets all blocks of the
band before; that part is quadratic in blocks.

Classes are equal sets by 128 bits: where one 64-bit set hash is found with two
checks, all is hashed again with other salt.

Defined cases: a null or wordless text has an empty set and is linked with
nothing; a null id never is the smallest while others are there; repeated rows
are in one class; ties of ids are one id; an empty table gives no rows; other
columns may have any name; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import Texts, Words, hashed, mixed, rolling, spans
from .common import cut, table
from .pages import answered, asked, blocks, bucket_count, bucket_of, in_two, with_answers

WIDTH = 5
HALVES = 12
ROWS = 3
PERCENT = 85
#: Members and words of a block, at most (a longer text is a block's only one).
BLOCK_MEMBERS = 256
BLOCK_WORDS = 1 << 20

_SEEDS = np.random.default_rng(20240229).integers(0, 1 << 63, (2, 2 * HALVES * ROWS), np.int64).astype(np.uint64)
_XOR, _TIMES = _SEEDS[0], _SEEDS[1] * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, one text after the other, and where each text's begin."""
    texts = Texts(column, lower=True)
    words = Words(texts)
    hashes = hashed(texts, words.start, words.end)
    counts = np.diff(words.first)
    long = counts >= width
    at = spans(words.first[:-1][long], counts[long] - width + 1)
    owner, codes = [np.repeat(np.flatnonzero(long), counts[long] - width + 1)], [rolling(hashes, width)[at] if len(at) else np.zeros(0, np.uint64)]
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            owner.append(short)
            codes.append(mixed(rolling(hashes, n)[words.first[short]] + np.uint64(n)))
    owner, codes = np.concatenate(owner), np.concatenate(codes)
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    owner, codes = owner[new], codes[new]
    return codes, np.searchsorted(owner, np.arange(len(column) + 1))


def set_hash(codes: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each set of codes."""
    salted = mixed(codes + np.uint64(0x9E3779B97F4A7C15 * (2 * salt + 1) & 0xFFFFFFFFFFFFFFFF))
    return mixed(np.add.reduceat(mixed(salted), starts) + np.uint64(0x5851F42D4C957F2D) * np.bitwise_xor.reduceat(salted, starts))


def signatures(codes: np.ndarray, first: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per set: half keys (n, 2 * HALVES), a hash of the whole set and another to check it by; empty sets get zeros."""
    n = len(first) - 1
    full = np.flatnonzero(np.diff(first) > 0)
    least = np.zeros((len(_XOR), n), np.uint64)
    whole, check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(full):
        starts = first[:-1][full]
        for k in range(len(_XOR)):
            least[k, full] = np.minimum.reduceat((codes ^ _XOR[k]) * _TIMES[k], starts)
        whole[full], check[full] = set_hash(codes, starts, 2 * salt), set_hash(codes, starts, 2 * salt + 1)
    least = mixed(least)
    half = least[0::ROWS].copy()
    for r in range(1, ROWS):
        half = mixed(half * np.uint64(0x9E3779B97F4A7C15) + least[r::ROWS])
    return half.T.copy(), whole, check


def table_keys(half: np.ndarray) -> np.ndarray:
    """(n, HALVES ** 2) keys: every pair of a half key of the first collection and one of the second."""
    u, v = half[:, :HALVES, None], half[:, None, HALVES:]
    place = np.arange(HALVES * HALVES, dtype=np.uint64).reshape(1, HALVES, HALVES)
    return mixed(u * np.uint64(0x9E3779B97F4A7C15) + mixed(v + place)).reshape(len(half), -1)


def described(docs: DataFrame, key: Column, text: str = "text", salt: int = 0) -> DataFrame:
    """Written rows (_id, _th, _n, _class, _check, _half): what the links need of each document."""
    source = docs.select(key.alias("_id"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes, first = shingle_sets(part.column("_text"))
                half, whole, check = signatures(codes, first, salt)
                columns = [part.column("_id"), part.column("_th"), pa.array(np.diff(first), pa.int64()), pa.array(whole.view(np.int64)), pa.array(check.view(np.int64)), pa.array([r.tobytes() for r in half], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_th", "_n", "_class", "_check", "_half"])

    return cut(source.mapInArrow(task, f"_id {kind}, _th bigint, _n bigint, _class bigint, _check bigint, _half binary"))


def _class_pages(classes: DataFrame, size: int = 4096) -> DataFrame:
    """Classes packed as pages: page, classes, sizes, half."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("_class", "_n")]
                half = b"".join(part.column("_half").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([half], pa.binary())], names=["page", "classes", "sizes", "half"])
                number += 1

    return cut(classes.select("_class", "_n", "_half").mapInArrow(task, "page bigint, classes array<bigint>, sizes array<bigint>, half binary"))


def _sorted_keys(half: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a page in bucket order, with (page-wide) the place of each key of each class and its uses."""
    keys = table_keys(np.frombuffer(half, np.uint64).reshape(-1, 2 * HALVES)).ravel()
    return np.unique(keys, return_inverse=True, return_counts=True)


def bucket_members(classes: DataFrame) -> DataFrame:
    """Written rows (_key, _class, _n) of every key that at least two classes have."""
    pages = _class_pages(classes)
    buckets = bucket_count(pages)

    def ask(row: dict) -> Iterator[tuple[int, list[bytes]]]:
        distinct, _, _ = _sorted_keys(row["half"].as_py(), buckets)
        for b, _x, _y, data in blocks(bucket_of(distinct, buckets), distinct):
            yield b, data

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                distinct, which, times = _sorted_keys(batch.column("half")[k].as_py(), buckets)
                shared = (times > 1) | (np.frombuffer(b"".join(batch.column("answers")[k].as_py()), np.uint8) > 1)
                use = np.flatnonzero(shared[which])
                own, n = batch.column("classes")[k].values.to_numpy(), batch.column("sizes")[k].values.to_numpy()
                member = use // (HALVES * HALVES)
                yield pa.RecordBatch.from_arrays([pa.array(distinct[which[use]].view(np.int64)), pa.array(own[member]), pa.array(n[member])], names=["_key", "_class", "_n"])

    answers = answered(asked(pages, ask), lambda _, parts: in_two(parts[0]))
    return cut(with_answers(pages, answers).mapInArrow(task, "_key bigint, _class bigint, _n bigint"))


def links_within(column: pa.Array, side: np.ndarray, percent: int) -> np.ndarray:
    """For each text of a pair of blocks (``side`` 0 or 1; all 0: one block with itself) the least text it is linked to, perhaps through others."""
    codes, first = shingle_sets(column)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    _, which, times = np.unique(codes, return_inverse=True, return_counts=True)
    shared = times > 1
    place = (np.cumsum(shared) - 1)[which]
    owner, place = owner[shared[which]], place[shared[which]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (np.arange(len(side)),) * 2
    common = np.zeros((len(rows), len(cols)), np.int64)
    width = 4096  # shingles at a time
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [low, low + width])
        has = np.zeros((len(size), width), np.float32)
        has[owner[a:b], place[a:b] - low] = 1
        common += (has[rows] @ has[cols].T).astype(np.int64)
    linked = 100 * common >= percent * (size[rows][:, None] + size[cols][None, :] - common)
    least = np.arange(len(size))
    while True:  # labels spread along links until they stay
        of_cols = np.where(linked, least[cols][None, :], len(size)).min(axis=1, initial=len(size))
        of_rows = np.where(linked, least[rows][:, None], len(size)).min(axis=0, initial=len(size))
        new = least.copy()
        np.minimum.at(new, rows, of_cols)
        np.minimum.at(new, cols, of_rows)
        if (new == least).all():
            return least
        least = new


def _to_centre(column: pa.Array, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(distance, linked) of each text to the first."""
    codes, first = shingle_sets(column)
    size = np.diff(first)
    common = np.concatenate([[0], np.cumsum(np.isin(codes, codes[: first[1]]))])
    common = np.diff(common[first])
    union = size + size[0] - common
    return 1 - common / union, 100 * common >= percent * union


def _compared(groups: DataFrame, texts: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(_a, _b): a spanning forest of the links in each group of classes on sides 0 and 1 (only 0: all with all)."""

    def compare(table):
        table = table.sort_by("_class").combine_chunks()
        own = table.column("_class").to_numpy()
        least = links_within(table.column("_text"), table.column("_side").to_numpy(), percent)
        at = np.flatnonzero(least != np.arange(len(own)))
        return pa.table({"_a": pa.array(own[least[at]], pa.int64()), "_b": pa.array(own[at], pa.int64())})

    return groups.join(texts, "_class").groupBy(*keys).applyInArrow(compare, "_a bigint, _b bigint")


def _blocks() -> Column:
    return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("_n") / BLOCK_WORDS)).cast("int")


def star_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Written (_a, _b): a spanning forest of the links within all stars."""
    least = cut(members.groupBy("_key").agg(F.min("_class").alias("_star")))
    stars = cut(members.join(least, "_key").select("_star", "_class", "_n").distinct())
    sized = cut(stars.groupBy("_star").agg(_blocks().alias("_blocks"), F.count(F.lit(1)).alias("_all")).where("_all > 1"))
    small = stars.join(sized.where("_blocks = 1"), "_star").select("_star", "_class", F.lit(0).cast("byte").alias("_side"))
    found = cut(_compared(small, texts, ["_star"], percent))
    large = sized.where("_blocks > 1")
    return found if large.isEmpty() else found.unionByName(_large_star_links(stars, large, texts, percent))


def _large_star_links(stars: DataFrame, large: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Written (_a, _b) of stars of several blocks: each member with the centre, then neighbouring bands of distance."""
    own = stars.join(large, "_star").where("_class <> _star").withColumn("_block", F.pmod(F.xxhash64("_class", "_star"), F.col("_blocks")).cast("int"))
    centres = large.select("_star", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col("_star").alias("_class"), F.lit(0).cast("long").alias("_n"))
    dealt = own.select("_star", "_block", "_class", "_n").unionByName(centres).join(texts, "_class")

    def with_centre(key, table):
        table = table.append_column("_other", pa.compute.not_equal(table.column("_class"), key[0])).sort_by([("_other", "ascending"), ("_class", "ascending")]).combine_chunks()
        away, linked = _to_centre(table.column("_text"), percent)
        return pa.table({"_star": pa.array([key[0].as_py()] * (len(away) - 1), pa.int64()), "_class": table.column("_class")[1:], "_n": table.column("_n")[1:], "_away": pa.array(away[1:]), "_linked": pa.array(linked[1:])})

    near = cut(dealt.groupBy("_star", "_block").applyInArrow(with_centre, "_star bigint, _class bigint, _n bigint, _away double, _linked boolean"))
    width = (1 - percent / 100) * (1 + 1e-9)
    near = near.withColumn("_band", F.when(F.col("_linked"), 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("_away") / width))).cast("int"))
    bands = cut(near.groupBy("_star", "_band").agg(_blocks().alias("_blocks")))
    placed = near.join(bands, ["_star", "_band"]).withColumn("_block", F.pmod(F.xxhash64("_class", "_star"), F.col("_blocks")).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_other")
    members = ["_star", "_band", "_class", "_block"]
    within = placed.where("_band > 0").select(*members, each("_blocks"))
    within = within.select("_star", F.col("_band").alias("_low"), F.least("_block", "_other").alias("_i"), F.col("_band").alias("_high"), F.greatest("_block", "_other").alias("_j"), "_class", (F.col("_block") > F.col("_other")).cast("byte").alias("_side"))
    next_to = lambda by: placed.join(bands.select("_star", (F.col("_band") + by).alias("_band"), F.col("_blocks").alias("_others")), ["_star", "_band"]).select(*members, each("_others"))
    upper = next_to(1).select("_star", (F.col("_band") - 1).alias("_low"), F.col("_other").alias("_i"), F.col("_band").alias("_high"), F.col("_block").alias("_j"), "_class", F.lit(1).cast("byte").alias("_side"))
    lower = next_to(-1).select("_star", F.col("_band").alias("_low"), F.col("_block").alias("_i"), (F.col("_band") + 1).alias("_high"), F.col("_other").alias("_j"), "_class", F.lit(0).cast("byte").alias("_side"))
    rest = _compared(within.unionByName(upper).unionByName(lower), texts, ["_star", "_low", "_i", "_high", "_j"], percent)
    return near.where("_linked").select(F.col("_star").alias("_a"), F.col("_class").alias("_b")).unionByName(cut(rest))


def components(edges: DataFrame) -> DataFrame:
    """Written (_class, _comp) of the classes that edges touch; each round every class takes its neighbours' least label, then its label's."""
    both = cut(edges.union(edges.select("_b", "_a")).toDF("_a", "_b").distinct())
    labels = cut(both.groupBy(F.col("_a").alias("_class")).agg(F.least(F.min("_b"), F.first("_a")).alias("_comp")))
    while True:
        near = both.join(labels.withColumnRenamed("_class", "_b"), "_b").groupBy(F.col("_a").alias("_class")).agg(F.min("_comp").alias("_near"))
        step = labels.join(near, "_class").select("_class", F.col("_comp").alias("_old"), F.least("_comp", "_near").alias("_comp"))
        step = cut(step)
        jump = step.select(F.col("_class").alias("_l"), F.col("_comp").alias("_next"))
        step = cut(step.join(jump, step["_comp"] == jump["_l"], "left").select("_class", "_old", F.least("_comp", F.coalesce("_next", "_comp")).alias("_comp")))
        labels = step.select("_class", "_comp")
        if not step.where(F.col("_comp") != F.col("_old")).limit(1).count():
            return labels


def classes_of(rows: DataFrame) -> DataFrame:
    """Written classes of equal sets: _class, _n, _rep (least id and its text's hash), _half, and the least and greatest check of its rows."""
    full = rows.where("_n > 0")
    return cut(full.groupBy("_class").agg(F.first("_n").alias("_n"), F.min(F.struct(F.col("_id").isNull().alias("_no"), F.col("_id"), F.col("_th"))).alias("_rep"), F.first("_half").alias("_half"), F.min("_check").alias("_low"), F.max("_check").alias("_high")))


def class_components(classes: DataFrame, docs: DataFrame, key: Column, text: str, percent: int) -> DataFrame:
    """Written (_class, _comp) of the classes that links touch."""
    members = bucket_members(classes)
    wanted = cut(classes.join(members.select("_class").distinct(), "_class").select("_class", F.col("_rep._id").alias("_id"), F.col("_rep._th").alias("_th")))
    source = docs.select(key.alias("_k"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    # always dealt by hash: how many classes are wanted has no bound
    found = source.join(wanted.hint("merge"), source["_k"].eqNullSafe(F.col("_id")) & (source["_h"] == F.col("_th")))
    texts = cut(found.select("_class", "_text").dropDuplicates(["_class"]))
    return components(star_links(members, texts, percent))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(_id, _th, _n, _rep): per document its set's size and the representative (id and text hash) of its component; null for an empty set."""
    salt = 0
    while True:
        rows = described(docs, F.col(key), text, salt)
        classes = classes_of(rows)
        if classes.where("_low <> _high").isEmpty():
            break
        salt += 1  # two sets share a hash: hash all anew
    comps = class_components(classes, docs, F.col(key), text, percent)
    named = classes.select("_class", "_rep").join(comps, "_class", "left").withColumn("_comp", F.coalesce("_comp", "_class"))
    best = cut(named.groupBy("_comp").agg(F.min("_rep").alias("_best")))
    by_class = cut(named.join(best, "_comp").select("_class", F.col("_best").alias("_rep")))
    # a class may hold a third of all rows: a plain join of two stored tables, which Spark splits where it is skewed
    return rows.select("_id", "_th", "_n", F.when(F.col("_n") > 0, F.col("_class")).alias("_class")).join(by_class, "_class", "left").select("_id", "_th", "_n", "_rep")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group of near duplicates, all columns; documents with an empty set all stay."""
    found = linked(docs, key, text, percent)
    stays = found.where((F.col("_n") == 0) | (F.col("_rep._id").eqNullSafe(F.col("_id")) & (F.col("_rep._th") == F.col("_th"))))
    stays = cut(stays.groupBy("_id", "_th").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_rows")))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_k"), F.xxhash64(text).alias("_h"))
    rows = packed.join(stays, packed["_k"].eqNullSafe(stays["_id"]) & (packed["_h"] == stays["_th"]))
    single = rows.where("_rows = 1 or _n = 0").select("_row.*")
    # the same row several times: the first is as good as any
    repeated = rows.where("_rows > 1 and _n > 0").dropDuplicates(["_id", "_th"]).select("_row.*")
    return single.unionByName(repeated)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of links at 0.85."""
    found = linked(table(spark, sf_dir, "documents", "doc_id", "text"))
    component = F.when(F.col("_n") > 0, F.col("_rep._id")).otherwise(F.col("_id"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"))


ORACLE_SQL = {
    "op4_near_dedup": r"""
with recursive d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select distinct r, array_to_string(list_slice(w, k, k + least(5, len(w)) - 1), ' ') as x from (select r, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as k from d where len(w) > 0)),
size as (select r, count(*) as n from s group by r),
pair as (select a.r as a, b.r as b, count(*) as n from s a join s b on a.x = b.x and a.r <> b.r group by a.r, b.r),
link as (select a, b from pair join size x on a = x.r join size y on b = y.r where 100 * pair.n >= 85 * (x.n + y.n - pair.n)),
reach as (select r as a, r as b from d union select reach.a, link.b from reach join link on reach.b = link.a)
select d.doc_id, coalesce(size.n, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from d left join size using (r) join (select a, min(e.doc_id) as c from reach join d e on reach.b = e.r group by a) m on m.a = d.r
"""
}
