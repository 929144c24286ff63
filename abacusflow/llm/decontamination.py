r"""Benchmark decontamination with an FM-index per shard of the training text.

``shard_index`` takes documents in shards of bounded size and stores an FM-index
of all words of each shard, with the shard's vocabulary: a table that serves any
number of benchmarks. ``search`` splits benchmark items into windows of
``WINDOW`` words (an item of fewer is one window), searches all of them backwards
in each shard's index, finds their places from sampled suffixes, and merges them
into spans per document. No text is shuffled.

Test phrases go to the tasks in blocks of bounded size. With more than one block,
what each finds is stored, and joined by shard.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased, compared
by 64-bit hashes.

Defined cases: a null or wordless text is clean, with no words; a null or
wordless item has no windows; a null item id counts as ""; item ids that repeat
count once; repeated documents are each searched; empty tables give no rows or
no hits; other columns may have any name; a text longer than a shard is a shard
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import NON_ALNUM, Texts, Words, hashed, rolling, spans
from .common import cut, table
from .fm_index import BREAK, FMIndex
from .pages import filled

WINDOW = 10
#: UTF-8 bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: UTF-8 bytes of test items that are sent to the tasks at once.
BLOCK_BYTES = 4 << 20

_INDEX = {"size": "bigint", "uses": "binary", "planes": "binary", "sampled": "binary", "samples": "binary"}


class Phrases:
    """The distinct windows of some items, by length, over the items' own vocabulary."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        column = Texts(pa.array(texts, pa.large_string()), lower=True)
        words = Words(column, NON_ALNUM)
        hashes = hashed(column, words.start, words.end)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        self.ids = sorted(set(ids))
        place = {x: k for k, x in enumerate(self.ids)}
        number = np.array([place[x] for x in ids], np.int64)
        counts = np.diff(words.first)
        lengths = np.minimum(window, counts)
        self.by_length = []  # (length, phrases, first owner of each, owners)
        for length in np.unique(lengths[lengths > 0]).tolist():
            items = np.flatnonzero(lengths == length)
            at = spans(words.first[items], counts[items] - length + 1)
            _, first, which = np.unique(rolling(hashes, length)[at], return_index=True, return_inverse=True)
            owners = np.unique(np.stack([which, np.repeat(number[items], counts[items] - length + 1)], axis=1), axis=0)
            rows = symbols[at[first][:, None] + np.arange(length)].astype(np.int32)
            self.by_length.append((length, rows, np.searchsorted(owners[:, 0], np.arange(len(first) + 1)), owners[:, 1]))


def indexed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, FMIndex]:
    """(words of each text, vocabulary, index of all words) of one shard; symbol k + 1 is the vocabulary's k-th."""
    texts = Texts(column, lower=True)
    words = Words(texts, NON_ALNUM)
    counts = np.diff(words.first)
    vocabulary, which = np.unique(hashed(texts, words.start, words.end), return_inverse=True)
    symbols = np.full(len(words) + len(counts), BREAK, np.int64)
    inner = np.ones(len(symbols), bool)
    inner[words.first[1:] + np.arange(len(counts))] = False  # each text ends with a BREAK
    symbols[inner] = which + 1
    return counts, vocabulary, FMIndex.of(symbols)


def searched(counts: np.ndarray, vocabulary: np.ndarray, index: FMIndex, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word, item) of every occurrence in a shard."""
    found = [(np.zeros(0, np.int64),) * 3]
    if len(vocabulary) and phrases.by_length:
        place = np.minimum(np.searchsorted(vocabulary, phrases.vocabulary), len(vocabulary) - 1)
        known = np.where(vocabulary[place] == phrases.vocabulary, place + 1, BREAK)
        for width, rows, first, owners in phrases.by_length:
            there = np.flatnonzero((known[rows] != BREAK).all(axis=1))
            which, at = index.locate(*index.search(known[rows[there]]))
            which = there[which]
            times = first[which + 1] - first[which]
            found.append((np.repeat(at, times), np.full(int(times.sum()), width), owners[spans(first[which], times)]))
    at, width, item = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.cumsum(counts + 1) - counts - 1
    text = np.searchsorted(first, at, side="right") - 1
    begin = at - first[text]
    return text, begin, begin + width, item


def _merged(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of the same text become one."""
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    if not len(text):
        return text, begin, end
    big = np.int64(1) << 40
    reach = np.maximum.accumulate(text * big + end)
    new = np.concatenate([[True], text[1:] * big + begin[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return text[at], begin[at], (np.append(reach[at[1:] - 1], reach[-1]) - text[at] * big)


def _lists(text: np.ndarray, values, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def shard_index(docs: DataFrame, row: Column, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write (shard, rows, n_words, vocabulary, index): an index of every shard; ``row``: what to carry along of each document."""
    source = docs.select(row.alias("_row"), F.col(text).alias("_text"))
    kind = source.schema["_row"].dataType.simpleString()

    def shard(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        counts, vocabulary, index = indexed(whole.column("_text"))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (whole.column("_row"), pa.array(counts, pa.int64()))]
        parts = {"vocabulary": vocabulary.tobytes()} | index.stored()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *(pa.array([x]) for x in parts.values())], names=["shard", "rows", "n_words", *parts])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, held in enumerate(filled(batches, "_text", shard_bytes)):
            yield shard(held, first + k)

    return cut(source.mapInArrow(task, f"shard bigint, rows array<{kind}>, n_words array<bigint>, vocabulary binary, " + ", ".join(f"{n} {t}" for n, t in _INDEX.items())))


_FOUND = "text array<bigint>, begin array<bigint>, end array<bigint>, owner array<bigint>, item array<string>"


def _hits_of(index: DataFrame, phrases: Phrases) -> DataFrame:
    """(shard and _FOUND) of a block of phrases: merged spans by text, and the distinct items by text."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    names = ["shard", *(x.split()[0] for x in _FOUND.split(", "))]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in ("shard", "vocabulary", *_INDEX)}
                counts = batch.column("n_words")[k].values.to_numpy()
                text, begin, end, item = searched(counts, np.frombuffer(one["vocabulary"], np.uint64), FMIndex.restored(one), shared.value)
                if len(text):
                    pairs = np.unique(np.stack([text, item], axis=1), axis=0)
                    out = [*_merged(text, begin, end), pairs[:, 0], [shared.value.ids[x] for x in pairs[:, 1].tolist()]]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, [one["shard"], *map(list, out)], strict=True))], schema=arrow)

    arrow = pa.schema([("shard", pa.int64()), *((n, pa.list_(pa.string() if n == "item" else pa.int64())) for n in names[1:])])
    return index.select("shard", "n_words", "vocabulary", *_INDEX).mapInArrow(task, f"shard bigint, {_FOUND}")


def search(index: DataFrame, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_row, n_words, _begin, _end, _items) of every document of an index: merged spans of hit words, and the items that hit."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_id"), F.col(item_text).alias("_text"))
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks))
    found = None
    for k in range(blocks):
        own = items.where(block == k).orderBy("_id", "_text").collect()
        one = cut(_hits_of(index, Phrases([r[0] for r in own], [r[1] for r in own], window)))
        found = one if found is None else found.unionByName(one)
    by_shard = found.groupBy("shard").agg(F.collect_list(F.struct(*(x.split()[0] for x in _FOUND.split(", ")))).alias("found"))
    kind = index.schema["rows"].dataType.elementType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                counts = batch.column("n_words")[k].values
                told = batch.column("found")[k].as_py() or []
                text, begin, end = _merged(*(np.concatenate([np.zeros(0, np.int64), *(np.array(x[c], np.int64) for x in told)]) for c in ("text", "begin", "end")))
                pairs = sorted({p for x in told for p in zip(x["owner"], x["item"], strict=True)})
                lists = [_lists(text, begin, len(counts), pa.int64()), _lists(text, end, len(counts), pa.int64()), _lists(np.array([p[0] for p in pairs], np.int64), [p[1] for p in pairs], len(counts), pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("rows")[k].values, counts, *lists], names=["_row", "n_words", "_begin", "_end", "_items"])

    return index.select("shard", "rows", "n_words").join(by_shard, "shard", "left").mapInArrow(task, f"_row {kind}, n_words bigint, _begin array<bigint>, _end array<bigint>, _items array<string>")


def hits(docs: DataFrame, row: Column, benchmark: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES, **how) -> DataFrame:
    """Index ``docs`` and ``search`` them once."""
    return search(shard_index(docs, row, text, shard_bytes), benchmark, **how)


def _without_spans(column: pa.Array, begins: list, ends: list) -> list[str | None]:
    """The texts without these words and what stands between them."""
    texts = Texts(column, lower=True)
    words = Words(texts, NON_ALNUM)
    out = []
    for k, (value, begin, end) in enumerate(zip(column.to_pylist(), begins, ends, strict=True)):
        if begin:
            raw, at, pieces = value.encode(), 0, []
            for a, b in zip(begin, end, strict=True):
                pieces.append(raw[at : words.start[words.first[k] + a] - texts.begin[k]])
                at = words.end[words.first[k] + b - 1] - texts.begin[k]
            value = b"".join([*pieces, raw[at:]]).decode()
        out.append(value)
    return out


def n_hit() -> Column:
    return F.aggregate(F.zip_with("_end", "_begin", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents, all columns, that no test window occurs in."""
    found = hits(docs, F.struct(*docs.columns), benchmark, text, **how)
    return found.where(F.size("_begin") == 0).select("_row.*")


def spans_removed(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """All documents, all columns, with hit spans cut out of the text."""
    found = hits(docs, F.struct(*docs.columns), benchmark, text, **how).select("_row", F.col("_row")[text].alias("_text"), "_begin", "_end")
    kind = found.schema["_row"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = _without_spans(batch.column("_text"), batch.column("_begin").to_pylist(), batch.column("_end").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(cleaned, pa.string())], names=["_row", "_clean"])

    cleaned = found.mapInArrow(task, f"_row {kind}, _clean string")
    return cleaned.select(*[F.col("_clean").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = hits(table(spark, sf_dir, "documents", "doc_id", "text"), F.col("doc_id"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        F.col("_row").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.size("_begin") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = {
    "op10_decontamination": rf"""
with d as (select row_number() over () as r, doc_id, coalesce({_WORDS}, []) as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as w from benchmark where text is not null),
sized as (select item, w, least(10, len(w)) as n from b where len(w) > 0),
win as (select distinct item, n, array_to_string(list_slice(w, k, k + n - 1), ' ') as x from (select *, unnest(range(1, len(w) - n + 2)) as k from sized)),
places as (select r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') as x from (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from win) where len(w) >= n)),
hit as (select r, k, n, item from places join win using (n, x)),
word as (select r, count(distinct p) as n_hit from (select r, unnest(range(k, k + n)) as p from hit) group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (r) left join items using (r)
"""
}
