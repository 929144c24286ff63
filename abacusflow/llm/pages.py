"""Pages of documents, and questions that pages put to hash buckets.

Several operators need to know something of the whole corpus for each of many
keys in a text (is this window anywhere else, how often was this context seen).
A row per key would make billions of rows. Instead documents are packed into
pages of bounded size; a page asks each distinct key once, in one block of bytes
per hash bucket; a bucket answers with one block per page, in the order asked;
the page meets its answers again by a join on its number. So a key that a third
of all documents hold is asked once per page, not once per occurrence, and
blocks are of even size whatever the keys.

Pages are written once: what was asked can be worked out anew from the same page
after any loss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

PAGE_BYTES = 4 << 20
#: Hash buckets for each page, so that a bucket gets as much whatever the size of the corpus; and for each shuffle partition at least, so that these come out even.
BUCKETS_PER_PAGE = 2
BUCKETS_PER_PARTITION = 4
SUMMARY = -1


def _packed(texts: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([texts.cast(pa.large_string())], names=["t"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def texts_of(packed: bytes) -> pa.Array:
    """The texts of a page."""
    return pa.ipc.open_stream(packed).read_all().column(0).combine_chunks()


def filled(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows in their order, as many at a time as bring this string column to ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, before + limit - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def paged(docs: DataFrame, row: Column, text: str = "text", page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Write the documents as pages (page, rows, texts); ``row`` is what to carry along of each."""
    source = docs.select(row.alias("_row"), F.col(text).alias("_text"))
    kind = source.schema["_row"].dataType.simpleString()

    def page(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        rows = whole.column("_row").combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        texts = whole.column("_text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, pa.array([_packed(texts)], pa.binary())], names=["page", "rows", "texts"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, held in enumerate(filled(batches, "_text", page_bytes)):
            yield page(held, first + k)

    return cut(source.mapInArrow(task, f"page bigint, rows array<{kind}>, texts binary"))


def bucket_count(pages: DataFrame) -> int:
    """How many buckets these written pages ask."""
    return max(BUCKETS_PER_PAGE * pages.count(), BUCKETS_PER_PARTITION * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of evenly spread 64-bit keys; ascending keys have ascending buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def blocks(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(bucket, from, to, bytes of each column) for every bucket in the ascending ``bucket``."""
    if not len(bucket):
        return
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[a]), a, b, [c[a:b].tobytes() for c in columns]


def _questions(page: int, found: list[tuple[int, list[bytes]]], parts: int) -> dict[str, pa.Array]:
    """The rows of what one page asks."""
    numbers = {"bucket": pa.array([f[0] for f in found], pa.int32()), "page": pa.array([page] * len(found), pa.int64())}
    return numbers | {f"part{p}": pa.array([f[1][p] for f in found], pa.binary()) for p in range(parts)}


def _asked_as(parts: int) -> str:
    return "bucket int, page bigint" + "".join(f", part{k} binary" for k in range(parts))


def asked(pages: DataFrame, ask: Callable[[dict], Iterator[tuple[int, list[bytes]]]], parts: int = 1) -> DataFrame:
    """(bucket, page, part0..) of every page's questions; ``ask`` gets a page's row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                yield pa.RecordBatch.from_pydict(_questions(row["page"].as_py(), list(ask(row)), parts))

    return pages.mapInArrow(task, _asked_as(parts))


def told(pages: DataFrame, answers: list[DataFrame], work: Callable[[dict, list[list[bytes]]], pa.Table], schema: str) -> DataFrame:
    """What ``work`` makes of every page's row and its answers: a list for each table of ``answers``, in bucket order.

    Every page is handed over by itself, so a task needs the memory of one page,
    however many it has; ``with_answers`` hands over all pages of a task at once.
    """
    own, steps = None, len(answers)
    for k, df in enumerate(answers):
        one = df.where(F.col("page") != SUMMARY).select("page", F.lit(k).alias("step"), "bucket", "answer")
        own = one if own is None else own.unionByName(one)

    def page(_, row: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by([("step", "ascending"), ("bucket", "ascending")])
        ends = np.searchsorted(found.column("step").to_numpy(), np.arange(steps), side="right").tolist()
        blocks = found.column("answer").to_pylist()
        return work({c: row.column(c)[0] for c in row.column_names}, [blocks[a:b] for a, b in zip([0, *ends], ends, strict=False)])

    return pages.groupBy("page").cogroup(own.groupBy("page")).applyInArrow(page, schema)


def asked_again(pages: DataFrame, answers: list[DataFrame], ask: Callable[[dict, list[list[bytes]]], Iterator[tuple[int, list[bytes]]]], parts: int = 1) -> DataFrame:
    """``asked``, of pages that have answers to earlier questions."""
    return told(pages, answers, lambda row, found: pa.table(_questions(row["page"].as_py(), list(ask(row, found)), parts)), _asked_as(parts))


def answered(questions: DataFrame, answer: Callable[[int, list[list[bytes]]], list[bytes]], parts: int = 1) -> DataFrame:
    """(page, bucket, answer): ``answer`` gets a bucket's number and its blocks (a list per part), and gives a block for each.

    One block more is the bucket's own summary, which goes to page ``SUMMARY``.
    """

    def group(key, table):
        table = table.sort_by("page")
        found = answer(key[0].as_py(), [table.column(f"part{k}").to_pylist() for k in range(parts)])
        pages = table.column("page").to_pylist() + [SUMMARY] * (len(found) - table.num_rows)
        return pa.table({"page": pa.array(pages, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(found), pa.int32()), "answer": pa.array(found, pa.binary())})

    return questions.groupBy("bucket").applyInArrow(group, "page bigint, bucket int, answer binary")


def with_answers(pages: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """The pages with their answers, in bucket order."""
    own = answers.where(F.col("page") != SUMMARY).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("_a"))
    return pages.join(own.select("page", F.col("_a.answer").alias(name)), "page", "left")


def in_two(blocks: list[bytes], dtype=np.uint64) -> list[bytes]:
    """For each block of distinct keys, a byte per key: in how many of the blocks it is (255: or more)."""
    arrays = [np.frombuffer(b, dtype) for b in blocks]
    keys = np.concatenate(arrays)
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    at = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(keys)))
    out = np.zeros(len(keys), np.uint8)
    out[order] = np.repeat(np.minimum(times, 255), times)
    return [x.tobytes() for x in np.split(out, np.cumsum([len(a) for a in arrays])[:-1])]


def squeezed(values: np.ndarray) -> bytes:
    """Numbers in few bytes: for ascending 64-bit integers their steps; a plane per byte, zstd; the count in front."""
    steps = np.diff(values, prepend=np.uint64(0)) if values.dtype == np.uint64 else np.ascontiguousarray(values)
    planes = steps.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def restored(data: bytes, dtype=np.uint64) -> np.ndarray:
    """The numbers of ``squeezed``."""
    count, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not count:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], count * size, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(values, dtype=np.uint64) if values.dtype == np.uint64 else values
