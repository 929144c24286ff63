r"""Importance resampling towards a target text, over hashed word runs.

Features are all runs of 1 to ``RUNS`` consecutive words, in ``BUCKETS`` buckets by
crc32. A bucket's gain is the logarithm of how much more of the target it holds
than of the documents; a document's weight is the mean gain of its features. A
Gumbel number, seeded by the document's id, is added to the weight, and the
highest scores are drawn: a sample without replacement in proportion to the
weights. Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.

Very long texts are not one task's work. A text over ``LONG_BYTES`` is split at
word boundaries into chunks of ``CHUNK_WORDS`` words, and each chunk carries the
``RUNS`` - 1 words that follow it, so that no run is lost at a border. A chunk
owns the runs that start in its own words; those that start in the carried words
are the next chunk's. Chunks are written, dealt evenly, counted like short texts,
and their feature counts and gains are summed by document. How a text is split
changes no result.

What reaches the driver: a count per bucket and two numbers per range of the
ranking. Ranks come from ranges of (score, id), so ties and repeated rows are dealt
as evenly as all others.

Defined cases: a null or wordless text has no features and weight 0; a null id is
seeded as the empty string and comes before all others on a tie; repeated rows are
ranked one by one; an empty target or an empty table is no error (all gains then
say how rare a bucket is, or there are no rows); other columns may have any name;
texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytetext import NON_ALNUM, Texts, Words
from .common import cut, table
from .pages import filled

RUNS = 2
BUCKETS = 10_000
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
LONG_BYTES = 32 << 10
CHUNK_WORDS = 4096
#: Bytes of texts that a task looks at together.
TOGETHER = 2 << 20
#: Bytes from which a word is hashed on its own.
_LONG_WORD = 64


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(0xEDB88320), row >> 1).astype(np.uint32)
    return row


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def crc_from(before: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 of each span of bytes put after what has the crc32 ``before`` (0: nothing)."""
    state, length = before ^ _ONES, end - start
    left, k = np.flatnonzero((length > 0) & (length <= _LONG_WORD)), 0
    while len(left):
        now = state[left]
        state[left] = _CRC[(now ^ data[start[left] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        k += 1
        left = left[length[left] > k]
    out = state ^ _ONES
    for i in np.flatnonzero(length > _LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(before[i]))
    return out


def features(column: pa.Array, own: np.ndarray | None = None, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature, and how many words each text owns; with ``own``, only runs that start in so many first words."""
    texts = Texts(column, lower=True)
    words = Words(texts, NON_ALNUM)
    count = np.diff(words.first)
    owned = count if own is None else np.minimum(own, count)
    owner = words.owner()
    place = np.arange(len(words)) - words.first[owner]
    mine = np.flatnonzero(place < owned[owner])
    code = crc_from(np.zeros(len(mine), np.uint32), texts.data, words.start[mine], words.end[mine])
    whose, found = [owner[mine]], [code % np.uint32(buckets)]
    for n in range(1, runs):
        goes_on = place[mine] + n < count[owner[mine]]
        mine, code = mine[goes_on], code[goes_on]
        code = _CRC[((code ^ _ONES) ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ ((code ^ _ONES) >> np.uint32(8)) ^ _ONES  # a space
        code = crc_from(code, texts.data, words.start[mine + n], words.end[mine + n])
        whose.append(owner[mine])
        found.append(code % np.uint32(buckets))
    return np.concatenate(whose), np.concatenate(found), owned


def chunks(column: pa.Array, size: int, runs: int) -> Iterator[tuple[int, int, int, str]]:
    """(text, chunk, words it owns, its words and those carried, lower-cased) of each text; a wordless text is one empty chunk."""
    texts = Texts(column, lower=True)
    words = Words(texts, NON_ALNUM)
    for k in range(len(texts)):
        a, b = int(words.first[k]), int(words.first[k + 1])
        if a == b:
            yield k, 0, 0, ""
        for number, at in enumerate(range(a, b, size)):
            to = min(at + size, b)
            last = min(to + runs - 1, b) - 1
            yield k, number, to - at, texts.data[words.start[at] : words.end[last]].tobytes().decode()


def pieces(docs: DataFrame, row: Column, text: str = "text", long_bytes: int = LONG_BYTES, chunk_words: int = CHUNK_WORDS, runs: int = RUNS) -> tuple[DataFrame, DataFrame]:
    """Short texts (_row, _text) as they stand, and the written chunks of long ones (_doc, _row with the first chunk, _own, _text)."""
    source = docs.select(row.alias("_row"), F.col(text).alias("_text"))
    is_long = F.coalesce(F.octet_length("_text") > long_bytes, F.lit(False))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for held in filled(batches, "_text", TOGETHER):
            for batch in held:
                found = list(chunks(batch.column("_text"), chunk_words, runs))
                first = pa.array([k if c == 0 else None for k, c, _, _ in found], pa.int64())
                columns = [pa.array([number + k for k, *_ in found], pa.int64()), pa.array([c for _, c, _, _ in found], pa.int32()), batch.column("_row").take(first), pa.array([n for _, _, n, _ in found], pa.int64()), pa.array([t for *_, t in found], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["_doc", "_chunk", "_row", "_own", "_text"])
                number += batch.num_rows

    kind = source.schema["_row"].dataType.simpleString()
    long = cut(source.where(is_long).mapInArrow(split, f"_doc bigint, _chunk int, _row {kind}, _own bigint, _text string").repartition("_doc", "_chunk"))
    return source.where(~is_long), long


def _owned(batch: pa.RecordBatch) -> np.ndarray | None:
    return batch.column("_own").to_numpy() if "_own" in batch.schema.names else None


def bucket_counts(texts: tuple[DataFrame, DataFrame], runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts; a row for each bucket that has any."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for held in filled(batches, "_text", TOGETHER):
            for batch in held:
                total += np.bincount(features(batch.column("_text"), _owned(batch), runs, buckets)[1], minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(total[has])], names=["bucket", "n"])

    short, long = (x.select(*[c for c in ("_own", "_text") if c in x.columns]).mapInArrow(task, "bucket int, n bigint") for x in texts)
    return short.unionByName(long).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What a feature of each bucket is worth, in thousandths: from the bucket counts of documents and target."""
    count = lambda df, name: df.select("bucket", F.col("n").alias(name))
    counts = cut(raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(count(raw, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").na.fill(0, ["s", "t"]))
    total = counts.agg(F.sum("s").cast("double").alias("S"), F.sum("t").cast("double").alias("T")).first()
    more = (F.col("t") + 1).cast("double") * F.lit(total["S"] + buckets) / ((F.col("s") + 1).cast("double") * F.lit(total["T"] + buckets))
    found = counts.select("bucket", F.floor(F.lit(1000.0) * F.log(more)).alias("gain")).toArrow()  # a row per bucket
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("gain").to_numpy()
    return out


def weighed(texts: tuple[DataFrame, DataFrame], gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """(_row, _words, _features, _weight) of every document: chunks are summed by document."""
    buckets = len(gain)
    sent = texts[0].sparkSession.sparkContext.broadcast(gain)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in filled(batches, "_text", TOGETHER):
            for batch in held:
                whose, bucket, words = features(batch.column("_text"), _owned(batch), runs, buckets)
                n, worth = np.bincount(whose, minlength=batch.num_rows), np.bincount(whose, sent.value[bucket], batch.num_rows)
                told = [c for c in ("_doc", "_row") if c in batch.schema.names]
                columns = [*(batch.column(c) for c in told), *(pa.array(x.astype(np.int64)) for x in (words, n, worth))]
                yield pa.RecordBatch.from_arrays(columns, names=[*told, "_words", "_features", "_sum"])

    kind = texts[0].schema["_row"].dataType.simpleString()
    numbers = "_words bigint, _features bigint, _sum bigint"
    short = texts[0].mapInArrow(task, f"_row {kind}, {numbers}")
    parts = texts[1].select("_doc", "_row", "_own", "_text").mapInArrow(task, f"_doc bigint, _row {kind}, {numbers}")
    long = parts.groupBy("_doc").agg(F.first("_row", ignorenulls=True).alias("_row"), *[F.sum(c).alias(c) for c in ("_words", "_features", "_sum")]).drop("_doc")
    whole = F.expr("case when _features > 0 then (_sum - pmod(_sum, _features)) div _features else 0 end").cast("long")
    return short.unionByName(long).select("_row", "_words", "_features", whole.alias("_weight"))


def score(key: Column, weight: Column, seed: int = SEED) -> Column:
    """The weight plus a Gumbel number, in thousandths, seeded by the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return (weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str = "_rank") -> DataFrame:
    """Add each row's rank (from 1) in a total order of all rows: ranges are sorted apart, and start where those before end."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_here", here).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_here")).cast("long")).drop("_part", "_here", "_before")


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", row: Column | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, runs: int = RUNS, buckets: int = BUCKETS, long_bytes: int = LONG_BYTES, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(_key, _row, _words, _features, _weight, _score, _rank) of every document; the rank is null for those not drawn. ``row``: what to carry along of each."""
    split = {"long_bytes": long_bytes, "chunk_words": chunk_words, "runs": runs}
    carried = F.struct(F.col(key).alias("key"), (row if row is not None else F.lit(None).cast("string")).alias("row"))
    texts = pieces(docs, carried, text, **split)
    wanted = pieces(target, F.lit(None).cast("string"), target_text, **split)
    gain = gains(bucket_counts(texts, runs, buckets), bucket_counts(wanted, runs, buckets), buckets)
    rows = weighed(texts, gain, runs).select(F.col("_row.key").alias("_key"), F.col("_row.row").alias("_row"), "_words", "_features", "_weight")
    rows = rows.withColumn("_score", score(F.col("_key"), F.col("_weight"), seed))
    # rows that tie in all are told apart by where they were written, so that no range is one key's
    rows = cut(rows.withColumn("_tie", F.monotonically_increasing_id()))
    fit = rows.where(F.col("_words") >= least_words)
    most = percent * fit.count() // 100
    slim = fit.select("_key", "_score", "_tie")
    drawn = ranked(slim, [F.col("_score").desc(), F.col("_key").asc_nulls_first(), F.col("_tie")]).where(F.col("_rank") <= most)
    return rows.join(drawn.select("_tie", "_rank"), "_tie", "left").drop("_tie")


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents: their own columns, in no order."""
    return scored(docs, target, row=F.struct(*docs.columns), **how).where("_rank is not null").select("_row.*")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight, score and rank among the drawn."""
    found = scored(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return found.select(F.col("_key").alias("doc_id"), F.col("_features").alias("n_features"), F.col("_weight").alias("weight"), F.col("_score").alias("score"), F.col("_rank").alias("rank"))


ORACLE_SQL = {
    "op13_importance": r"""
with recursive tab as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
m as (select coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark),
fd as (select r, f, count(*) as n from (select r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) as f from d) group by r, f),
fm as (select f, count(*) as n from (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) as f from m) group by f),
hex as (select f, hex(encode(f)) as x from (select f from fd union select f from fm)),
code as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(x), 2), lambda k: ((instr('0123456789ABCDEF', x[k]) - 1) * 16 + instr('0123456789ABCDEF', x[k + 1]) - 1)::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 as b from hex, tab),
s as (select b, sum(n) as n from fd join code using (f) group by b),
t as (select b, sum(n) as n from fm join code using (f) group by b),
g as (select i as b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain from range(10000) v(i) left join s on s.b = i left join t on t.b = i),
w as (select r, sum(n) as nf, floor(sum(n * gain)::double / sum(n))::bigint as weight from fd join code using (f) join g using (b) group by r),
x as (select d.r, doc_id, len(d.w) as nw, coalesce(nf, 0) as nf, coalesce(weight, 0) as weight, ('0x' || left(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 8))::bigint as h from d left join w using (r)),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::double)))::bigint as score from x),
z as (select r, row_number() over (order by score desc, doc_id nulls first, r) as place, count(*) over () as n from y where nw >= 20)
select doc_id, cast(nf as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, case when place <= 25 * n // 100 then cast(place as bigint) end as rank from y left join z using (r)
"""
}
