r"""Near-duplicate documents by simhash, searched by the generalised pigeonhole principle.

A document's fingerprint has 64 bits; a bit is 1 if it is set in over half of the
XXH64 hashes (seed ``HASH_SEED``) of its ``WIDTH``-word shingles, repeats included;
with fewer words the whole sequence is one shingle, without words the fingerprint
is zero. Words are `[^\x20\x09-\x0D]+` after A-Z are lower-cased. Fingerprints are
linked at ``MOST`` or fewer differing bits, and components are joined from links.

1. Equal fingerprints are one class, whatever their number.
2. Bits that vary together are put into the same of m partitions, by the
   correlations over all classes. So some partitions tell much and some little.
3. Each fingerprint gives its partitions thresholds t_i of its own, -1 (not asked)
   or more, that sum to MOST - m + 1. Were two linked fingerprints further apart
   than t_i in every partition, they would differ in MOST + 1 bits or more; so
   each finds all its partners. Of all such allocations, dynamic programming takes
   the one with the fewest expected candidates: how many fingerprints are within t
   bits of a value is worked out for every value from the histogram of the
   partition (of its halves where it has more than ``CELL_BITS`` bits, taken as
   independent), so a value that a third of all fingerprints share is not asked
   where others tell more.
4. A fingerprint stands in the bucket of its value in every partition, and asks
   the buckets of all values within t_i bits. A bucket's rows are compared on all
   64 bits, and a task hands on a spanning forest of the links, at most a row per
   member. Where a bucket has over ``BLOCK`` rows, its blocks meet two at a time.
   Within a task a fingerprint that has been reached is not compared with those
   reached before it, so a dense group costs little more than its size.

All links are found and none is guessed: the estimates only choose where to look.
What reaches the driver: 64 x 64 counts of bits and a histogram of 2 ** CELL_BITS
values, at most, for each cell of a partition.

Defined cases: a null or wordless text has fingerprint zero and is linked like any
other; a null id is never the smallest while others are there; repeated rows are in
one class; ties of ids are one id; an empty table gives no rows; other columns may
have any name; texts of any length are read whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import Texts, Words, spans
from .common import cut, table
from .near_dedup import components
from .pages import filled

BITS = 64
WIDTH = 4
HASH_SEED = 42
MOST = 4
#: A histogram has at most so many bits.
CELL_BITS = 16
#: What asking a bucket costs, in comparisons.
PROBE = 200
#: Rows of a bucket that are compared in one task, at most, and rows of small buckets that go together, about.
BLOCK = 1 << 16
TOGETHER = 1 << 14
#: Bytes of texts and shingles that a task looks at together.
TEXT_BYTES = 2 << 20
SHINGLES = 1 << 17
#: Pairs that are compared at once.
PAIRS = 1 << 20


def _squeezed(texts: Texts, words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where each starts and ends."""
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    out[spans(start, length)] = texts.data[spans(words.start, length)]
    return out.tobytes(), start, end


def fingerprints_of(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of every text, as unsigned 64-bit numbers."""
    texts = Texts(column, lower=True)
    words = Words(texts)
    joined, start, end = _squeezed(texts, words)
    count = np.diff(words.first)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begins = spans(words.first[:-1], shingles)
    owner = np.repeat(np.arange(len(count)), shingles)
    ends = end[begins + np.minimum(count, width)[owner] - 1]
    begins = start[begins]
    ones = np.zeros((len(count), BITS), np.int64)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    for low in range(0, len(begins), SHINGLES):
        high = min(low + SHINGLES, len(begins))
        hashes = np.fromiter((digest(view[a:b], HASH_SEED) for a, b in zip(begins[low:high].tolist(), ends[low:high].tolist(), strict=True)), np.uint64, high - low)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whose = owner[low:high]
        at = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        ones[whose[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(_id, _fp): each document's fingerprint, as a signed 64-bit number."""
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in filled(batches, "_text", TEXT_BYTES):
            for batch in held:
                found = fingerprints_of(batch.column("_text"), width)
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found.view(np.int64))], names=["_id", "_fp"])

    return source.mapInArrow(task, f"_id {source.schema['_id'].dataType.simpleString()}, _fp bigint")


def ball(bits: int, most: int) -> int:
    """How many values are within ``most`` bits of one."""
    return sum(math.comb(bits, k) for k in range(most + 1))


def partition_count(n: int, most: int = MOST) -> int:
    """How many partitions are expected to cost least for n evenly spread fingerprints."""

    def cost(m: int) -> float:
        width = BITS / m
        each, more = divmod(most - m + 1, m)
        balls = [ball(round(width), each + (k < more)) for k in range(m)]
        return sum(b * (PROBE + n / 2**width) for b in balls)

    return min(range(2, most + 2), key=lambda m: (cost(m), m))


def together(classes: DataFrame) -> np.ndarray:
    """(64, 64): how strongly each two bits vary together, over all fingerprints."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            data = batch.column("_fp").to_numpy().astype("<i8")
            bits = np.unpackbits(data.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS), pa.int32()), pa.array(total.ravel())], names=["place", "n"])

    both = np.zeros(BITS * BITS)
    for place, n in classes.select("_fp").mapInArrow(task, "place int, n bigint").groupBy("place").agg(F.sum("n")).collect():  # 4,096 rows
        both[place] = n
    both = both.reshape(BITS, BITS) / max(1, classes.count())
    mean = both.diagonal()
    spread = np.sqrt(mean * (1 - mean))
    return np.abs(both - np.outer(mean, mean)) / np.maximum(np.outer(spread, spread), 1e-9)


def partitions(strength: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m partitions of even size: each starts with the two free bits that vary most together and takes the bit that goes best with those it has."""
    free, out = set(range(BITS)), []
    for k in range(m):
        size = (BITS + m - 1 - k) // m
        pairs = ((strength[a, b], -a, -b) for a, b in itertools.combinations(sorted(free), 2))
        _, a, b = max(pairs)
        own = [-a, -b][:size]
        while len(own) < size:
            own.append(max(free - set(own), key=lambda x: (strength[x, own].sum(), -x)))
        free -= set(own)
        out.append(sorted(own))
    return out


def values_in(fingerprints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of these bits, as a number."""
    out = np.zeros(len(fingerprints), np.uint64)
    for k, bit in enumerate(bits):
        out |= ((fingerprints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def cells_of(bits: list[int]) -> list[list[int]]:
    """The bits of a partition in parts of at most ``CELL_BITS``."""
    n = -(-len(bits) // CELL_BITS)
    return [bits[k * len(bits) // n : (k + 1) * len(bits) // n] for k in range(n)]


def histograms(classes: DataFrame, cells: list[list[int]]) -> list[np.ndarray]:
    """How many fingerprints have each value, for each cell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(c), np.int64) for c in cells]
        for batch in batches:
            data = batch.column("_fp").to_numpy().view(np.uint64)
            for k, c in enumerate(cells):
                total[k] += np.bincount(values_in(data, c), minlength=1 << len(c))
        for k, counts in enumerate(total):
            has = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), k), pa.int32()), pa.array(has, pa.int32()), pa.array(counts[has])], names=["cell", "value", "n"])

    found = classes.select("_fp").mapInArrow(task, "cell int, value int, n bigint").groupBy("cell", "value").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** CELL_BITS rows a cell
    out = [np.zeros(1 << len(c), np.int64) for c in cells]
    cell, value, n = (found.column(c).to_numpy() for c in ("cell", "value", "n"))
    for k, counts in enumerate(out):
        counts[value[cell == k]] = n[cell == k]
    return out


def at_distance(counts: np.ndarray, most: int) -> np.ndarray:
    """(most + 1, values): how many are at exactly 0, 1, .. most bits from each value."""
    out = np.zeros((most + 1, len(counts)), np.float64)
    out[0] = counts
    place = np.arange(len(counts))
    for bit in range(len(counts).bit_length() - 1):
        flipped = out[:, place ^ (1 << bit)]
        out[1:] += flipped[:-1]
    return out


def expected(parts: list[list[int]], counts: dict[tuple, np.ndarray], n: int, fingerprints: np.ndarray, most: int) -> np.ndarray:
    """(partition, most + 2, fingerprint): what it costs to ask a partition within -1, 0, .. most bits; infinite beyond its width."""
    out = np.full((len(parts), most + 2, len(fingerprints)), np.inf)
    for i, bits in enumerate(parts):
        near = None
        for cell in cells_of(bits):
            of_cell = counts[tuple(cell)][:, values_in(fingerprints, cell)]
            if near is None:
                near = of_cell
            else:  # shares of the whole, as if the cells were independent
                near = np.stack([sum(near[k] * of_cell[d - k] for k in range(d + 1)) for d in range(most + 1)]) / max(1, n)
        within = np.cumsum(near, axis=0)
        out[i, 0] = 0
        for e in range(min(most, len(bits)) + 1):
            out[i, e + 1] = within[e] + PROBE * ball(len(bits), e)
    return out


def allocated(cost: np.ndarray, most: int) -> np.ndarray:
    """(partition, fingerprint): the thresholds of least cost that sum to most - m + 1, by dynamic programming over partitions and what they have used."""
    m, _, n = cost.shape
    total = most + 1  # of thresholds plus 1 each
    best = np.full((total + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((m, total + 1, n), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for used in range(total + 1):
            for u in range(used + 1):
                here = best[used - u] + cost[i, u]
                better = here < new[used]
                new[used][better] = here[better]
                choice[i, used][better] = u
        best = new
    out, used, each = np.zeros((m, n), np.int64), np.full(n, total), np.arange(n)
    for i in reversed(range(m)):
        u = choice[i, used, each].astype(np.int64)
        out[i] = u - 1
        used = used - u
    return out


def bucket_rows(classes: DataFrame, most: int = MOST, m: int | None = None) -> DataFrame:
    """Written rows (part, value, _fp, asks): every fingerprint in its own buckets and in those it asks."""
    n = classes.count()
    parts = partitions(together(classes), m or partition_count(n, most))
    cells = [c for bits in parts for c in cells_of(bits)]
    counts = {tuple(c): at_distance(h, most) for c, h in zip(cells, histograms(classes, cells), strict=True)}
    sent = classes.sparkSession.sparkContext.broadcast(counts)  # (most + 1) numbers for each value of a cell
    #: what a value is changed by, nearest first
    flips = [np.array([sum(1 << b for b in chosen) for k in range(most + 1) for chosen in itertools.combinations(range(len(bits)), k)], np.int64) for bits in parts]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                own = batch.column("_fp").slice(low, 4096).to_numpy()
                data = own.view(np.uint64)
                within = allocated(expected(parts, sent.value, n, data, most), most)
                for i, bits in enumerate(parts):
                    value = values_in(data, bits)
                    for e in range(-1, most + 1):
                        who = np.flatnonzero(within[i] == e)
                        if len(who):
                            mask = flips[i][: ball(len(bits), max(e, 0))]
                            rows = (value[who][:, None] ^ mask[None, :]).ravel()
                            columns = [pa.array(np.full(len(rows), i), pa.int32()), pa.array(rows), pa.array(np.repeat(own[who], len(mask))), pa.array(np.full(len(rows), e >= 0))]
                            yield pa.RecordBatch.from_arrays(columns, names=["part", "value", "_fp", "asks"])

    return cut(classes.select("_fp").mapInArrow(task, "part int, value bigint, _fp bigint, asks boolean"))


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def forest(fingerprints: np.ndarray, asks: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Links that join what is linked, perhaps through others, among these: at most one for each. Only those that ask must be compared with all."""
    data = fingerprints.view(np.uint64)
    if len(data) < 2 or not asks.any():
        return []
    if int(asks.sum()) * len(data) <= PAIRS:
        near = _near(data[asks][:, None], data[None, :], most)
        least = np.arange(len(data))
        asking = np.flatnonzero(asks)
        while True:  # labels spread along links until they stay
            new = least.copy()
            np.minimum.at(new, asking, np.where(near, least[None, :], len(data)).min(axis=1))
            new = np.minimum(new, np.where(near, new[asking][:, None], len(data)).min(axis=0))
            if (new == least).all():
                break
            least = new
        at = np.flatnonzero(least != np.arange(len(data)))
        return list(zip(fingerprints[least[at]].tolist(), fingerprints[at].tolist(), strict=True))
    out, left = [], np.arange(len(data))
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            k = reached.pop()
            near = _near(data[left], data[k], most)
            met = left[near]
            out += [(int(fingerprints[k]), x) for x in fingerprints[met].tolist()]
            reached += met.tolist()
            left = left[~near]
    return out


def _linked_in(table: pa.Table, by: list[str], most: int) -> pa.Table:
    """The forests of each group of the sorted columns ``by``."""
    table = table.sort_by([(c, "ascending") for c in [*by, "_fp"]]).combine_chunks()
    keys = [table.column(c).to_numpy() for c in by]
    own, asks = table.column("_fp").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
    new = np.ones(len(own), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    links: list[tuple[int, int]] = []
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(own)], strict=True):
        if b - a > 1:
            first = np.flatnonzero(np.concatenate([[True], own[a + 1 : b] != own[a : b - 1]]))
            links += forest(own[a:b][first], np.logical_or.reduceat(asks[a:b], first), most)
    pairs = np.array(sorted(set(links)), np.int64).reshape(-1, 2)
    return pa.table({"_a": pa.array(pairs[:, 0]), "_b": pa.array(pairs[:, 1])})


def links(rows: DataFrame, most: int = MOST, block: int = BLOCK, together_rows: int = TOGETHER) -> DataFrame:
    """(_a, _b): links between fingerprints that join all that is linked, of written bucket rows."""
    sizes = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("_n"))
    hot = cut(sizes.where(F.col("_n") > block).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")))
    groups = max(1, rows.count() // together_rows)
    small = rows.withColumn("_group", F.pmod(F.xxhash64("part", "value"), F.lit(groups)).cast("int"))
    if hot.isEmpty():
        return small.groupBy("_group").applyInArrow(lambda t: _linked_in(t, ["part", "value"], most), "_a bigint, _b bigint")
    found = small.join(hot.select("part", "value"), ["part", "value"], "left_anti").groupBy("_group").applyInArrow(lambda t: _linked_in(t, ["part", "value"], most), "_a bigint, _b bigint")
    dealt = rows.join(hot, ["part", "value"]).withColumn("_block", F.pmod(F.xxhash64("_fp", F.lit(1)), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    by = ["part", "value", "_low", "_high"]
    dealt = dealt.select("part", "value", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"), "_fp", "asks")
    return found.unionByName(dealt.groupBy(*by).applyInArrow(lambda t: _linked_in(t, by, most), "_a bigint, _b bigint"))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, m: int | None = None, block: int = BLOCK) -> DataFrame:
    """(_id, _fp, _rep): each document's fingerprint and the least id of its component."""
    rows = cut(fingerprinted(docs, key, text))
    classes = cut(rows.groupBy("_fp").agg(F.min("_id").alias("_least")))
    found = components(cut(links(bucket_rows(classes, most, m), most, block).distinct()))
    named = classes.join(found.withColumnRenamed("_class", "_fp"), "_fp", "left").withColumn("_comp", F.coalesce("_comp", "_fp"))
    best = named.groupBy("_comp").agg(F.min("_least").alias("_rep"))
    by_fingerprint = cut(named.join(best, "_comp").select("_fp", "_rep"))
    # one fingerprint may be a third of all rows: a plain join of two stored tables, which Spark splits where it is skewed
    return rows.join(by_fingerprint, "_fp").select("_id", "_fp", "_rep")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that are the least of their component, all columns; ids must be distinct and not null."""
    stays = linked(docs, key, text, **how).where("_id = _rep").select(F.col("_id").alias("_stays"))
    return docs.join(stays, docs[key] == stays["_stays"], "left_semi")


def fingerprint_text(number: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component of links at 4 bits."""
    found = linked(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), fingerprint_text(F.col("_fp")).alias("fingerprint"), F.col("_rep").alias("component_id"))
