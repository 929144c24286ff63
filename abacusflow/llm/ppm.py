r"""Language-model scores by prediction by partial matching over bytes.

The text that is modelled is the token sequence: words ``[^\x20\x09-\x0D]+`` with
A-Z lower-cased, a blank after each, and a final end symbol. The model is a trie
of byte contexts up to ``ORDER`` bytes. In its longest context that was seen in
training, a symbol has probability (c - d) / n and an escape d * q / n (n: uses
of the context, q: distinct symbols in it, d: ``DISCOUNT``; method D has 1/2), and
after an escape to the context one byte shorter, symbols of the longer one are
excluded from its counts. Shorter contexts count by update exclusion: a symbol's
uses are the distinct longer contexts that it was seen in. Below the empty
context, bytes are equally likely. The score of a text is the sum of log10
probabilities of its symbols, with counts of the training documents only.

A symbol's cost depends on the ``ORDER`` bytes before it, so a page of documents
asks for each distinct run of ``ORDER`` + 1 bytes once, and hands in how often
training documents use it. The trie is split at depth ``SPLIT``: subtrees are
dealt to hash buckets by the last ``SPLIT`` bytes of the context, so all longer
contexts of a symbol are in one bucket, which adds up counts and answers costs.
What is above the split is a table of at most 256 ** 3 entries, counted from the
distinct runs that pages hand in and sent to every task.

A common context is asked for by nearly all pages. From ``GROUP_PAGES`` pages on,
a bucket's pages are dealt to groups: each group adds up its pages' runs, the sums
are added up by run, a bucket's subtree is built from distinct runs alone, and its
costs go back to every group, which answers its pages.

Token counts for the unigram base go the same way, by word hash.

Defined cases: a null or empty text is just its end; a null id counts as "";
without training documents every byte is equally likely and counts are 0;
repeated rows are each scored; an empty table gives no rows; other columns may
have any name; a text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import Texts, Words, hashed
from .common import cut, table
from .pages import PAGE_BYTES, SUMMARY, answered, asked, blocks, bucket_count, bucket_of, paged, restored, squeezed, texts_of, with_answers

ORDER = 5
SPLIT = 3
DISCOUNT = 0.3
#: Pages whose questions to one bucket are answered in one group.
GROUP_PAGES = 4096
#: The bucket number of what pages hand in for the levels above the split.
TOP = -1
BLANK, END = 0x20, 0x0A
#: The word hash that stands for the end of a text.
END_TOKEN = np.uint64(0xE4D0E4D0E4D0E4D0)


class PageTokens:
    """Tokens and byte runs of a page: per text its tokens, then its symbols."""

    def __init__(self, column: pa.Array, order: int):
        texts = Texts(column, lower=True)
        words = Words(texts)
        counts = np.diff(words.first)
        n = len(counts)
        # tokens: the words of a text, then its end
        self.tokens = counts + 1
        self.token_first = np.concatenate([[0], np.cumsum(self.tokens)])
        self.token = np.full(self.token_first[-1], END_TOKEN, np.uint64)
        inner = np.ones(self.token_first[-1], bool)
        inner[self.token_first[1:] - 1] = False
        self.token[inner] = hashed(texts, words.start, words.end)
        # symbols: order ENDs to stand before a text, its words each with a blank, its END
        total = np.concatenate([[0], np.cumsum(words.end - words.start + 1)])
        self.symbols = np.diff(total[words.first]) + 1
        first = np.concatenate([[0], np.cumsum(self.symbols + order)])
        kept = words.inside
        body = np.where(kept, texts.data, np.uint8(BLANK))
        kept[words.end] = True
        inner = np.ones(first[-1], bool)
        edge = (first[:-1, None] + np.arange(order)).ravel()
        inner[edge] = False
        inner[first[1:] - 1] = False
        stream = np.full(first[-1], END, np.uint8)
        stream[inner] = body[kept]
        run = np.zeros(max(0, len(stream) - order), np.uint64)
        for k in range(order + 1):
            run <<= np.uint64(8)
            run |= stream[k : len(stream) - order + k]
        inner[:] = True
        inner[(first[1:, None] - 1 - np.arange(order)).ravel()] = False
        self.run = run[inner[: len(run)]]

    def words(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, their uses in texts to learn from, and which of them each token is."""
        distinct, which = np.unique(self.token, return_inverse=True)
        return distinct, np.bincount(which[np.repeat(learn, self.tokens)], minlength=len(distinct)), which


# A run is asked for as a code: its SPLIT last context bytes, well mixed, on top, so that
# codes are in bucket order when sorted; then the bytes before these; then its last byte.
_SPREAD = 0x9E3779B1 & ((1 << 8 * SPLIT) - 1) | 1
_GATHER = pow(_SPREAD, -1, 1 << 8 * SPLIT)
_SPLIT_MASK = np.uint64((1 << 8 * SPLIT) - 1)


def to_codes(runs: np.ndarray, order: int) -> np.ndarray:
    far = 8 * (order - SPLIT)
    context = ((runs >> np.uint64(8)) & _SPLIT_MASK) * np.uint64(_SPREAD) & _SPLIT_MASK
    code = (context << np.uint64(far)) | (runs >> np.uint64(8 * (SPLIT + 1)))
    return (code << np.uint64(8)) | (runs & np.uint64(255))


def to_runs(codes: np.ndarray, order: int) -> np.ndarray:
    far = np.uint64(8 * (order - SPLIT))
    above = codes >> np.uint64(8)
    context = (above >> far) * np.uint64(_GATHER) & _SPLIT_MASK
    return ((above & ((np.uint64(1) << far) - np.uint64(1))) << np.uint64(8 * (SPLIT + 1))) | (context << np.uint64(8)) | (codes & np.uint64(255))


def bucket_of_codes(codes: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Decided by the SPLIT last context bytes alone."""
    context = codes >> np.uint64(8 * (order - SPLIT + 1))
    return bucket_of(context << np.uint64(64 - 8 * SPLIT), buckets)


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (8 * (order + 1))) - 1)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (ascending) and the sums of their counts."""
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, counts, len(distinct)).astype(np.int64)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where it is not."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], 0)


class Level:
    """The contexts of one order: uses of each (context, symbol), of each context, and its distinct symbols."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys[counts > 0], counts[counts > 0]
        self.contexts, which = np.unique(self.keys >> np.uint64(8), return_inverse=True)
        self.uses = np.bincount(which, self.counts, len(self.contexts)).astype(np.int64)
        self.kinds = np.bincount(which, minlength=len(self.contexts)).astype(np.int64)


def levels(keys: np.ndarray, counts: np.ndarray, order: int, least: int = 0) -> dict[int, Level]:
    """Levels ``order`` down to ``least`` from the counts of the longest runs; a shorter run counts the longer ones that end in it."""
    out = {order: Level(*_sums(keys & _mask(order), counts))}
    for k in range(order - 1, least - 1, -1):
        longer = out[k + 1].keys
        out[k] = Level(*_sums(longer & _mask(k), np.ones(len(longer), np.int64)))
    return out


def costs(runs: np.ndarray, order: int, trie: dict[int, Level]) -> np.ndarray:
    """log10 probability of the last byte of each run after the bytes before it."""
    out = np.zeros(len(runs))
    open_ = np.ones(len(runs), bool)
    excluded_kinds = np.zeros(len(runs), np.int64)
    longer: Level | None = None
    for k in range(order, -1, -1):
        level = trie[k]
        key = runs & _mask(k)
        context = key >> np.uint64(8)
        if longer is None:
            excluded_uses = np.zeros(len(runs), np.int64)
        else:  # uses here of the symbols that the longer context has
            contexts, sums = _sums(longer.keys >> np.uint64(8), _at(level.keys, level.counts, longer.keys & _mask(k)))
            excluded_uses = _at(contexts, sums, (runs & _mask(k + 1)) >> np.uint64(8))
        uses = _at(level.contexts, level.uses, context) - excluded_uses
        kinds = _at(level.contexts, level.kinds, context)
        new = kinds - excluded_kinds
        own = _at(level.keys, level.counts, key)
        speaks = open_ & (uses > 0)
        seen = speaks & (own > 0)
        out[seen] += np.log10((own[seen] - DISCOUNT) / uses[seen])
        escapes = speaks & (own == 0)
        out[escapes] += np.log10(DISCOUNT * new[escapes] / uses[escapes])
        open_ &= ~seen
        excluded_kinds, longer = kinds, level
    out[open_] -= np.log10(256 - excluded_kinds[open_])
    return out


def _top(questions: DataFrame) -> dict[int, Level]:
    """Levels 0 to SPLIT - 1 from the distinct runs that pages handed in: at most 256 ** SPLIT rows reach the driver, whatever the corpus."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros(0, np.uint32)
        for batch in batches:
            for own in batch.column("part0").to_pylist():
                keys = np.union1d(keys, np.frombuffer(own, np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64))], names=["key"])

    runs = questions.where(F.col("bucket") == TOP).mapInArrow(task, "key bigint").distinct()
    shorter = F.col("key").bitwiseAND((1 << 8 * SPLIT) - 1)
    rows = runs.groupBy(shorter.alias("key")).agg(F.count(F.lit(1)).alias("n")).toArrow().combine_chunks()
    return levels(rows["key"].to_numpy().astype(np.uint64), rows["n"].to_numpy(), SPLIT - 1)


def _in_groups(questions: DataFrame, groups: int, cost_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Answers to questions about runs, a bucket's pages dealt to groups. ``cost_of``: the costs of all distinct runs of a bucket."""
    dealt = questions.withColumn("g", F.pmod(F.xxhash64("page"), F.lit(groups).cast("long")))

    def add_up(key, table):
        keys, uses = [np.concatenate([restored(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("part0", np.uint64), ("part1", np.uint32))]
        distinct, counts = _sums(keys, uses)
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(distinct), pa.int32()), "code": distinct.astype(np.int64), "n": counts})

    def priced(key, table):
        codes = np.sort(table.column("code").to_numpy().astype(np.uint64))
        counts = table.column("n").to_numpy()[np.argsort(table.column("code").to_numpy())]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "codes": [squeezed(codes)], "costs": [squeezed(cost_of(codes, counts))]})

    def answer(key, asked, told):
        if not asked.num_rows:  # no page of this group asks the bucket
            return pa.table({"page": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})
        told = told.to_pylist()[0]
        codes, cost = restored(told["codes"]), restored(told["costs"], np.float32)
        found = [squeezed(cost[np.searchsorted(codes, restored(x))]) for x in asked.column("part0").to_pylist()]
        return pa.table({"page": asked.column("page"), "bucket": asked.column("bucket"), "answer": pa.array(found, pa.binary())})

    sums = dealt.groupBy("bucket", "g").applyInArrow(add_up, "bucket int, code bigint, n bigint").groupBy("bucket", "code").agg(F.sum("n").alias("n"))
    prices = cut(sums.groupBy("bucket").applyInArrow(priced, "bucket int, codes binary, costs binary"))
    prices = prices.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return dealt.groupBy("bucket", "g").cogroup(prices.groupBy("bucket", "g")).applyInArrow(answer, "page bigint, bucket int, answer binary")


def _learn(rows: pa.Scalar) -> np.ndarray:
    return rows.values.field("learn").to_numpy(zero_copy_only=False).astype(bool)


def _counts(data: bytes) -> np.ndarray:
    """64-bit counts from their high and low halves, each behind its length."""
    at = 8 + int.from_bytes(data[:8], "little")
    high, low = restored(data[8:at], np.uint32), restored(data[at + 8 :], np.uint32)
    return (high.astype(np.int64) << 32) | low


def scored(docs: DataFrame, row: Column, learn: Column, text: str = "text", order: int = ORDER, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """(_row, n_tokens, n_known, train_tokens, base_score, score): the model's and the unigram base's log10 probability of every text.

    ``learn``: which documents the model is trained on.
    """
    pages = paged(docs, F.struct(row.alias("row"), F.coalesce(learn, F.lit(False)).alias("learn")), text, page_bytes)
    kind = pages.schema["rows"].dataType.elementType["row"].dataType.simpleString()
    buckets = bucket_count(pages)

    def ask(row: dict) -> Iterator[tuple[int, list[bytes]]]:
        page, learn = PageTokens(texts_of(row["texts"].as_py()), order), _learn(row["rows"])
        marked = to_codes(page.run, order) << np.uint64(1)
        marked |= np.repeat(learn, page.symbols)
        marked.sort()
        codes, used = marked >> np.uint64(1), (marked & np.uint64(1)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        codes, used = codes[at], (np.add.reduceat(used, at) if len(at) else used)
        for b, x, y, _ in blocks(bucket_of_codes(codes, order, buckets)):
            yield b, [squeezed(codes[x:y]), squeezed(used[x:y].astype(np.uint32))]
        yield TOP, [np.unique(to_runs(codes[used > 0], order) & _mask(SPLIT)).astype(np.uint32).tobytes(), b""]
        words, n, _ = page.words(learn)
        for b, x, y, _ in blocks(bucket_of(words, buckets)):
            yield buckets + b, [squeezed(words[x:y]), squeezed(n[x:y].astype(np.uint32))]

    questions = cut(asked(pages, ask, 2))
    top = pages.sparkSession.sparkContext.broadcast(_top(questions))

    def cost_of(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        runs = to_runs(codes, order)
        return costs(runs, order, top.value | levels(runs, counts, order, SPLIT)).astype(np.float32)

    def answer(bucket: int, parts: list[list[bytes]]) -> list[bytes]:
        keys, uses = [restored(x) for x in parts[0]], [restored(x, np.uint32) for x in parts[1]]
        ends = np.cumsum([len(x) for x in keys])[:-1]
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(which, np.concatenate(uses), len(distinct)).astype(np.int64)
        if bucket >= buckets:
            summary = np.array([counts.sum(), (counts > 0).sum()], np.int64).tobytes()
            # a word's uses may pass 2 ** 32: high and low halves
            halves = [[squeezed(x.astype(np.uint32)) for x in np.split(h[which], ends)] for h in (counts >> 32, counts)]
            return [*(a + b for a, b in zip(*[[len(x).to_bytes(8, "little") + x for x in h] for h in halves], strict=True)), summary]
        return [squeezed(x) for x in np.split(cost_of(distinct, counts)[which], ends)]

    groups = -(-pages.count() // GROUP_PAGES)
    if groups > 1:
        runs, tokens = questions.where(F.col("bucket").between(0, buckets - 1)), questions.where(F.col("bucket") >= buckets)
        answers = cut(_in_groups(runs, groups, cost_of).unionByName(answered(tokens, answer, 2)))
    else:
        answers = cut(answered(questions.where(F.col("bucket") != TOP), answer, 2))
    totals = [np.frombuffer(r[0], np.int64) for r in answers.where(F.col("page") == SUMMARY).select("answer").collect()]  # a row per word bucket
    train_tokens, vocabulary = (int(sum(t[k] for t in totals)) for k in range(2))
    base = np.log10(train_tokens + 0.1 * (vocabulary + 1))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                page, learn = PageTokens(texts_of(batch.column("texts")[k].as_py()), order), _learn(batch.column("rows")[k])
                words, _, which = page.words(learn)
                n_words = len(np.unique(bucket_of(words, buckets)))
                found = batch.column("answers")[k].as_py() or []
                cost = np.concatenate([restored(x, np.float32) for x in found[: len(found) - n_words]])
                codes = to_codes(page.run, order)
                by = np.argsort(codes)
                codes = codes[by]
                nth = np.cumsum(np.concatenate([[False], codes[1:] != codes[:-1]]), dtype=np.int32)  # the distinct code of each symbol, in code order
                del codes
                owner = np.repeat(np.arange(len(learn), dtype=np.int32), page.symbols)[by]
                del by
                score = np.bincount(owner, cost[nth].astype(np.float64), len(learn))
                c = np.concatenate([_counts(x) for x in found[len(found) - n_words :]])[which]
                base_score = np.add.reduceat(np.log10(c + 0.1) - base, page.token_first[:-1])
                known = np.add.reduceat((c > 0).astype(np.int64), page.token_first[:-1])
                columns = [batch.column("rows")[k].values.field("row"), pa.array(page.tokens, pa.int64()), pa.array(known), pa.array(np.full(len(known), train_tokens), pa.int64()), pa.array(base_score), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers(pages, answers).mapInArrow(task, f"_row {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores, learnt from nine tenths of the documents by id."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    found = scored(docs, F.struct("doc_id", (fold == 0).alias("held_out")), fold != 0)
    return found.select("_row.doc_id", "_row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
