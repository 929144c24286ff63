r"""Substring dedup: repeated word passages by prefix-partitioned suffix trees.

Removed is each word inside a window of ``WINDOW`` words that also starts
anywhere else in the corpus. The suffixes are those that start at anchors: in
every window the least of its ``GRAM``-word grams (by hash, the first of equals)
is its anchor, so two equal windows have their anchors at the same place, and one
suffix in fourteen stands for all. A suffix comes with the words around it that
its windows cover.

1. The anchor's gram is the prefix that suffixes are parted by. Pages ask how many
   suffixes all pages have with each of their prefixes; a prefix with one suffix
   only has no branch and is done.
2. For each shared prefix, pages hand in the suffixes, equal ones once with their
   number. The suffixes of a prefix make a subtree, built top-down, word by word:
   a node at depth d is a set of suffixes that agree on d words, and nodes with
   one suffix are leaves that go no deeper. A second tree, of the words before the
   anchor read backwards, extends nodes to the left. A node at depth d that agrees
   on WINDOW - d words to the left as well, in two suffixes or more, is a repeat
   of WINDOW words, and neighbouring ones join into maximal repeats.
3. A prefix with more than ``HOT_SUFFIXES`` suffixes is lengthened to the whole
   window (variable-length prefixes): its subtrees have their root at depth WINDOW,
   and only count. So groups stay of memory size, and a passage of a third of all
   documents is one entry a page.
4. A page merges its repeated windows; runs of them are what is removed.

Words, and prefixes of whole windows, are compared by 64-bit hashes. Words are
``[^\x20\x09-\x0D]+``, unchanged.

Defined cases: a null, empty or short text has no window and keeps all words;
the same passage twice in one document counts as repeated; repeated rows repeat
each other; an empty table gives no rows; other columns may have any name; a text
of any length is handled whole, in one page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import Texts, Words, hashed, joined, rolling, spans
from .common import cut, table
from .pages import PAGE_BYTES, answered, asked, asked_again, blocks, bucket_count, bucket_of, in_two, paged, restored, squeezed, texts_of, told

WINDOW = 35
GRAM = 8
#: Prefixes with more suffixes than this (over all pages, equal ones of a page once) are lengthened to the whole window.
HOT_SUFFIXES = 256


class PageSuffixes:
    """The windows of a page's texts (``start``: first word) and the suffixes at their anchors.

    Suffix r has the windows ``own[r]:own[r + 1]`` and starts at word ``anchor[r]``;
    of equal suffixes, ``first`` is one and ``times`` their number, ``which`` tells
    them apart; ``prefixes`` are the distinct grams, ``prefix`` those of ``first``.
    """

    def __init__(self, column: pa.Array, window: int, gram: int):
        self.texts = Texts(column)
        self.words = Words(self.texts)
        hashes = hashed(self.texts, self.words.start, self.words.end)
        counts = np.diff(self.words.first)
        long = counts >= window
        self.start = spans(self.words.first[:-1][long], counts[long] - window + 1)
        grams = rolling(hashes, gram)
        # the upper half of the gram's hash, then its place: the first of equals is the least
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width, want = 1, window - gram + 1
        while width < want and len(least):
            step = min(width, want - width)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            width += step
        if not len(self.start):
            least = np.zeros(0, np.uint64)
        at = (least[self.start] & np.uint64(0xFFFFFFFF)).astype(np.int64) if len(least) else np.zeros(0, np.int64)
        opens = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        self.own = np.append(opens, len(at))
        self.anchor = at[opens]
        self.code = rolling(hashes, window)[self.start] if len(at) else np.zeros(0, np.uint64)
        last = self.own[1:] - 1
        # the outer windows of a suffix overlap: with their number they tell all its words
        whole = joined(joined(self.code[opens], self.code[last]), (last - opens).astype(np.uint64))
        _, self.first, self.which, self.times = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        self.prefixes, self.prefix = np.unique(grams[self.anchor[self.first]] if len(at) else np.zeros(0, np.uint64), return_inverse=True)


def _suffixes_of(blocks: list[list[bytes]]) -> list[bytes]:
    """For each block of prefixes, how many suffixes all blocks have with each; 0 where it is one.

    With a prefix comes twice its number of distinct suffixes, plus one if some are there more often.
    """
    keys, counts = [np.frombuffer(b, np.uint64) for b in blocks[0]], [restored(b, np.uint32) for b in blocks[1]]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate(counts).astype(np.int64)
    total, again = np.bincount(which, counts >> 1, len(distinct)), np.bincount(which, counts & 1, len(distinct))
    told = np.where((total > 1) | (again > 0), np.minimum(total, 0xFFFFFFFF), 0).astype(np.uint32)[which]
    return [squeezed(x) for x in np.split(told, np.cumsum([len(k) for k in keys])[:-1])]


class Asked:
    """What a page asks in step 2: ``cold`` suffixes (places in ``first``) and ``hot`` window codes, each with its bucket, in bucket order."""

    def __init__(self, page: PageSuffixes, found: list[bytes], buckets: int, most: int):
        shared = np.concatenate([restored(x, np.uint32) for x in found]) if found else np.zeros(len(page.prefixes), np.uint32)
        shared = shared[page.prefix]
        cold = np.flatnonzero((shared > 0) & (shared <= most))
        bucket = bucket_of(page.prefixes[page.prefix[cold]], buckets)
        order = np.argsort(bucket, kind="stable")
        self.cold, self.cold_bucket = cold[order], bucket[order]
        # the windows of hot suffixes, each once
        hot = (shared > most)[page.which]
        self.windows = np.flatnonzero(np.repeat(hot, np.diff(page.own)))
        self.codes, self.code, self.times = np.unique(page.code[self.windows], return_inverse=True, return_counts=True)
        self.hot_bucket = bucket_of(self.codes, buckets)


def _cold_block(page: PageSuffixes, chosen: np.ndarray, window: int) -> list[bytes]:
    """(text, words, words before the anchor, number) of suffixes: the words that their windows cover, with the blanks between."""
    a, b = page.own[page.first[chosen]], page.own[page.first[chosen] + 1] - 1
    low, high = page.start[a], page.start[b] + window
    begin = page.words.start[low]
    length = page.words.end[high - 1] + 1 - begin
    text = b"".join(page.texts.data[x : x + n].tobytes() for x, n in zip(begin.tolist(), length.tolist(), strict=True))
    numbers = np.stack([high - low, page.anchor[page.first[chosen]] - low, np.minimum(page.times[chosen], 2)]).astype(np.uint8)
    return [len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True) if text else b"", numbers.tobytes()]


def _deeper(node: np.ndarray, live: np.ndarray, symbol: np.ndarray, kinds: int, number: np.ndarray) -> None:
    """One level down a tree: the live suffixes' nodes are split by their next symbol, in place; those alone in a node are no longer live."""
    rows = np.flatnonzero(live)
    _, split = np.unique(node[rows] * kinds + symbol[rows], return_inverse=True)
    node[rows] = split
    live[rows] = np.bincount(split, number[rows])[split] > 1


def subtrees(texts: list[bytes], numbers: list[bytes], window: int, gram: int) -> np.ndarray:
    """For each suffix of the blocks a number whose bit k says: the window that starts k words before its anchor is repeated."""
    count, before, number = (np.concatenate(x).astype(np.int64) for x in zip(*[np.frombuffer(b, np.uint8).reshape(3, -1) for b in numbers], strict=True))
    plain = b"".join(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True) for b in texts if b)
    column = Texts(pa.array([plain], pa.large_binary()).view(pa.large_string()))
    words = Words(column)
    hashes = hashed(column, words.start, words.end)
    at = np.cumsum(count) - count + before  # the anchors
    least = before - (count - window)  # the fewest words before the anchor of one of its windows
    known, symbols = np.unique(hashes, return_inverse=True)
    kinds, n, depths = len(known), len(count), window - gram + 1
    _, root = np.unique(rolling(hashes, gram)[at], return_inverse=True)
    right, left = np.zeros((depths, n), np.int64), np.zeros((depths, n), np.int64)
    # -1: no node of two suffixes there
    for tree, step in ((right, 1), (left, -1)):
        node, live = root.astype(np.int64), np.ones(n, bool)
        live &= np.bincount(root, number)[root] > 1
        for depth in range(depths):
            if depth:
                live &= (least <= depths - 1 - depth) if step > 0 else (before >= depth)
                place = np.where(live, at + gram - 1 + depth if step > 0 else at - depth, 0)
                _deeper(node, live, symbols[place], kinds, number)
            tree[depth] = np.where(live, node, -1)
    found = np.zeros(n, np.uint32)
    for k in range(depths):  # k words before the anchor, window - k from it on
        down, up = right[depths - 1 - k], left[k]
        rows = np.flatnonzero((least <= k) & (k <= before) & (down >= 0) & (up >= 0))
        if len(rows):
            _, both = np.unique(down[rows] * n + up[rows], return_inverse=True)
            repeated = np.bincount(both, number[rows])[both] > 1
            found[rows[repeated]] |= np.uint32(1 << k)
    return found


def _answers(parts: list[list[bytes]], window: int, gram: int) -> list[bytes]:
    """For each block the cold suffixes' numbers, then a byte for each hot window."""
    masks = subtrees(parts[0], parts[1], window, gram) if any(parts[1]) else np.zeros(0, np.uint32)
    ends = np.cumsum([len(b) // 3 for b in parts[1]])[:-1]
    return [m.tobytes() + h for m, h in zip(np.split(masks, ends), in_two(parts[2]), strict=True)]


def repeats(docs: DataFrame, row: Column, text: str = "text", window: int = WINDOW, gram: int = GRAM, page_bytes: int = PAGE_BYTES, most: int = HOT_SUFFIXES) -> DataFrame:
    """(_row, n_words, n_removed, begin, end, kept): spans of removed words (array<bigint>), and the kept words joined by blanks.

    ``most``: how many suffixes a prefix may have before it is lengthened.
    """
    if not 0 <= window - gram < 32:
        raise ValueError(f"a window may have 0 to 31 words more than a gram, not {window - gram}")
    pages = paged(docs, row, text, page_bytes)
    buckets = bucket_count(pages)
    kind = pages.schema["rows"].dataType.elementType.simpleString()

    def ask_prefixes(row: dict) -> Iterator[tuple[int, list[bytes]]]:
        page = PageSuffixes(texts_of(row["texts"].as_py()), window, gram)
        again = np.bincount(page.prefix, page.times > 1, len(page.prefixes)) > 0
        counts = (2 * np.bincount(page.prefix, minlength=len(page.prefixes)) + again).astype(np.uint32)
        for b, x, y, _ in blocks(bucket_of(page.prefixes, buckets)):
            yield b, [page.prefixes[x:y].tobytes(), squeezed(counts[x:y])]

    def ask_suffixes(row: dict, found: list[list[bytes]]) -> Iterator[tuple[int, list[bytes]]]:
        page = PageSuffixes(texts_of(row["texts"].as_py()), window, gram)
        asks = Asked(page, found[0], buckets, most)
        cold = {b: (x, y) for b, x, y, _ in blocks(asks.cold_bucket)}
        hot = {b: (x, y) for b, x, y, _ in blocks(asks.hot_bucket)}
        for b in sorted(cold.keys() | hot.keys()):
            (a, z), (x, y) = cold.get(b, (0, 0)), hot.get(b, (0, 0))
            yield b, [*_cold_block(page, asks.cold[a:z], window), asks.codes[x:y].tobytes()]

    # the answers are written, not the pages with them: they are a small part of the pages
    shared = cut(answered(asked(pages, ask_prefixes, 2), lambda _, parts: _suffixes_of(parts), 2))
    nodes = answered(asked_again(pages, [shared], ask_suffixes, 3), lambda _, parts: _answers(parts, window, gram), 3)

    def judge(row: dict, found: list[list[bytes]]) -> pa.Table:
        rows, names = row["rows"].values, ["_row", "n_words", "n_removed", "begin", "end", "kept"]
        pieces = _judged(found, texts_of(row["texts"].as_py()), window, gram, buckets, most)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([rows.slice(at, to - at), *columns], names=names) for at, to, columns in pieces])

    return told(pages, [shared, nodes], judge, f"_row {kind}, n_words bigint, n_removed bigint, begin array<bigint>, end array<bigint>, kept string")


def _repeated(page: PageSuffixes, found: list[list[bytes]], buckets: int, most: int) -> np.ndarray:
    """Which windows are repeated, from the answers to step 2."""
    asks = Asked(page, found[0], buckets, most)
    masks, flags = np.zeros(len(page.first), np.uint32), asks.times > 1
    answers, at = iter(found[1]), [0, 0]
    for b in sorted({*asks.cold_bucket.tolist(), *asks.hot_bucket.tolist()}):
        n, m = int(np.searchsorted(asks.cold_bucket, b, side="right")) - at[0], int(np.searchsorted(asks.hot_bucket, b, side="right")) - at[1]
        told = next(answers)
        masks[asks.cold[at[0] : at[0] + n]] = np.frombuffer(told, np.uint32, n)
        flags[at[1] : at[1] + m] |= np.frombuffer(told, np.uint8, m, 4 * n) > 1
        at = [at[0] + n, at[1] + m]
    windows = np.diff(page.own)
    before = np.repeat(page.anchor, windows) - page.start  # words of each window before its anchor
    out = (np.repeat(masks[page.which], windows) >> before.astype(np.uint32) & np.uint32(1)).astype(bool)
    out[asks.windows] |= flags[asks.code]
    return out


def _judged(found: list[list[bytes]], column: pa.Array, window: int, gram: int, buckets: int, most: int, step: int = 512) -> Iterator[tuple[int, int, list[pa.Array]]]:
    page = PageSuffixes(column, window, gram)
    hit = page.start[_repeated(page, found, buckets, most)]
    words, first = page.words, page.words.first
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, hit, 1)
    np.add.at(change, hit + window, -1)
    gone = np.cumsum(change)[:-1] > 0
    removed = np.concatenate([[0], np.cumsum(gone)])
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    edges_in = edges.copy()
    # spans end at the ends of texts
    inner = first[1:-1]
    both = inner[(inner > 0) & (inner < len(gone))]
    both = np.unique(both[gone[both] & gone[both - 1]]) if len(both) else both
    begin = np.sort(np.concatenate([np.flatnonzero(edges_in == 1), both]))
    end = np.sort(np.concatenate([np.flatnonzero(edges_in == -1), both]))
    data = page.texts.data
    for at in range(0, len(column), step):
        to = min(at + step, len(column))
        a, b = first[at], first[to]
        stay = np.arange(a, b)[~gone[a:b]]
        length = words.end[stay] - words.start[stay] + 1  # with the separator after it
        held = data[spans(words.start[stay], length)] if len(stay) else data[:0]
        ends = np.cumsum(length)
        held[ends - 1] = 0x20
        owner = np.searchsorted(first, stay, side="right") - 1
        upto = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(at, to + 1))]
        kept = [held[x : max(x, y - 1)].tobytes().decode() for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        lo, hi = np.searchsorted(begin, first[at:to]), np.searchsorted(begin, first[at + 1 : to + 1])
        offsets = pa.array(np.concatenate([lo, hi[-1:]]) - lo[0], pa.int32())
        here = slice(lo[0], hi[-1])
        origin = np.repeat(first[at:to], hi - lo)
        yield at, to, [
            pa.array(np.diff(first[at : to + 1]), pa.int64()),
            pa.array(np.diff(removed[first[at : to + 1]]), pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(begin[here] - origin, pa.int64())),
            pa.ListArray.from_arrays(offsets, pa.array(end[here] - origin, pa.int64())),
            pa.array(kept, pa.string()),
        ]


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, and a digest of what it keeps."""
    found = repeats(table(spark, sf_dir, "documents", "doc_id", "text"), F.col("doc_id"))
    return found.select(F.col("_row").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op9_substring_dedup": r"""
with d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select r, k, md5(array_to_string(list_slice(w, k, k + 34), ' ')) as x from (select r, w, unnest(range(1, len(w) - 33)) as k from d where len(w) >= 35)),
hit as (select r, k from (select r, k, count(*) over (partition by x) as n from win) where n > 1),
word as (select distinct r, p from (select r, unnest(range(k, k + 35)) as p from hit)),
gone as (select r, count(*) as n, list(p) as ps from word group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed,
  sha256(array_to_string(case when n is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(ps, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from d left join gone using (r)
"""
}
