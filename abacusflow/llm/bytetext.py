"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow string columns.

All separators used by the operators are ASCII, so words can be found on the
bytes: no byte of a multi-byte character is ever a separator. Null texts count
as empty.

Hashes read a word eight bytes at a time and mix after each step, and runs of
words are joined pairwise with mixing at each level, so that no pattern of equal
sums (Thue-Morse words, for one) makes different words or runs alike.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of `[^\x20\x09-\x0D]+`.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_MULT, _FEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Which bytes of a step of eight belong to a word of which so many are left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes from which a word is hashed on its own.
LONG_WORD = 256


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Texts:
    """The bytes of a string column, each text followed by one blank.

    ``data``: uint8; text i is ``data[begin[i]:begin[i + 1] - 1]``.
    """

    def __init__(self, column, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        column = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        offsets, raw = column.buffers()[1:3]
        self.begin = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[self.begin[0] : self.begin[-1]] if len(column) else data[:0]
        self.begin = self.begin - self.begin[0]
        padded = np.zeros(len(self.data) + 8, np.uint8)
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            np.take(table, self.data, out=padded[:-8])
        else:
            padded[:-8] = self.data
        self.data = padded[:-8]
        #: the eight bytes from each place on, as a number
        self.eight = np.ndarray((len(self.data),), np.dtype("<u8"), padded, 0, (1,))

    def __len__(self) -> int:
        return len(self.begin) - 1


class Words:
    """Where the words of Texts are: ``start`` and ``end`` (bytes); those of text i are ``first[i]:first[i + 1]``; ``inside``: bytes in words."""

    def __init__(self, texts: Texts, blanks: bytes = BLANKS):
        inside = np.ones(256, bool)
        inside[list(blanks)] = False
        self.inside = flags = inside[texts.data]
        edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
        if len(flags) and flags[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, texts.begin)

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair; its order counts."""
    return mixed(a * _MULT ^ b) + b * _FEED


def hashed(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    length = end - start
    h = joined(length.astype(np.uint64), texts.eight[start] & _LEFT[np.minimum(length, 8)]) if len(start) else np.zeros(0, np.uint64)
    left, at = np.flatnonzero(length > 8), 8
    while len(left) and at < LONG_WORD:
        h[left] = joined(h[left], texts.eight[start[left] + at] & _LEFT[np.minimum(length[left] - at, 8)])
        at += 8
        left = left[length[left] > at]
    for k in left.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(texts.data[start[k] : end[k]], digest_size=8).digest(), "little")
    return h


def rolling(word: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive word hashes (runs may cross texts)."""
    if len(word) < width:
        return np.zeros(0, np.uint64)
    run, size, whole, covered = word, 1, None, 0  # runs of 1, 2, 4, .. words; those that make up ``width`` are joined
    while True:
        if width & size:
            whole = run if whole is None else joined(whole[: len(run) - covered], run[covered:])
            covered += size
        if 2 * size > width:
            return whole[: len(word) - width + 1]
        run, size = joined(run[:-size], run[size:]), 2 * size


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, .. start + length - 1 of each span, one after the other."""
    total = int(lengths.sum())
    offset = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + offset
