"""An FM-index over integer symbols: backward search by wavelet-matrix ranks, places by sampled suffixes.

All parts are packed arrays, so that an index can be stored as columns of bytes and used as it is read.
"""

from __future__ import annotations

import numpy as np

from .bytetext import spans

#: The symbol that ends every run of text in the index; phrases never hold it.
BREAK = 0
SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling; every BREAK is a smallest symbol of its own, told apart by place."""
    n = len(symbols)
    breaks = symbols == BREAK
    rank = np.where(breaks, np.cumsum(breaks) - 1, symbols.astype(np.int64) + int(breaks.sum()))
    # as many symbols as fit in a number make the first key
    bits = int(rank.max(initial=0)).bit_length() or 1
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= rank[k:]
    rank = key
    order = np.argsort(rank, kind="stable")
    in_order = rank[order]
    steps = np.concatenate([[True], in_order[1:] != in_order[:-1]])[:n]
    rank[order] = np.maximum.accumulate(np.where(steps, np.arange(n), 0))  # the first place of its group
    tied = np.flatnonzero(~steps | np.concatenate([~steps[1:], [False]])[:n])  # places in the order whose rank is shared
    while len(tied):
        # only these are sorted further
        rows = order[tied]
        group = rank[rows]
        after = np.where(rows + width < n, rank[np.minimum(rows + width, n - 1)], -1)
        again = np.lexsort((after, group))
        rows, group, after = rows[again], group[again], after[again]
        order[tied] = rows
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        first = np.concatenate([[True], group[1:] != group[:-1]])
        # a group of equal rank spans consecutive places of tied; its split ranks start at its own rank
        at = np.arange(len(rows))
        offset = np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        rank[rows] = group + offset
        alone = fresh & np.concatenate([fresh[1:], [True]])
        tied = tied[~alone]
        width *= 2
    return order


class Bits:
    """Packed bits with how many are set before each word of 64."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.counts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.counts[1:])

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        """64 bits a word, with one word more than is needed at most."""
        out = np.zeros(Bits.words_of(len(bits)), "<u8")
        data = np.packbits(bits, bitorder="little")
        out.view(np.uint8)[: len(data)] = data
        return out

    @staticmethod
    def words_of(n: int) -> int:
        return n // 64 + 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.counts[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """The index of runs of symbols that each end with BREAK.

    ``uses``: how often each symbol occurs; ``planes``: the bit planes of the
    transform's wavelet matrix, from the highest bit; ``sampled`` and
    ``samples``: which rows have their suffix's place stored, and these places.
    """

    def __init__(self, n: int, uses: np.ndarray, planes: np.ndarray, sampled: np.ndarray, samples: np.ndarray):
        self.n, self.uses, self.samples = n, uses, samples
        self.before = np.concatenate([[0], np.cumsum(uses, dtype=np.int64)])
        self.bits = max(1, (len(uses) - 1).bit_length())
        self.planes = [Bits(x) for x in planes.reshape(self.bits, -1)]
        self.zeros = [n - int(p.rank(np.array([n]))[0]) for p in self.planes]
        self.sampled = Bits(sampled)

    @classmethod
    def of(cls, symbols: np.ndarray) -> FMIndex:
        n = len(symbols)
        order = suffix_array(symbols)
        uses = np.bincount(symbols, minlength=1)
        level = symbols[order - 1].astype(np.int32) if n else np.zeros(0, np.int32)  # the suffix at 0 wraps to the final BREAK
        planes = []
        for b in range(max(1, (len(uses) - 1).bit_length()) - 1, -1, -1):
            ones = (level >> b & 1).astype(bool)
            planes.append(Bits.packed(ones))
            level = np.concatenate([level[~ones], level[ones]])
        # run starts are sampled too, so no walk needs to cross a BREAK
        starts = np.zeros(n, bool)
        starts[:1] = True
        starts[1:] = symbols[:-1] == BREAK
        sampled = starts[order] | (order % SAMPLE == 0)
        return cls(n, uses, np.concatenate(planes), Bits.packed(sampled), order[sampled])

    def stored(self) -> dict[str, bytes | int]:
        """The parts as bytes."""
        return {"size": self.n, "uses": self.uses.astype("<i4").tobytes(), "planes": b"".join(p.words.tobytes() for p in self.planes), "sampled": self.sampled.words.tobytes(), "samples": self.samples.astype("<i4").tobytes()}

    @classmethod
    def restored(cls, parts: dict) -> FMIndex:
        return cls(parts["size"], np.frombuffer(parts["uses"], "<i4"), np.frombuffer(parts["planes"], "<u8"), np.frombuffer(parts["sampled"], "<u8"), np.frombuffer(parts["samples"], "<i4"))

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row in the transform."""
        low, high = np.zeros(len(row), np.int64), row.astype(np.int64)
        for plane, zeros, b in zip(self.planes, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = (symbol >> b & 1).astype(bool)
            a, c = plane.rank(low), plane.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + c, high - c)
        return high - low

    def last(self, row: np.ndarray) -> np.ndarray:
        """The transform's symbol at each row."""
        at, symbol = row.astype(np.int64), np.zeros(len(row), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one, ones = plane.get(at), plane.rank(at)
            symbol = symbol << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each phrase (a row of symbols, all of one length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.flatnonzero((phrases < len(self.uses)).all(axis=1)) if self.n else np.zeros(0, np.int64)
        gone = np.ones(len(phrases), bool)
        gone[alive] = False
        high[gone] = 0
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            low[alive] = self.before[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of every occurrence."""
        which = np.repeat(np.arange(len(low)), high - low)
        row = spans(low, high - low)
        place, walked = np.zeros(len(row), np.int64), 0
        todo = np.arange(len(row))
        while len(todo):
            at = row[todo]
            here = self.sampled.get(at)
            place[todo[here]] = self.samples[self.sampled.rank(at[here])] + walked
            todo, at = todo[~here], at[~here]
            symbol = self.last(at)
            row[todo] = self.before[symbol] + self.rank(symbol, at)
            walked += 1
        return which, place
