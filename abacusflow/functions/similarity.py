"""Similarity of names by their sets of words."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit-parallel step per character."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << k)
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        match = state & places.get(c, 0)
        state = ((state + match) | (state - match)) & full
    return len(a) - state.bit_count()


def _ratio(a: str, b: str) -> float:
    return 100.0 * 2 * _common(a, b) / (len(a) + len(b)) if a or b else 0.0


def token_set(a: str, b: str) -> float:
    """0 to 100: the best ratio among the shared words and the shared words with either side's rest; 100 if one side's words are in the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and (not left or not right):
        return 100.0
    one, two = (f"{shared} {rest}".strip() for rest in (left, right))
    return max(_ratio(one, two), *([_ratio(shared, one), _ratio(shared, two)] if shared else [0.0]))


def partial(a: str, b: str, floor: float = 0.0) -> float:
    """0 to 100: the best ratio of the shorter text with a part of the longer: any part of its length, or a shorter one at either end. 0 if that is not above ``floor``.

    One bit-parallel pass over the parts that begin with a character of the shorter
    text, or are at the start; a part is given up where even a full match of what
    is left could not beat the best so far.
    """
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        return partial(b, a, floor)
    best = _aligned(a, b, floor)
    return max(best, _aligned(b, a, max(floor, best))) if len(a) == len(b) else best


def _aligned(a: str, b: str, best: float) -> float:
    m, n = len(a), len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << k)
    full, found = (1 << m) - 1, 0.0
    for start in range(n):
        if start and b[start] not in places:
            continue  # the part from the next character on does as well
        end = min(start + m, n)
        if 200.0 * min(m, end - start) / (m + end - start) <= best:
            continue
        state = full
        for at in range(start, end):
            match = state & places.get(b[at], 0)
            state = ((state + match) | (state - match)) & full
            size = at + 1 - start
            # a whole part counts, and at the start of the text every shorter one
            if at + 1 == end or not start:
                ratio = 200.0 * (m - state.bit_count()) / (m + size)
                if ratio > best:
                    best = found = ratio
    return found


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    """Rows that meet on an amount come together, so that pairs of equal names do too: each is scored once a batch."""
    once = cache(token_set)
    return pd.Series(np.fromiter((once(x or "", y or "") for x, y in zip(a, b, strict=True)), float, len(a)))


def token_set_ratio(a: Column, b: Column) -> Column:
    """``token_set`` of two folded columns; missing names score 0. Use it after filters on amounts, dates or shared words."""
    return F.pandas_udf(_scores, "double")(a, b)
