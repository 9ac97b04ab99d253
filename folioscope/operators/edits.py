"""Edit distances of many pairs of plain texts at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """The Levenshtein distance of each pair of ASCII texts, whatever their lengths.

    A column of the table of distances is held as bits, one for each step up or down between neighbours, in words of 64
    rows (Myers 1999, Hyyrö 2003); all pairs go on by one sign of ``b`` at a time, the pairs of longer texts first.
    """
    out = np.zeros(len(a), "int64")
    rows, signs = np.fromiter(map(len, a), int, len(a)), np.fromiter(map(len, b), int, len(b))
    words = (rows + 63) // 64
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        at = at[np.argsort(-signs[at], kind="stable")]
        out[at] = _distances([a[i] for i in at], [b[i] for i in at], rows[at], signs[at], int(w)) if w else signs[at]
    return out


def _codes(texts: list[str], size: int) -> np.ndarray:
    """The signs of the texts as numbers, one column for each text."""
    return np.ascontiguousarray(np.array(texts, f"S{max(size, 1)}").view("uint8").reshape(len(texts), -1).T)


def _distances(a: list[str], b: list[str], rows: np.ndarray, signs: np.ndarray, words: int) -> np.ndarray:
    n, one = len(a), np.uint64(1)
    left, right = _codes(a, rows.max()), _codes(b, signs.max())
    used = np.unique(left)
    place = np.zeros(256, int)
    place[used] = np.arange(len(used))
    held = np.zeros((words, len(used) + 1, n), "uint64")  # the rows at which a sign stands; the last: a sign that stands nowhere
    every = np.arange(n)
    for i, signs_at in enumerate(left):
        on = every[rows > i]
        held[i // 64, place[signs_at[on]], on] |= one << np.uint64(i % 64)
    nowhere = np.full(256, len(used))
    nowhere[used] = np.arange(len(used))
    up = np.full((words, n), ~np.uint64(0))
    down = np.zeros((words, n), "uint64")
    last = ((rows - 1) % 64).astype("uint64")
    score = rows.copy()
    for j, signs_at in enumerate(right):
        m = int(np.searchsorted(-signs, -j, "left"))  # the pairs that have a sign left
        if not m:
            break
        signs_at = nowhere[signs_at[:m]]
        more, less = np.full(m, one), np.zeros(m, "uint64")  # steps into the topmost row of the word
        for w in range(words):
            equal, p, d = held[w, signs_at, every[:m]], up[w, :m], down[w, :m]
            v = equal | d
            equal |= less
            h = (((equal & p) + p) ^ p) | equal
            plus, minus = d | ~(h | p), p & h
            if w == words - 1:
                score[:m] += ((plus >> last[:m]) & one).astype(int) - ((minus >> last[:m]) & one).astype(int)
            shifted, lowered = (plus << one) | more, (minus << one) | less
            more, less = plus >> np.uint64(63), minus >> np.uint64(63)
            up[w, :m], down[w, :m] = lowered | ~(v | shifted), shifted & v
    return score


@F.pandas_udf(T.IntegerType())
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Levenshtein distance of two ASCII texts that are not null."""
    return pd.Series(edit_distances(a.tolist(), b.tolist()), a.index)
