"""Filters of hashes whose size does not depend on the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23


def marked(hashes: DataFrame) -> np.ndarray:
    """One flag for each value that the last digits of the hashes of a one-column table take: what has none is not in the table."""
    name = hashes.columns[0]
    words = hashes.groupBy(F.shiftright(F.col(name).bitwiseAND(F.lit(BITS - 1)), 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 as int))")).alias("bits"))
    out = np.zeros(BITS >> 6, "int64")
    for r in words.toLocalIterator():
        out[r["at"]] = r["bits"]
    return np.unpackbits(out.view("uint8"), bitorder="little").view(bool)


def kept(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The hashes that ``marks`` does not rule out."""
    return hashes[marks[hashes & (BITS - 1)]]


class First:
    """Leaves out numbers of which it is sure that they are not among the ``most`` smallest of their key.

    A batch keeps that many of each key. The last of them, where a batch has so many, bounds what later batches keep of
    that key: one key a slot, all others are held to their batch alone.
    """

    SLOTS = 1 << 18

    def __init__(self, most: int) -> None:
        self.most = most
        self.owner = np.zeros(self.SLOTS, "int64")
        self.bound = np.full(self.SLOTS, np.iinfo("int64").max)

    def may_stay(self, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The positions of what may be among the smallest, in their order."""
        slot = keys & (self.SLOTS - 1)
        at = np.flatnonzero((self.owner[slot] != keys) | (numbers <= self.bound[slot]))
        order = at[np.lexsort((numbers[at], keys[at]))]
        k = keys[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
        rank = np.arange(len(k)) - np.repeat(start, np.diff(start, append=len(k)))
        last = order[rank == self.most - 1]
        free = last[self.bound[slot[last]] == np.iinfo("int64").max]
        self.owner[slot[free]] = keys[free]
        mine = last[self.owner[slot[last]] == keys[last]]
        self.bound[slot[mine]] = np.minimum(self.bound[slot[mine]], numbers[mine])
        return np.sort(order[rank < self.most])
