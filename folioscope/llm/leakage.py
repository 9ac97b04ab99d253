"""Passages of evaluation items inside a corpus.

Latent semantic retrieval: passages of the documents span a TF-IDF matrix over hashed words and word pairs whose
leading directions come from a randomised SVD, computed in passes over the corpus; windows of every document and of
every item are folded in, and pairs of near direction are candidates; candidates are checked for what the item alone
says, and confirmed by aligning the words of the item with those of the document, which allows for alterations,
omissions and interruptions, or by their longest common subsequence, which finds what was put in other words.
Texts are cut into words once; from then on a document is an array of word codes, and all work is numpy over batches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.names import edit_distance
from folioscope.llm.textform import transducer
from folioscope.session import cut_lineage

BUCKETS = 1 << 14  # hashed features
RANK, EXTRA = 56, 8  # directions kept, and more of them while the range is found
PASSAGE, STEP = 24, 8  # words of a document's window and between windows; an item's window has half as many
NEAR = 0.45  # cosine of a candidate
OWN_PAIRS = 1.5  # word pairs of an item's own that forty-eight words of a document have to hold, or
VERY_NEAR = 0.8  # the cosine of a candidate without them
SHARED = 3  # a sentence in so many items is an instruction
ENOUGH = 8.0  # score of an alignment: about fifteen words, of which the usual half belongs to the style
REWORDED = 11.0  # worth of a common subsequence within a stretch half as long again
MOST_ITEMS = 20_000  # items that go to every task
_TAG = regex.compile(r"<[^<>]{1,40}>|&\w{2,6};")
_WORD = regex.compile(r"[^\W_]+")
_BLOCK = 256
_CHUNK = 1 << 17  # words worked on at once
_FAN = 64  # partial matrices that one task adds up
_ALIKE = np.uint32(1 << 31)  # marks the code of a word that is an item's word but for a typing error


def words_of(text: str | None) -> list[str]:
    """Words in one form, lower case, markup off."""
    if not text:
        return []
    plain = text if text.isascii() else transducer().apply(text)
    if "<" in plain or "&" in plain:
        plain = _TAG.sub(" ", plain)
    return _WORD.findall(plain.lower())


def code_of(word: str) -> int:
    """31 bits of a word."""
    return zlib.crc32(word.encode()) & 0x7FFFFFFF


def _alike(a: str, b: str) -> bool:
    """Whether one of two longer words is the other but for a typing error that leaves the first or the last letter."""
    return len(a) > 3 and len(b) > 3 and abs(len(a) - len(b)) <= 1 and not a.isdigit() and (a[0] == b[0] or a[-1] == b[-1]) and edit_distance(a, b) == 1


class Coder:
    """Codes of words; a word that no item has but that is one of an item's words misspelt gets that word's code, marked."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.known = set(vocabulary)
        self.near: dict[str, list[str]] = {}
        for word in sorted(self.known):
            if len(word) > 3:
                for less in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
                    self.near.setdefault(less, []).append(word)
        self.memo: dict[str, int] = {}

    def code(self, word: str) -> int:
        if word in self.known or len(word) < 4:
            return code_of(word)
        for less in (word, *(word[:i] + word[i + 1 :] for i in range(len(word)))):
            for mate in self.near.get(less, ()):
                if _alike(mate, word):
                    return code_of(mate) | 1 << 31
        return code_of(word)

    def codes(self, words: list[str]) -> list[int]:
        memo = self.memo
        try:
            return [memo[w] for w in words]
        except KeyError:
            if len(memo) > 500_000:
                memo.clear()
            for w in set(words):
                if w not in memo:
                    memo[w] = self.code(w)
            return [memo[w] for w in words]


def coded(documents: DataFrame, key: str, text: str, vocabulary: list[str]) -> DataFrame:
    """(key, codes): the words of each text as 32-bit codes. Texts without words have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)
        for batch in batches:
            out = [np.array(coder.codes(words_of(t)), np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [key, "codes"])

    kind = documents.schema[key].dataType.simpleString()
    base = documents.select(F.col(key), F.col(text).cast("string").alias("__text")).filter("length(__text) > 0")
    return base.mapInArrow(run, f"`{key}` {kind}, codes binary").filter("length(codes) > 0")


class Words:
    """The documents of an Arrow batch: word codes end to end, the document of each word and its place there."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        self.flagged, self.lengths = codes, lengths
        self.codes = codes & ~_ALIKE
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(codes)) - self.starts[:-1][self.doc]

    @staticmethod
    def of(column: pa.Array) -> Iterator[tuple[int, Words]]:
        """The batch in parts of about ``_CHUNK`` words, each with the seat of its first document."""
        blobs = column.to_pylist()
        at, held = 0, 0
        for i, blob in enumerate(blobs):
            held += len(blob) // 4
            if held >= _CHUNK or i == len(blobs) - 1:
                part = blobs[at : i + 1]
                yield at, Words(np.frombuffer(b"".join(part), np.uint32), np.array([len(b) // 4 for b in part]))
                at, held = i + 1, 0

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """64-bit codes of neighbouring words, and where each begins."""
        at = np.flatnonzero(self.doc[1:] == self.doc[:-1]) if len(self.doc) else np.zeros(0, np.int64)
        return pair_codes(self.codes[at], self.codes[at + 1]), at


def pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _features(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and owner of each word and pair in consecutive runs of ``size`` words of each document, sorted by owner, and the number of runs."""
    runs = -(-words.lengths // size)
    base = np.concatenate(([0], np.cumsum(runs)))
    owner = base[:-1][words.doc] + words.place // size
    codes, at = words.pairs()
    inside = owner[at] == owner[at + 1]
    buckets = np.concatenate((words.codes % BUCKETS, (codes[inside] >> np.uint64(20)) % np.uint64(BUCKETS))).astype(np.int64)
    owners = np.concatenate((owner, owner[at[inside]]))
    order = np.argsort(owners, kind="stable")
    return buckets[order], owners[order], int(base[-1])


def _blocks(matrix: np.ndarray) -> pa.RecordBatch:
    n = BUCKETS // _BLOCK
    data = [matrix[i * _BLOCK : (i + 1) * _BLOCK].astype(np.float64).tobytes() for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(data, pa.binary())], ["part", "block", "data"])


_PARTIAL = "part long, block int, data binary"


def _add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.float64) for b in frame["data"])
    return pd.DataFrame({"part": [key[0]], "block": [key[1]], "data": [total.tobytes()]})


def _summed(parts: DataFrame, tasks: int, width: int) -> np.ndarray:
    """Sum of the partial matrices of all tasks, in a tree: a task adds up at most ``_FAN`` blocks; the result has a fixed size."""
    while tasks > 1:
        tasks = -(-tasks // _FAN)
        parts = parts.groupBy((F.floor(F.col("part") / _FAN) if tasks > 1 else F.lit(0).cast("long")).cast("long").alias("part"), "block").applyInPandas(_add, _PARTIAL)
    out = np.zeros((BUCKETS, width))
    for row in parts.toLocalIterator():
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] += np.frombuffer(row["data"], np.float64).reshape(_BLOCK, width)
    return out


def inverse_frequencies(texts: DataFrame, tasks: int) -> np.ndarray:
    """The weight of each bucket: smoothed inverse frequency over the passages of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, 2))
        for batch in batches:
            for _, words in Words.of(batch.column(0)):
                buckets, owners, n = _features(words, PASSAGE)
                total[:, 0] += np.bincount(np.unique(owners * BUCKETS + buckets) % BUCKETS, minlength=BUCKETS)
                total[0, 1] += n
        yield _blocks(total)

    counts = _summed(texts.mapInArrow(count, _PARTIAL), tasks, 2)
    return (np.log((1 + counts[:, 1].sum()) / (1 + counts[:, 0])) + 1).astype(np.float32)


def directions(texts: DataFrame, tasks: int, weights: np.ndarray, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages of all texts, by a randomised range finder in one pass.

    Each task sums A'(A W) of its passages A for a random W; the eigenvectors of A'A in the range of the sum follow
    from the sum and W alone, without another pass.
    """
    width = RANK + EXTRA
    start, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, width)))
    small = start.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, width), np.float32)
        for batch in batches:
            for _, words in Words.of(batch.column(0)):
                buckets, owners, _ = _features(words, PASSAGE)
                value = weights[buckets]
                edges = np.concatenate(([0], np.flatnonzero(np.diff(owners)) + 1))
                value /= np.sqrt(np.add.reduceat(value * value, edges))[owners]
                seen = np.add.reduceat(small[buckets] * value[:, None], edges, axis=0)
                order = np.argsort(buckets, kind="stable")
                first = np.concatenate(([0], np.flatnonzero(np.diff(buckets[order])) + 1))
                total[buckets[order][first]] += np.add.reduceat(seen[owners[order]] * value[order][:, None], first, axis=0)
        yield _blocks(total)

    image = _summed(texts.mapInArrow(run, _PARTIAL), tasks, width)
    core = start.T @ image
    values, turn = np.linalg.eigh((core + core.T) / 2)
    kept = values > max(values[-1], 0.0) * 1e-7
    axes, _, _ = np.linalg.svd(image @ (turn[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    out = np.zeros((BUCKETS, RANK), np.float32)  # few passages have fewer directions
    out[:, : min(RANK, axes.shape[1])] = axes[:, :RANK]
    return out


def fold_in(words: Words, weights: np.ndarray, axes: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and unit vector of the windows of ``size`` words, every ``step`` words; a short text is one window."""
    flow = axes[words.codes % BUCKETS] * weights[words.codes % BUCKETS][:, None]
    codes, at = words.pairs()
    two = ((codes >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)
    flow[at] += axes[two] * weights[two][:, None]
    runs = -(-words.lengths // step)
    base = np.concatenate(([0], np.cumsum(runs)))
    doc = np.repeat(np.arange(len(runs)), runs)
    seat = np.arange(base[-1]) - base[:-1][doc]
    sums = np.add.reduceat(flow, words.starts[:-1][doc] + seat * step, axis=0)
    vectors = sums.copy()
    for k in range(1, size // step):
        more = seat + k < runs[doc]
        vectors[more] += sums[np.flatnonzero(more) + k]
    keep = (seat == 0) | (seat + size // step <= runs[doc])  # windows that end with the text are part of one before them
    vectors, doc, seat = vectors[keep], doc[keep], seat[keep]
    return doc, seat * step, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def own_words(items: list[tuple[int, str | None]]) -> dict[int, list[str]]:
    """Words of each item without the sentences, lines and labels that many items share."""
    cut = {i: [words_of(s) for s in regex.split(r"(?<=[.;:?!])\s+|\n+", text or "")] for i, text in items}
    seen = Counter(s for parts in cut.values() for s in {tuple(p) for p in parts})
    return {i: [w for p in parts if seen[tuple(p)] < SHARED for w in p] for i, parts in cut.items()}


def own_weights(own: dict[int, list[str]]) -> dict[int, list[float]]:
    """How much each word says about its item: near 0 in phrases of the style of many items, 1 in phrases of its own."""
    pairs = {i: list(zip(w, w[1:])) for i, w in own.items()}
    spread = Counter(p for each in pairs.values() for p in set(each))
    top = np.log(max(len(own), 2))
    out = {}
    for i, each in pairs.items():
        worth = [float(1 - np.log(spread[p]) / top) for p in each]
        out[i] = [(a + b) / 2 for a, b in zip([worth[0], *worth], [*worth, worth[-1]])] if worth else [1.0] * len(own[i])
    return out


def alignments(like: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Score of the best common stretch of each item and text: words in order count by their weights, wrong words are a loss, an interruption of the text a small one.

    ``like[c, i, j]`` is 1 where a word of the item is the text's, less where it is alike, and -1 elsewhere.
    """
    cells, n, width = like.shape
    best, row = np.zeros(cells, np.float32), np.zeros((cells, width + 1), np.float32)
    slope = 0.15 * np.arange(width + 1, dtype=np.float32)
    for i in range(n):
        gain = np.where(like[:, i] > 0, like[:, i] * worth[:, i, None], like[:, i])
        new = np.maximum(row, 0.8)  # an item's word left out
        new -= 0.8
        np.maximum(new[:, 1:], row[:, :-1] + gain, out=new[:, 1:])
        pause = np.maximum.accumulate(new + slope, axis=1)[:, :-1] - slope[1:] - 0.85  # the text goes on after an interruption
        np.maximum(new[:, 1:], pause, out=new[:, 1:])
        new[:, 0] = 0
        row = new
        np.maximum(best, row.max(axis=1), out=best)
    return best


def subsequences(like: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Worth of the longest common subsequence of each item's stretch and text."""
    cells, n, width = like.shape
    row = np.zeros((cells, width + 1), np.float32)
    for i in range(n):
        new = row.copy()
        np.maximum(new[:, 1:], row[:, :-1] + np.maximum(like[:, i], 0) * worth[:, i, None], out=new[:, 1:])
        row = np.maximum.accumulate(new, axis=1)
    return row[:, -1]


class Items:
    """The evaluation items as arrays: windows folded in, the holders of each word pair, words and their worth."""

    def __init__(self, own: dict[int, list[str]], weights: np.ndarray, axes: np.ndarray) -> None:
        self.ids = list(own)
        lengths = np.array([len(own[i]) for i in self.ids])
        self.words = Words(np.array([code_of(w) for i in self.ids for w in own[i]], np.uint32), lengths)
        windows = [fold_in(Words(self.words.codes[a:b], np.array([b - a])), weights, axes, PASSAGE // 2, 4) for a, b in zip(self.words.starts[:-1], self.words.starts[1:])]
        self.first = np.concatenate([w[1] for w in windows])
        self.of_window = np.repeat(np.arange(len(windows)), [len(w[1]) for w in windows])
        self.edges = np.concatenate(([0], np.cumsum([len(w[1]) for w in windows])[:-1]))
        self.matrix = np.ascontiguousarray(np.concatenate([w[2] for w in windows]).T)
        codes, at = self.words.pairs()
        held = np.unique(np.stack((codes, self.words.doc[at].astype(np.uint64))), axis=1)
        self.pairs, self.begin, spread = np.unique(held[0], return_index=True, return_counts=True)
        self.spread, self.holders = spread, held[1].astype(np.int64)
        self.worth = np.concatenate([np.array(v, np.float32) for v in own_weights(own).values()])
        # words of all items, and which of them are alike
        vocabulary = sorted({w for words in own.values() for w in words})
        order = np.argsort([code_of(w) for w in vocabulary])
        self.codes = np.array([code_of(vocabulary[i]) for i in order], np.uint32)
        seat = {vocabulary[i]: k for k, i in enumerate(order.tolist())}
        near = Coder(vocabulary).near
        mates = {(a, b) for group in near.values() for a in group for b in group if a != b}
        self.alike = np.array([(seat[a], seat[b]) for a, b in mates if _alike(a, b)], np.int64).reshape(-1, 2)

    def seats(self, flagged: np.ndarray) -> np.ndarray:
        """Seat of each word among the items' words, after the last for a word that none has."""
        codes = flagged & ~_ALIKE
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, len(self.codes))

    def table(self) -> np.ndarray:
        """How alike each two of the items' words are."""
        n = len(self.codes)
        out = np.full((n + 1, n + 1), -1, np.float32)
        out[np.arange(n), np.arange(n)] = 1
        out[self.alike[:, 0], self.alike[:, 1]] = 0.8
        return out

    def own_pairs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(run, item): the worth of the different word pairs that an item and two runs of ``PASSAGE`` words share, a pair of one item alone counting 1; and the first run of each document."""
        codes, at = words.pairs()
        seat = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        hit = np.flatnonzero(self.pairs[seat] == codes)
        runs = -(-words.lengths // PASSAGE)
        base = np.concatenate(([0], np.cumsum(runs)))
        here = base[:-1][words.doc[at[hit]]] + words.place[at[hit]] // PASSAGE
        run, pair = np.divmod(np.unique(here * len(self.pairs) + seat[hit]), len(self.pairs))
        times = self.spread[pair]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item = self.holders[np.repeat(self.begin[pair], times) + inner]
        worth = np.bincount(np.repeat(run, times) * len(self.ids) + item, weights=np.repeat(1.0 / times, times), minlength=base[-1] * len(self.ids)).reshape(-1, len(self.ids))
        owner = np.repeat(np.arange(len(runs)), runs)
        worth[:-1] += np.where((owner[1:] == owner[:-1])[:, None], worth[1:], 0)
        return worth, base


def _likes(items: Items, table: np.ndarray, words: Words, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likeness and worth of the words of stretches (item's first and last, text's first and last), padded to one size."""
    first, stop, begin, end = spans.T
    inner = lambda a, b: np.minimum(a[:, None] + np.arange((b - a).max()), b[:, None] - 1)
    i, j = inner(first, stop), inner(begin, end)
    more, less = np.arange(i.shape[1]) >= (stop - first)[:, None], np.arange(j.shape[1]) >= (end - begin)[:, None]
    nothing = len(table) - 1
    own, text = np.where(more, nothing, items.seats(items.words.codes)[i]), np.where(less, nothing, items.seats(words.flagged[j]))
    worth, slips = np.where(more, np.float32(0), items.worth[i]), ~less & (words.flagged[j] >= _ALIKE)
    like = table[own[:, :, None], text[:, None, :]]
    return np.where(slips[:, None, :] & (like == 1), np.float32(0.8), like), worth


def _scores(items: Items, table: np.ndarray, words: Words, spans: np.ndarray, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The measure of every stretch, those of like size together, a few million cells at once."""
    out = np.zeros(len(spans), np.float32)
    cells = (spans[:, 1] - spans[:, 0]) * (spans[:, 3] - spans[:, 2])
    order = np.argsort(cells, kind="stable")
    at = 0
    while at < len(order):
        step = max(1, int(2_000_000 // max(1, cells[order[min(at + 63, len(order) - 1)]])))
        some = order[at : at + min(step, 64)]
        out[some] = measure(*_likes(items, table, words, spans[some]))
        at += len(some)
    return out


def found_in(words: Words, items: Items, table: np.ndarray, weights: np.ndarray, axes: np.ndarray) -> list[tuple[int, int, float]]:
    """(document, seat of the item, score) of each passage found."""
    doc, first, vectors = fold_in(words, weights, axes, PASSAGE, STEP)
    worth, base = items.own_pairs(words)
    best = np.concatenate([np.maximum.reduceat(vectors[at : at + 1024] @ items.matrix, items.edges, axis=1) for at in range(0, len(doc), 1024)])
    literal = (best >= NEAR) & (worth >= OWN_PAIRS)[base[doc] + first // PASSAGE]
    out: dict[tuple[int, int], float] = {}

    def keep(d: np.ndarray, i: np.ndarray, score: np.ndarray, enough: float) -> None:
        for k in np.flatnonzero(score >= enough).tolist():
            at = (int(d[k]), int(i[k]))
            out[at] = max(out.get(at, 0.0), float(score[k]))

    # windows of a document near one item, joined to stretches of its text
    item, window = np.nonzero(literal.T)
    if len(window):
        d, lo = doc[window], first[window]
        fresh = np.concatenate(([True], (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > lo[:-1] + 2 * PASSAGE)))
        begin = np.flatnonzero(fresh)
        finish = np.concatenate((begin[1:], [len(d)])) - 1
        start, end = words.starts[d[begin]], words.starts[d[begin] + 1]
        stretch = (items.words.starts[item[begin]], items.words.starts[item[begin] + 1], np.maximum(start, start + lo[begin] - 2 * PASSAGE), np.minimum(end, start + lo[finish] + 3 * PASSAGE))
        keep(d[begin], item[begin], _scores(items, table, words, np.stack(stretch, 1), alignments), ENOUGH)
    # put in other words: where a document is nearest to an item, thirty of the item's words against text half as long again
    edges = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    seat, item = np.nonzero(np.maximum.reduceat(best, edges, axis=0) >= VERY_NEAR)
    seen = np.maximum.reduceat(literal, edges, axis=0)[seat, item]
    seat, item = seat[~seen], item[~seen]
    if len(seat):
        last = np.concatenate((edges[1:], [len(doc)]))
        window = np.array([edges[k] + best[edges[k] : last[k], i].argmax() for k, i in zip(seat.tolist(), item.tolist())])
        finish = np.concatenate((items.edges[1:], [items.matrix.shape[1]]))
        nearest = np.array([items.edges[i] + (vectors[w] @ items.matrix[:, items.edges[i] : finish[i]]).argmax() for w, i in zip(window.tolist(), item.tolist())])
        own, start, end = items.words.starts[item], words.starts[doc[window]], words.starts[doc[window] + 1]
        mid, at = own + items.first[nearest], start + first[window]
        spans = np.stack((np.maximum(own, mid - 9), np.minimum(items.words.starts[item + 1], mid + 21), np.maximum(start, at - 9), np.minimum(end, at + PASSAGE + 12)), 1)
        keep(doc[window], item, _scores(items, table, words, spans, subsequences), REWORDED)
    return [(a, b, s) for (a, b), s in out.items()]


def leaked(documents: DataFrame, items: list[tuple[int, str | None]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, score): each document with each item of which it holds a passage.

    ``items`` is the fixed evaluation set, which goes to every executor and may not exceed ``MOST_ITEMS``; every
    document is read whole. Null and empty texts hold nothing; items whose words are all shared leak nothing, and
    neither a text nor an item of fewer than ``ENOUGH`` words can reach the score, for a word counts 1 at most;
    repeated documents are reported each; ties are all reported; other columns are not read; an empty table or set
    gives an empty result.
    """
    if len(items) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items: they do not fit into every task")
    own = {i: w for i, w in own_words(items).items() if len(w) >= ENOUGH}
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not own:
        return documents.sparkSession.createDataFrame([], schema)
    base = cut_lineage(coded(documents, key, text, sorted({w for words in own.values() for w in words})))
    some, tasks = base.select("codes"), base.rdd.getNumPartitions()
    weights = inverse_frequencies(some, tasks)
    axes = directions(some, tasks, weights)
    known = Items(own, weights, axes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.table()
        for batch in batches:
            rows = [(at + d, known.ids[i], s) for at, words in Words.of(batch.column(1)) for d, i, s in found_in(words, known, table, weights, axes)]
            seats, ids, scores = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(seats, pa.int64())), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], [key, "item_id", "score"])

    return base.mapInArrow(search, schema)
