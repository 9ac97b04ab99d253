"""Titles as typed: content words in one form, search by shared keys, and the test whether two titles name one work."""

from __future__ import annotations

import functools
import hashlib
import html
import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.names import edit_distance
from folioscope.llm.textform import transducer
from folioscope.operators.marks import BITS, marked
from folioscope.session import cut_lineage, release

# Function words that come and go between spellings of a title, and short forms of terms.
DROPPED = frozenset("a an the of for in and on to s et al".split())
SHORT_FORMS = {"asp": "answer set", "lp": "logic program", "lps": "logic programs", "kb": "knowledge base", "kbs": "knowledge bases", "ai": "artificial intelligence", "dl": "description logic", "dls": "description logics"}
# Remarks on the form of publication, which do not make another work.
_REMARK = regex.compile(r"(?:[\s:–—-]*(?:[(\[][^()\[\]]{2,40}[)\]]|[–—:-]\s*(?:extended|full|long|short|revised|preliminary)\s+(?:version|abstract|paper|report)))+[\s.]*$", regex.I)
# Words that make another work of the same title.
_VARIANT = regex.compile(
    r"\b(?:part\s+(?:[ivx]+|\d+|one|two|three)|(?:un)?decidable\s+case|(?:lower|upper)\s+bounds?|(?:first|second|third|final|interim|progress|annual)\s+report|(?:\w+\s+)?edition|volume\s+\w+"
    r"|repl(?:y|ies)|rebuttal|comments?\s+on|comment|response\s+to|response|rejoinder|survey|tutorial|overview|revisited|corrigendum|erratum|addendum|retraction|(?:ten|five|twenty|\d+)\s+years)\b",
    regex.I,
)
# Each alternative of the pattern above holds one of these words.
_VARIANT_WORDS = frozenset("part case bound bounds report edition volume reply replies rebuttal comment comments response rejoinder survey tutorial overview revisited corrigendum erratum addendum retraction years".split())
_CUT = regex.compile(r"\s*(?:\.\s*){3,}\s*$|\s*…\s*$")
_TOKEN = regex.compile(r"[^\W_]+")

SHAPE = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("variant", T.StringType()), T.StructField("cut", T.BooleanType())])


def _plain(text: str) -> str:
    if text.isascii():  # the transducer and the normal form leave it as it is
        text = html.unescape(text.lower()).replace("'", "")
        if text.isascii():
            return text.strip()
    else:
        text = html.unescape((transducer().apply(text) or "").lower())
    low = unicodedata.normalize("NFKD", text.replace("’", "'").replace("'", ""))
    return "".join(c for c in low if not unicodedata.combining(c)).strip()


def shape_title(title: str | None, words: dict[str, str] | None = None) -> tuple[list[str], str, bool]:
    """Content words in order, the variant of the work that the title names, and whether it was cut off."""
    text = _plain(title or "")
    text = _REMARK.sub("", text).strip()
    bare = _CUT.sub("", text)
    cut = bare != text
    fix = words or {}
    tokens: list[str] = []
    for token in _TOKEN.findall(bare):
        token = fix.get(token, token)
        tokens.extend(SHORT_FORMS[token].split() if token in SHORT_FORMS else [token])
    line = " ".join(tokens)
    if _VARIANT_WORDS.isdisjoint(line.lower().split()):
        return [t for t in tokens if t not in DROPPED], "", cut
    variant = " ".join(sorted(m.group().lower() for m in _VARIANT.finditer(line)))
    kept = [t for t in _TOKEN.findall(_VARIANT.sub(" ", line)) if t not in DROPPED]
    return kept, variant, cut


class Speller:
    """Corrects words one letter off exactly one usual word."""

    def __init__(self, usual: frozenset[str]) -> None:
        self.usual = usual
        self.near: dict[str, set[str]] = {}
        for word in usual:
            if len(word) > 4:
                for i in range(len(word)):
                    self.near.setdefault(word[:i] + word[i + 1 :], set()).add(word)
        self.memo: dict[str, str] = {}

    def get(self, word: str, default: str) -> str:
        if word in self.usual or len(word) < 4 or not word.isalpha():
            return default
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo = {}
            maybe = set(self.near.get(word, ()))
            for i in range(len(word)):
                less = word[:i] + word[i + 1 :]
                maybe |= self.near.get(less, set()) | ({less} if less in self.usual and len(less) > 4 else set())
            hits = [w for w in maybe if edit_distance(word, w) <= 1]
            hits = [w for w in hits if len(w) == len(word)] if len(hits) > 1 else hits
            self.memo[word] = hits[0] if len(hits) == 1 else default
        return self.memo[word]


def usual_words(titles: DataFrame, column: str, share: float = 1 / 5000, least: int = 5) -> frozenset[str]:
    """Words that at least ``least`` rows and the ``share`` of all rows use: at most the words per title over ``share``."""
    low = F.regexp_replace(F.lower(F.col(column)), "['’]", "")
    words = titles.select(F.explode(F.array_distinct(F.split(low, r"[^a-z]+"))).alias("w")).filter(F.length("w") > 1)
    rows = titles.count()
    usual = words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= max(least, rows * share))
    return frozenset(r["w"] for r in usual.toLocalIterator())


def usual_tokens(df: DataFrame, column: str, share: float = 1 / 5000, least: int = 5) -> frozenset[str]:
    """The usual words of titles given as content words, so with accents off: bounded like ``usual_words``."""
    rows = df.count()
    words = df.select(F.explode(F.array_distinct(column)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return frozenset(r["w"] for r in words.filter(F.col("n") >= max(least, rows * share)).toLocalIterator())


def shaped(df: DataFrame, column: str, usual: frozenset[str]) -> DataFrame:
    """``df`` with the columns tokens, variant and cut of its title. A null title has no tokens."""

    @F.pandas_udf(SHAPE)
    def shape(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Speller(usual)
        for batch in batches:
            yield pd.DataFrame([shape_title(x, words) for x in batch], columns=SHAPE.names)

    return df.withColumn("__shape", shape(F.col(column))).select(*df.columns, "__shape.*")


@functools.lru_cache(1 << 17)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


def _salt(kind: str) -> int:
    return _word_hash(f"\x1f{kind}")


KINDS = {"same": ("same", "same"), "head": ("short", "long"), "word": ("one word", "any word")}  # what meets what
MANY = 64  # readings of a title beyond which it is searched by one of its words instead
FEW = 3  # usual words below which unusual ones say more than the rest of a title
_MASK = (1 << 64) - 1
_OTHER = _word_hash("\x1fother")  # stands for any unusual word


def _most(least: int) -> int:
    """Typing errors between two words, the shorter of which has ``least`` letters; see ``_like``."""
    return 0 if least < 4 else 1 if least < 5 else 2 if least < 12 else 3


def _shorter(word: str, most: int) -> set[str]:
    """The word and what is left of it without up to ``most`` letters: two words with so many errors between them share one of these."""
    return {"".join(x) for k in range(min(most, len(word)) + 1) for x in itertools.combinations(word, len(word) - k)}


class Keys:
    """Keys of which two titles share one if ``likeness`` calls them the same or one the beginning of the other, whatever words they consist of.

    Usual words that typing errors can turn into each other, also by way of others, are one class. An unusual word stands
    for an unusual word of the other title or for a usual one: it is read as "any other word" and as each class it may be a
    misspelling of. Titles that are the same agree in one reading of all their words.

    same: the sum of a reading's words and their number, for any order.
    short, long: the reading of the first words in their places, to seven, less the last of the shorter title, and less two
    where its last has under four letters. A beginning allows one error a word, so fewer classes.
    one word, any word: a title of many readings, or of unusual words with few usual ones, is searched by one unusual word: by the
    usual words near it and by what is left of it without as many letters as there may be errors.
    """

    def __init__(self, usual: frozenset[str]) -> None:
        self.words = sorted(usual)
        self.sizes = np.array([len(w) for w in self.words], int)
        self.bits = np.array([_letters(w) for w in self.words], "uint64")
        self.read: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.near: dict[str, list[tuple[str, bool]]] = {}
        self.place = [_word_hash(f"place{i}") | 1 for i in range(7)]
        self.starts = [_salt(f"first{n}") for n in range(8)]
        first = {w: w for w in self.words}

        def root(w: str) -> str:
            while first[w] != w:
                w = first[w]
            return w

        for word in self.words:
            for mate, _ in self._near(word):
                one, two = sorted((root(word), root(mate)))
                first[two] = one
        self.usual = {w: _word_hash(root(w)) for w in self.words}
        self.near = {}

    def _near(self, word: str) -> list[tuple[str, bool]]:
        """Usual words other than this that ``likeness`` may take for it, and whether by one error."""
        if word not in self.near:
            if len(self.near) > 200_000:
                self.near = {}
            n = len(word)
            least = np.minimum(self.sizes, n)
            limit = np.maximum(np.select([least < 4, least < 5, least < 12], [0, 1, 2], 3), np.maximum(self.sizes, n) > 3)
            at = np.flatnonzero((np.abs(self.sizes - n) <= limit) & (np.bitwise_count(self.bits ^ np.uint64(_letters(word))) <= 2 * limit))
            hits = [w for i in at if (w := self.words[i]) != word and _misspelt(word, w, int(limit[i]))]
            self.near[word] = [(w, edit_distance(word, w) <= 1) for w in hits]
        return self.near[word]

    def _readings(self, word: str, one: bool) -> tuple[int, ...]:
        """The hashes that a word is read as; one: for a single error."""
        if word in self.usual:
            return (self.usual[word],)
        if (word, one) not in self.read:
            if len(self.read) > 200_000:
                self.read = {}
            self.read[word, one] = (_OTHER, *sorted({self.usual[w] for w, close in self._near(word) if close or not one}))
        return self.read[word, one]

    def _searched(self, words: list[str]) -> str | None:
        """The unusual word that a title is searched by, if it is one of those that need it."""
        unusual = [w for w in words if w not in self.usual]
        if unusual and (len(words) - len(unusual) < FEW or math.prod(len(self._readings(w, False)) for w in unusual) > MANY):
            return max(unusual, key=lambda w: (len(w), -len(self._near(w)), w))
        return None

    def _same(self, words: list[str]) -> Iterator[int]:
        salt = _salt(f"same{len(words)}")
        if self.usual.keys() >= set(words):
            yield sum(self.usual[w] for w in words) + salt
        elif self._searched(words) is None:
            for reading in itertools.product(*(self._readings(w, False) for w in words)):
                yield sum(reading) + salt

    def _first(self, words: list[str], n: int) -> Iterator[int]:
        salt = self.starts[n]
        for reading in itertools.product(*(self._readings(w, True) for w in words[:n])):
            key = sum(x * p for x, p in zip(reading, self.place)) + salt
            if _OTHER in reading and n - reading.count(_OTHER) < FEW:  # an unusual word stands in its place on both sides
                at = reading.index(_OTHER)
                yield from (key + _word_hash(w) * self.place[at] for w in _shorter(words[at], 1))
            else:
                yield key

    def _short(self, words: list[str]) -> Iterator[int]:
        n = len(words)
        for n in {min(n - 1, 7), *([min(n - 2, 7)] if n > 3 and len(words[-1]) < 4 else [])} if n > 2 else ():
            yield from self._first(words, n)

    def _long(self, words: list[str]) -> Iterator[int]:
        total = known = 0
        for w in words[:7]:
            if w not in self.usual:
                break
            total += self.usual[w] * self.place[known]
            known += 1
            if 2 <= known < len(words):
                yield total + self.starts[known]
        for n in range(max(known + 1, 2), min(len(words), 8)):
            yield from self._first(words, n)

    def _one_word(self, words: list[str]) -> Iterator[int]:
        word = self._searched(words)
        if word is not None:
            salt = _salt(f"word{len(words)}")
            yield salt  # meets nothing, but tells that titles of this length are searched
            yield from (_word_hash(w) + salt for w in {w for w, _ in self._near(word)} | _shorter(word, _most(len(word))))

    def _any_word(self, words: list[str]) -> Iterator[int]:
        salt = _salt(f"word{len(words)}")
        for word in set(words):
            yield from (_word_hash(w) + salt for w in ([word] if word in self.usual else _shorter(word, _most(len(word)))))

    def of(self, titles: list, kind: str, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position of the title, key) of one kind of all titles, each pair once; with ``marks`` keys that these rule out may be left out."""
        make = getattr(self, "_" + kind.replace(" ", "_"))
        if marks is not None and kind == "any word":
            titles = [words if marks[_salt(f"word{len(words)}") & (BITS - 1)] else () for words in titles]
        own = [{k & _MASK for k in make(words)} if words else () for words in titles]
        count = [len(x) for x in own]
        return np.repeat(np.arange(len(own)), count), np.fromiter(itertools.chain.from_iterable(own), "uint64", sum(count))


@functools.lru_cache(2)
def keys_of(usual: frozenset[str]) -> Keys:
    """What is known of words is kept from one task to the next."""
    return Keys(usual)


def title_keys(tokens: list[str], usual: frozenset[str], side: int) -> set[tuple]:
    """The keys of one title with what they meet on the other side; see ``Keys``."""
    maker = Keys(usual)
    return {(name, (place == side) if kinds[0] != kinds[1] else None, k) for name, kinds in KINDS.items() for place, kind in enumerate(kinds) for k in maker.of([tokens], kind)[1].tolist()}


def title_id(tokens: str) -> Column:
    """One number for a list of words, with room for two flags."""
    return F.xxhash64(tokens).bitwiseAND(F.lit(~3))


def near_titles(left: DataFrame, right: DataFrame, usual: frozenset[str]) -> DataFrame:
    """(a, b): different titles of ``left`` and ``right`` that share a key of ``Keys`` and ``may_be_one``; nothing is dropped by a count.

    Both tables have title (``title_id``) and tokens. Each title is taken once, however many rows bear it and on whichever
    side, and each kind of keys is searched by itself, so that the files of one search are gone before the next.
    """
    spark = left.sparkSession
    rows = left.select("title", F.array_join("tokens", " ").alias("text"), F.lit(1).alias("side")).union(right.select("title", F.array_join("tokens", " ").alias("text"), F.lit(2).alias("side")))
    every = rows.filter("text <> ''").groupBy("title", "text").agg(F.bit_or("side").cast("long").alias("side"))
    every = cut_lineage(every.select(F.col("title").bitwiseOR(F.col("side")).alias("ref"), "text"))
    del rows
    release(spark)

    def keyed(kind: str, ref: str, marks: np.ndarray | None = None) -> DataFrame:
        @F.pandas_udf(T.ArrayType(T.LongType()))
        def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            maker = keys_of(usual)
            for batch in batches:
                at, k = maker.of([x.split() for x in batch], kind, marks)
                k = k.view("int64")
                if marks is not None:
                    few = marks[k & (BITS - 1)]
                    at, k = at[few], k[few]
                own = np.empty(len(batch), object)
                own[:] = np.split(k, np.searchsorted(at, np.arange(1, len(batch)))) if len(batch) > 1 else [k]
                yield pd.Series(own)

        return every.select(F.col("ref").alias(ref), F.explode(keys("text")).alias("__k"))

    flag = lambda x, side: F.col(x).bitwiseAND(F.lit(side)) != 0
    out = None
    for one, two in KINDS.values():
        marks = marked(keyed(one, "x").select("__k")) if one != two else None
        if marks is not None and not marks.any():
            continue
        a = keyed(one, "x")
        b = a.withColumnRenamed("x", "y") if one == two else keyed(two, "y", marks)
        met = a.join(b.hint("merge"), "__k").filter((F.col("x") < F.col("y")) if one == two else (F.col("x") != F.col("y")))
        met = met.filter((flag("x", 1) & flag("y", 2)) | (flag("x", 2) & flag("y", 1)))
        pairs = cut_lineage(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        text = lambda ref, name: every.select(F.col("ref").alias(ref), F.split("text", " ").alias(name)).hint("merge")
        near = cut_lineage(pairs.join(text("x", "tx"), "x").join(text("y", "ty"), "y").filter(may_be_one("tx", "ty")).select("x", "y"))
        out = near if out is None else out.union(near)
        del a, b, met, pairs, near
        release(spark)
    out = out.distinct()
    found = cut_lineage(out.union(out.select("y", "x")).filter(flag("x", 1) & flag("y", 2)).select(F.col("x").bitwiseAND(F.lit(~3)).alias("a"), F.col("y").bitwiseAND(F.lit(~3)).alias("b")))
    del every, out
    release(spark)
    return found


def title_pairs(left: DataFrame, right: DataFrame, key: str, other: str, usual: frozenset[str], generic: DataFrame) -> DataFrame:
    """(key, other): the rows of equal and of near titles, each pair once; a pair of which a title is ``generic`` only if the rows name the same volume.

    Both tables have title, tokens and volumes, an array of numbers.
    """
    edges = near_titles(left, right, usual)
    g = lambda name: generic.select(F.col("title").alias(name), F.lit(True).alias(f"g{name}"))
    edges = edges.join(g("a"), "a", "left").join(g("b"), "b", "left").withColumn("generic", F.coalesce("ga", "gb").isNotNull()).select("a", "b", "generic")
    edges = cut_lineage(edges.union(generic.select(F.col("title").alias("a"), F.col("title").alias("b"), F.lit(True).alias("generic"))))
    l, r = left.select(key, F.col("title").alias("a")), right.select(other, F.col("title").alias("b"))
    equal = l.join(generic.select(F.col("title").alias("a")), "a", "left_anti").join(r.withColumnRenamed("b", "a").hint("merge"), "a")
    near = l.join(edges.filter("not generic").select("a", "b").hint("merge"), "a").join(r.hint("merge"), "b")
    special = edges.filter("generic").select("a", "b")
    within = lambda df, one, name: df.withColumnRenamed("title", name).join(special.select(name).distinct(), name, "left_semi").select(one, name, F.explode("volumes").alias("v"))
    same = within(left, key, "a").join(within(right, other, "b").hint("merge"), "v").join(special, ["a", "b"])
    return equal.select(key, other).union(near.select(key, other)).union(same.select(key, other).distinct())


@functools.lru_cache(1 << 15)
def _misspelt(word: str, mate: str, limit: int) -> bool:
    """Whether two words differ by at most ``limit`` typing errors."""
    letters = Counter(word)
    letters.subtract(mate)
    return sum(abs(n) for n in letters.values()) <= 2 * limit and edit_distance(word, mate) <= limit


@functools.lru_cache(1 << 16)
def _letters(word: str) -> int:
    """The set of a word's characters as bits; an error changes two at most."""
    return functools.reduce(lambda bits, c: bits | 1 << ord(c) % 64, word, 0)


def _like(word: str, mate: str) -> bool:
    """Whether two words differ by a few typing errors; what cannot be is told by lengths and sets of letters."""
    least = min(len(word), len(mate))
    limit = 0 if least < 4 else 1 if least < 5 else 2 if least < 12 else 3
    return limit > 0 and abs(len(word) - len(mate)) <= limit and (_letters(word) ^ _letters(mate)).bit_count() <= 2 * limit and _misspelt(word, mate, limit)


def likeness(a: list[str], b: list[str]) -> tuple[float, str]:
    """How much two titles say the same, and how they relate: same, prefix, or other."""
    rest_a, rest_b = list(a), []
    for word in b:
        if word in rest_a:
            rest_a.remove(word)
        else:
            rest_b.append(word)
    same = len(a) - len(rest_a)
    for word in list(rest_a):
        mate = next((m for m in rest_b if _like(word, m)), None)
        if mate is not None:
            rest_a.remove(word)
            rest_b.remove(mate)
            same += 1
    total = max(len(a) + len(b) - same, 1)
    score = same / total
    if not rest_a and not rest_b:
        return score, "same"
    short, long, rest = (a, b, rest_a) if len(a) <= len(b) else (b, a, rest_b)
    if len(short) >= 3 and sum(w != short[-1] for w in rest) <= 1:
        head = long[: len(short)]
        if len(short) > 3 and len(short[-1]) < 4 and not head[-1].startswith(short[-1]):  # the rest of a word that does not count
            short, head, rest = short[:-1], head[:-1], [w for w in rest if w != short[-1]]
        match = sum(x == y or (len(x) > 3 and edit_distance(x, y) <= 1) for x, y in zip(short[:-1], head[:-1]))
        last = head[-1].startswith(short[-1]) or edit_distance(short[-1], head[-1]) <= 1
        if match >= len(short) - 1 and last and len(rest) <= 1:
            return score, "prefix"
    return score, "other"


JUDGED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("relation", T.StringType())])


@F.pandas_udf(JUDGED)
def judge(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Likeness of two titles given as their content words with a space between."""
    return pd.DataFrame([likeness(x.split(), y.split()) for x, y in zip(a, b)], columns=JUDGED.names)


judge = judge.asNondeterministic()  # else Spark pushes filters on its result below it and compares each pair twice


def may_be_one(a: str, b: str):
    """Whether two lists of content words can be the same or one the beginning of the other in the sense of ``likeness``: false only where they cannot.

    The same: equally many, and each word of one that the other lacks has a word there that lengths and twice its typing
    errors allow, as a swap counts two letters replaced. A beginning: the words of the shorter one stand in the same places, but for
    the last, which may be cut, and the one before a last one so short that it may not count.
    """
    x, y = F.col(a), F.col(b)
    least = F.least(F.size(x), F.size(y))

    def like(u, v):
        short = F.least(F.length(u), F.length(v))
        limit = F.when(short < 5, 1).when(short < 12, 2).otherwise(3)
        return (short >= 4) & (F.abs(F.length(u) - F.length(v)) <= limit) & F.levenshtein(u, v, 6).between(0, 2 * limit)

    same = (F.size(x) == F.size(y)) & F.forall(F.array_except(x, y), lambda u: F.exists(y, lambda v: like(u, v)))
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    last, other = F.get(short, least - 1), F.get(long, least - 1)
    even = F.size(x) == F.size(y)  # either may be the shorter one
    rest = (least > 3) & ((F.length(last) < 4) | (even & (F.length(other) < 4)))  # the rest of a word that was cut may not count
    heads = F.zip_with(F.slice(x, 1, F.greatest(least - 1 - rest.cast("int"), F.lit(0))), F.slice(y, 1, F.greatest(least - 1 - rest.cast("int"), F.lit(0))), lambda u, v: (u == v) | (F.levenshtein(u, v, 2) >= 0))
    first = (F.get(x, F.lit(0)) == F.get(y, F.lit(0))) | (F.levenshtein(F.get(x, F.lit(0)), F.get(y, F.lit(0)), 2) >= 0)
    return same | ((least >= 3) & first & (rest | F.startswith(other, last) | (even & F.startswith(last, other)) | (F.levenshtein(last, other, 2) >= 0)) & F.forall(heads, lambda ok: ok))


def judged(pairs: DataFrame, a: str, b: str, least: float = 0.6) -> DataFrame:
    """The pairs that share ``least`` of the words of the shorter title, misspelt words counted, with their likeness in ``j``."""
    near = pairs.withColumn("j", judge(F.array_join(a, " "), F.array_join(b, " ")))
    exact = F.size(F.array_intersect(a, b)) >= least * F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    same = F.col("j.score") * (F.size(a) + F.size(b)) / (1 + F.col("j.score"))  # the score is the shared words over all words
    return near.filter(exact | (same >= least * F.least(F.size(a), F.size(b)) - 1e-9))


def doi_parts(doi: str):
    """(doi_key, doi_kind): the DOI in one form, and proper, volume, preprint or null where it identifies nothing."""
    low = F.lower(F.trim(F.col(doi)))
    key = F.nullif(F.regexp_extract(low, r"(10\.\d{4,9}/\S+)", 1), F.lit(""))
    kind = F.when(key.isNull(), None).when(key.rlike(r"\.proc\d*$|\.vol\d*$"), "volume").when(key.rlike(r"/pre\.|arxiv"), "preprint").otherwise("proper")
    return key, kind
