"""One consistent form for text that looks the same but is made of other characters.

A transducer compiled from the Unicode character database and a table of look-alike letters rewrites each text in
one pass over its grapheme clusters, longest match first: full-width, stylised and other compatibility forms, spaces
other than the plain one, invisible characters, accents kept apart from their letter, and letters of another script
inside Latin words. Composed letters, typographic dashes and quotes, the ellipsis, line breaks, tabs, Greek letters
used as symbols and names wholly in their own script stay as they are.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter, and that letter.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "г": "r",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p", "α": "a", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "χ": "x", "γ": "y", "η": "n", "ω": "w", "ϲ": "c", "ϳ": "j",
}
# Compatibility characters that stay, for they are ordinary typography.
KEPT = "…‥™©®ªº°µ¨´¸¯˘˙˚˛˜˝´῾·¼½¾"
_TAGS = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<circle>", "<super>", "<sub>", "<small>", "<square>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>")
_WORD = r"[\p{L}\p{M}\p{Cf}\p{Nl}'’]+"


@functools.cache
def mapping() -> dict[str, str]:
    """Cluster to replacement, computed from the character database; conflicts raise."""
    table: dict[str, str] = {}

    def put(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise ValueError(f"conflicting rules for {source!r}")

    for code in range(128, sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf":
            put(char, "")
        elif kind == "Zs":
            put(char, " ")
        elif kind not in ("Cn", "Cs", "Co") and char not in KEPT:
            parts = unicodedata.decomposition(char)
            if parts.startswith(_TAGS):
                plain = unicodedata.normalize("NFKC", char).replace("‐", "-")
                if plain != char and not plain.startswith(" "):
                    put(char, plain)
            elif parts and not parts.startswith("<"):
                apart = unicodedata.normalize("NFD", char)
                if len(apart) > 1 and unicodedata.normalize("NFC", apart) == char:
                    put(apart, char)
    stale = [s for s, t in table.items() if any(c in table for c in t)]
    if stale:  # every replacement has to be a fixed point
        for s in stale:
            table[s] = "".join(table.get(c, c) for c in table[s])
    if any(c in table for t in table.values() for c in t):
        raise ValueError("a replacement is itself replaced")
    return table


class Transducer:
    """The compiled mapping. ``apply`` rewrites one text."""

    def __init__(self) -> None:
        self.table = mapping()
        self.single = {ord(s): t for s, t in self.table.items() if len(s) == 1}
        lone = "".join(regex.escape(s) for s in self.table if len(s) == 1)
        self.scan = regex.compile(rf"(?P<word>{_WORD})|[{lone}]\p{{M}}*|\X\p{{M}}+")
        self.cluster = regex.compile(r"\X")
        self.other = regex.compile(r"[\p{Cyrillic}\p{Greek}]")
        self.latin = regex.compile(r"\p{Latin}")
        self.mark = regex.compile(r"\p{M}")
        self.delimiter = regex.compile(r"[,;|/&\n\t]")

    def clusters(self, text: str) -> str:
        """Every cluster by its longest prefix in the table; what is left of it follows in the same way."""
        out = []
        for unit in self.cluster.findall(text):
            while unit:
                for size in range(len(unit), 0, -1):
                    if unit[:size] in self.table:
                        out.append(self.table[unit[:size]])
                        break
                else:
                    size = 1
                    out.append(unit[0])
                unit = unit[size:]
        return self.composed("".join(out))

    def composed(self, text: str) -> str:
        """The text with accents joined to their letters."""
        return unicodedata.normalize("NFC", text) if not text.isascii() and self.mark.search(text) else text

    def latinised(self, unit: str) -> str:
        """The unit with look-alike letters as Latin ones; an accent that a look-alike could not take joins the Latin letter."""
        return self.composed("".join(LOOKALIKES.get(c, c) for c in unit))

    def kind(self, unit: str) -> str:
        """What a word is: latin, own (a script of its own), symbol, open (all look-alikes), or none of these (no letters)."""
        if self.latin.search(unit):
            return "latin"
        letters = [c for c in unit if c.isalpha()]
        if not letters:
            return "none"
        if not all(c in LOOKALIKES for c in letters):
            return "own"
        return "symbol" if len(letters) == 1 and letters[0].islower() else "open"

    def apply(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        if not self.mark.search(text):  # every cluster is one character
            done = text.translate(self.single)
            if not self.other.search(done):
                return done
        out: list[str] = []
        words: list[list] = []  # place in out, kind, whether a delimiter stands before it
        at, cut = 0, True
        for m in self.scan.finditer(text):
            between, unit = text[at : m.start()], m.group()
            at = m.end()
            new = unit if unit.isascii() else self.clusters(unit)
            out += [between, new]
            cut = cut or bool(self.delimiter.search(between))
            kind = self.kind(new)
            if kind == "none":
                cut = cut or bool(self.delimiter.search(new))
                continue
            if kind == "latin" and self.other.search(new):
                out[-1] = self.latinised(new)
            words.append([len(out) - 1, kind, cut])
            cut = False
        out.append(text[at:])
        # a word of look-alikes is Latin where a word beside it is, and none beside it stands in its own script; what has become Latin counts
        for turn in (1, -1):
            for i in range(len(words))[::turn]:
                place, kind, first = words[i]
                if kind != "open":
                    continue
                left = words[i - 1][1] if i and not first else ""
                right = words[i + 1][1] if i + 1 < len(words) and not words[i + 1][2] else ""
                if "own" not in (left, right) and "latin" in (left, right):
                    out[place], words[i][1] = self.latinised(out[place]), "latin"
        return "".join(out)


@functools.cache
def transducer() -> Transducer:
    """The transducer of this process."""
    return Transducer()


@F.pandas_udf(T.StringType())
def _consistent(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    rewrite = transducer().apply
    for batch in texts:
        yield batch.map(rewrite, na_action="ignore")


def consistent_form(column: Column | str) -> Column:
    """The text in its consistent form. Null stays null, ASCII text is never sent to Python; texts of any length are rewritten whole."""
    col = F.col(column) if isinstance(column, str) else column
    return F.when(col.rlike(r"[^\x00-\x7F]"), _consistent(F.when(col.rlike(r"[^\x00-\x7F]"), col))).otherwise(col)


def disguised_cells(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, field, original, consistent): the cells that hold a character standing in for a usual one.

    Null and empty cells are no cases; repeated rows give repeated results; an empty table gives an empty result;
    other columns of ``df`` are dropped first, so their names cannot clash.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    long = df.select(F.col(key).alias("__key"), cells.alias("__cell")).select("__key", "__cell.field", F.col("__cell.text").alias("original"))
    wide = long.filter(F.col("original").rlike(r"[^\x00-\x7F]")).withColumn("consistent", _consistent("original"))
    return wide.filter(F.col("original") != F.col("consistent")).withColumnRenamed("__key", key)
