"""The best value of each field of a duplicate group.

Fields are unpivoted to long rows; each row votes for its normalised value with the trust in its source times a decay
with age; votes are summed per value before anything is gathered per record; winners come from max_by, and are
pivoted back. Only the normal form of a value is made in Python, once per row; all else is partial aggregates.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.textform import transducer

# Texts that stand where a value is missing.
PLACEHOLDERS = ("", "-", "n/a", "na", "none", "null", "nan", "tba", "tbd", "abstract", "no abstract", "no abstract available", "this article has no abstract", "see title", "see pdf", "tl;dr", "tldr", "tldr not generated", "not available", "not generated")
# Words of titles that say nothing about a subject.
PLAIN_WORDS = ("with", "from", "towards", "what", "wrong", "case", "that", "this", "their", "some", "into", "upon", "over", "part", "report", "short", "paper", "version", "extended", "abstract")
_TAG = regex.compile(r"<[^<>]{1,40}>")
_PREFIX = regex.compile(r"(?:abstract|summary|tl;?dr)\s*[:.—–-]*\s+", regex.I)
_NOTICES = ("published online", "received", "accepted", "keywords", "key words", "©", "(c)", "copyright", "reserved", "use only")
_SUFFIX = regex.compile(r"(?:\s*(?:(?:published online|received in|received|accepted|keywords|key words)\b[^.]*\.|(?:©|\(c\)|copyright)[^.]*\.|all rights reserved\.|personal use only\.))+\s*$", regex.I)
_FAILED = regex.compile(r"error \d+|https? error|\[abstract removed|\[?(?:abstract|content) (?:not available|withheld|removed)|(?:see title\s*)+$", regex.I)
_SENTENCE = regex.compile(r"(?<=[.?!])\s+")
_LONG = regex.compile(r"[a-z]{4,}")
DECAY_DAYS = 180.0
TRUSTED = 0.8  # a match score from which a record is of the paper it names
ABOUT = 0.4  # share of the title's words that shows the same where the score is missing


def undressed(text: str) -> str:
    """The value itself: tags, labels before it and notices after it off, white space collapsed."""
    if not text.isascii():
        text = transducer().apply(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = " ".join(text.split())
    text = text[m.end() :] if (m := _PREFIX.match(text)) else text
    low = text.lower()
    if any(n in low for n in _NOTICES):
        text = _SUFFIX.sub("", text)
    return text.strip()


def about(title: str, text: str) -> float | None:
    """The largest share of the title's words that two neighbouring sentences of the text hold; none for a title without words."""
    wanted = set(_LONG.findall((title if title.isascii() else transducer().apply(title)).lower())) - set(PLAIN_WORDS)
    if not wanted:
        return None
    held = [wanted & set(_LONG.findall(s.lower())) for s in _SENTENCE.split(text)]
    return max(len(a | b) for a, b in zip(held, [*held[1:], set()])) / len(wanted)


def usable_key(value: str, title: str | None, score: float | None) -> str | None:
    """The normalised value if it is a real text, complete and of the paper that the title names; else none."""
    plain = undressed(value)
    key = plain.lower()
    if key.rstrip(" .:…") in PLACEHOLDERS or _FAILED.match(key) or " " not in key:
        return None
    if key[-1] not in ".?!。)\"'”’" or key.endswith(("...", ". . .", "…", ". ..")):
        return None
    stem = key.rstrip(".?!。 ")
    if score is None or score != score:
        share = about(title or "", plain)
        return stem if share is not None and share >= ABOUT else None
    return stem if score >= TRUSTED else None


@F.pandas_udf(T.StringType())
def _keys(value: pd.Series, title: pd.Series, score: pd.Series) -> pd.Series:
    return pd.Series([usable_key(v, t, s) for v, t, s in zip(value, title, score)], dtype=object)


def trust(score: Column) -> Column:
    """A match score on the scale of 0 to 1, whichever scale it came on; null for null and NaN."""
    known = F.nullif(F.nanvl(score, F.lit(-1.0)), F.lit(-1.0))
    return F.when(known > 1.0, known / 100.0).otherwise(known)


def survivors(records: DataFrame) -> DataFrame:
    """(source_split, id, field, rec_id, value, votes, records): the surviving value of each group that has a usable one.

    ``records`` is long: source_split, id, field, rec_id, title, value, score, failed, fetched_at. A value is usable if
    it is a real text, of its paper, and complete: no placeholder, ends a sentence, is no beginning of another value
    of the group, and matches by score, or by the words of the title where the score is missing. Of records that hold
    the winning value the latest wins, then the smallest rec_id. Nulls, empty texts and failed records never win;
    repeated records vote again but cannot make a tie; an empty table gives an empty result; other columns are not
    read. Values of any length are compared whole.
    """
    group = ["source_split", "id", "field"]
    size = records.groupBy(*group).agg(F.count("*").alias("records"))
    rows = records.filter("value is not null and not coalesce(failed, false)").withColumn("t", trust(F.col("score")))
    rows = rows.withColumn("key", _keys("value", "title", "t")).filter("key is not null")
    vote = F.coalesce("t", F.lit(0.5)) * F.exp((F.unix_timestamp("fetched_at") - F.lit(1704067200)) / F.lit(86400 * DECAY_DAYS))
    order = F.struct(F.col("fetched_at").alias("at"), (-F.col("rec_id")).alias("first"))
    rows = rows.select(*group, "rec_id", "value", "key", F.coalesce(vote, F.lit(0.0)).alias("vote"), order.alias("order"))
    values = rows.groupBy(*group, "key").agg(F.sum("vote").alias("votes"), F.max_by("rec_id", "order").alias("rec_id"), F.max_by("value", "order").alias("value"), F.max("order").alias("order"))
    following = F.lead("key").over(Window.partitionBy(*group).orderBy("key"))  # keys have no closing stop, so what goes on stands next
    whole = values.withColumn("next", following).filter(F.col("next").isNull() | ~F.startswith(F.col("next"), F.col("key")))
    best = F.struct("votes", "order")
    won = whole.groupBy(*group).agg(F.max_by("rec_id", best).alias("rec_id"), F.max_by("value", best).alias("value"), F.max("votes").alias("votes"))
    return won.join(size, group)


def unpivoted(abstracts: DataFrame, matches: DataFrame) -> DataFrame:
    """The two crawl tables as long rows."""
    a = abstracts.select("source_split", "id", F.lit("abstract").alias("field"), "rec_id", "title", F.col("abstract").alias("value"), F.col("oat_match_score").alias("score"), F.lit(False).alias("failed"), "fetched_at")
    m = matches.select("source_split", "id", F.lit("tldr").alias("field"), "rec_id", F.col("source_title").alias("title"), F.col("tldr").alias("value"), F.col("match_score").alias("score"), (~F.coalesce("found", F.lit(True)) | F.col("error").isNotNull()).alias("failed"), "fetched_at")
    return a.unionByName(m)


def merged_papers(abstracts: DataFrame, matches: DataFrame) -> DataFrame:
    """(source_split, id, abstract, abstract_rec_id, tldr, tldr_rec_id): one row per paper that has a surviving value."""
    long = survivors(unpivoted(abstracts, matches))
    pick = lambda field, column: F.max(F.when(F.col("field") == field, F.col(column)))
    return long.groupBy("source_split", "id").agg(pick("abstract", "value").alias("abstract"), pick("abstract", "rec_id").alias("abstract_rec_id"), pick("tldr", "value").alias("tldr"), pick("tldr", "rec_id").alias("tldr_rec_id"))
