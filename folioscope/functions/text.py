"""Scalar functions on strings. All are built-in expressions; null handling is stated per function."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups of title words and their patterns.
KEYWORD_GROUPS = {
    "solving": (r"solv", r"grounding", r"abduction", r"enumerat"),
    "learning": (r"learn", r"sampling", r"revision"),
    "planning": (r"planning", r"scheduling", r"timetabl", r"rostering"),
    "logic": (r"logic programs?", r"answer set", r"stable models?", r"datalog"),
    "data": (r"data cleaning", r"monitoring", r"archive"),
}
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "are", "via", "under", "using", "given", "towards", "case")


def _s(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean_token(c: Column | str) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends; "" for null."""
    return F.trim(F.regexp_replace(F.lower(_s(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def normalize_words(c: Column | str) -> Column:
    """Lower case words of ASCII letters and digits, one space between; "" for null."""
    return F.trim(F.regexp_replace(F.lower(_s(c)), "[^a-z0-9]+", " "))


def clean_text(c: Column | str) -> Column:
    """``normalize_words`` without URLs."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_s(c)), r"https?://\S+", " "), "[^a-z0-9]+", " "))


def unescape_title(c: Column | str) -> Column:
    """Lower case, two entities unescaped, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.replace(F.lower(_s(c)), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def search_title(c: Column | str) -> Column:
    """``unescape_title`` reduced to letters, digits, hyphens and spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescape_title(c), r"[^a-z0-9\- ]", " "), r"\s+", " "))


def squeeze(c: Column | str) -> Column:
    """White space collapsed and off the ends; "" for null."""
    return F.trim(F.regexp_replace(_s(c), r"\s+", " "))


def strip_tags(c: Column | str) -> Column:
    """Tags as spaces, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_s(c), "<[^>]+>", " "), r"\s+", " "))


def query_safe(c: Column | str) -> Column:
    """Everything but ASCII letters, digits and spaces as a space each."""
    return F.regexp_replace(_s(c), "[^a-zA-Z0-9 ]", " ")


def normalize_doi(c: Column | str) -> Column:
    """The bare DOI in lower case; "" for anything that is none."""
    low = F.lower(F.trim(_s(c)))
    bare = F.regexp_replace(low, r"^(?:https?://(?:dx\.)?doi\.[a-z]+/|doi:\s*)", "")
    return F.when(F.startswith(bare, F.lit("10.")), bare).otherwise(F.lit(""))


def last_segment(c: Column | str) -> Column:
    """The last path segment of a URL; "" for null."""
    return F.element_at(F.split(F.rtrim(_s(c), F.lit("/")), "/"), -1)


def page_id(c: Column | str) -> Column:
    """The 40 hexadecimal digits of a catalogue page, lower case; "" where there are none."""
    return F.lower(F.regexp_extract(_s(c), "/paper/([0-9a-fA-F]{40})", 1))


def doi_kind(c: Column | str) -> Column:
    """missing, catalogue, formal, other_url or other."""
    low = F.lower(F.trim(_s(c)))
    return (
        F.when(low.isin("", "n/a", "none", "nan"), "missing").when(F.contains(low, F.lit("/paper/")), "catalogue").when(low.rlike(r"(^|/|:)\s*10\.\d+/"), "formal").when(F.startswith(low, F.lit("http")), "other_url").otherwise("other")
    )


def first_author_token(c: Column | str) -> Column:
    """The last ASCII word of the part before the first comma, lower case; "none" where there is none."""
    words = F.regexp_extract_all(F.lower(F.element_at(F.split(_s(c), ","), 1)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.element_at(words, F.size(words))).otherwise(F.lit("none"))


def first_author_surname(c: Column | str) -> Column:
    """As ``first_author_token``, with Latin letters beyond ASCII, apostrophes and hyphens kept."""
    words = F.regexp_extract_all(F.element_at(F.split(_s(c), ","), 1), F.lit("[A-Za-zÀ-ÖØ-öø-ÿĀ-ſ'’-]+"), F.lit(0))
    return F.lower(F.when(F.size(words) > 0, F.element_at(words, F.size(words))).otherwise(F.lit("none")))


def prefixed(c: Column | str, prefix: str, missing: str = "missing") -> Column:
    """"prefix_token", with ``missing`` in the place of an empty token."""
    return F.concat(F.lit(f"{prefix}_"), F.coalesce(F.nullif(clean_token(c), F.lit("")), F.lit(missing)))


def text_variant(name: str) -> Column:
    """Named model inputs made of title, venue, year and authors."""
    title, venue, year, author = clean_text("title"), prefixed("venue", "venue"), prefixed(F.col("year").cast("string"), "year"), prefixed(first_author_token("authors"), "author")
    parts = {
        "title": [title],
        "title_venue": [title, venue],
        "title_year": [title, year],
        "title_author": [title, author],
        "title_venue_year": [title, venue, year],
        "title_twice_venue": [title, title, venue],
        "all": [title, venue, year, author],
    }[name]
    return F.concat_ws(" ", *parts)


def document_template(title: str, venue: str, year: str, body: str, limit: int = 1800) -> Column:
    """Labelled lines of a paper, cut to ``limit`` characters, as a model's input."""
    return F.substring(F.concat(F.lit("Title: "), squeeze(title), F.lit(" Venue: "), squeeze(venue), F.lit(" Year: "), F.coalesce(F.col(year).cast("string"), F.lit("")), F.lit(" Abstract: "), squeeze(body)), 1, limit)


def encoder_input(title: str, body: str, sep: str = "[SEP]") -> Column:
    """Title and body with a separator, the title alone where the body is empty."""
    return F.when(squeeze(body) == "", squeeze(title)).otherwise(F.concat(squeeze(title), F.lit(f" {sep} "), squeeze(body)))


def word_count(c: Column | str) -> Column:
    """Number of words; 0 for null and blank text."""
    t = squeeze(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def part_count(c: Column | str, sep: str = ",") -> Column:
    """Number of parts that are not blank."""
    return F.size(F.filter(F.split(_s(c), sep), lambda x: F.trim(x) != ""))


def first_pipe_value(c: Column | str, default: str = "none") -> Column:
    """The first value of "a|b", lower case."""
    return F.coalesce(F.nullif(F.lower(F.trim(F.element_at(F.split(_s(c), r"\|"), 1))), F.lit("")), F.lit(default))


def contains_any(c: Column | str, terms: Iterable[str]) -> Column:
    """1 if one of the terms is part of the lower-case text, else 0."""
    low = F.lower(_s(c))
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(low, F.lit(term))
    return out.cast("int")


def pattern_flag(c: Column | str, patterns: Iterable[str]) -> Column:
    """1 if one of the patterns matches, whatever the case, else 0."""
    return _s(c).rlike("(?i)" + "|".join(patterns)).cast("int")


def tokens(c: Column | str, least: int = 3) -> Column:
    """Lower-case words of at least ``least`` letters without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(_s(c)), "[^a-z]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS))


def slug(c: Column | str) -> Column:
    """Slashes and spaces as underscores."""
    return F.translate(_s(c), "/\\ ", "___")


def parsed_digit(c: Column | str) -> Column:
    """The first digit from 1 to 5 in the text, or null."""
    return F.try_element_at(F.transform(F.regexp_extract_all(_s(c), F.lit("[1-5]"), F.lit(0)), lambda x: x.cast("int")), F.lit(1))
