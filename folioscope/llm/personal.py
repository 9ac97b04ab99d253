"""Personal information in free text: found with its exact span, and replaced by placeholders or keyed surrogates.

Detection is a set of typed patterns, helped by word lists that are counted over the whole corpus: given names, towns
and common words. Each distinct entity receives a surrogate drawn by a keyed hash, of the same type, script, letter
case and format; entities that would share a surrogate are told apart by a check over all entities, so that different
people stay different and one person stays one person everywhere.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.names import NICKNAMES, PARTICLES, SUFFIXES, fold, parse_name
from folioscope.session import cut_lineage

_CAP = r"\p{Lu}[\p{L}\p{M}'’]+(?:-\p{Lu}[\p{L}\p{M}'’]+)*"
_PART = r"(?:(?i:de la|van der|von der|van|von|de|di|du|del|der)\s)*"
_N = r"\d{1,4}[a-z]?"
# Words that make a street, in the order of number and name of each language.
_EN = r"(?i:street|road|lane|terrace|avenue|court|drive|way|square|place|close|row|crescent|gardens?)"
_FR = r"(?i:rue|avenue|place|chemin|boulevard|quai|impasse|allée|route|cours|passage|square)"
_ES = r"(?i:calle|avenida|camino|plaza|paseo|carrera|ronda|travesía|cuesta|callejón|glorieta)"
_DE = r"(?:\p{Lu}[\p{L}-]*(?:straße|strasse|STRASSE|STRAßE|weg|WEG|allee|ALLEE|platz|PLATZ|gasse|GASSE|ufer|UFER|ring|RING|damm|DAMM|markt|MARKT|hof|HOF|steig|STEIG|graben|GRABEN|chaussee)|(?:\p{Lu}[\p{L}-]+ ){1,3}(?i:straße|strasse|weg|allee|platz|gasse|ufer|ring|damm))"
_AT = r"(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Vor dem)\s(?:\p{Lu}[\p{L}-]+\s?){1,3}"
_BOX = r"(?i:p\.?\s?o\.?\s?box|postfach|boîte postale|b\.?p\.?|apartado(?: de correos)?)\s\d{1,6}"
_FLAT = r"(?i:flat|apt\.?|apartment|unit|suite)\s\d{1,4}[a-z]?"
_STREETS = (
    rf"(?:(?:{_FLAT},\s)?{_N}\s(?:\p{{Lu}}[\p{{L}}'’-]+\s){{1,3}}{_EN}(?:,\s{_FLAT})?|{_BOX}),\s(?P<tail>{_CAP}(?:\s{_CAP}){{0,2}})(?P<code>\s\d{{5}}\b)?",
    rf"(?:{_DE}\s{_N}|{_AT}\s?{_N}|{_BOX}),\s(?P<head>\d{{5}})\s(?P<tail>{_CAP}(?:\s{_CAP}){{0,2}})",
    rf"(?:{_N},?\s{_FR}\s(?:[\p{{L}}'’-]+\s?){{1,5}}|{_BOX}),\s(?P<head>\d{{5}})\s(?P<tail>{_CAP}(?:\s{_CAP}){{0,2}})",
    rf"(?:{_ES}\s(?:[\p{{L}}'’-]+\s){{1,5}}{_N}|{_BOX}),\s(?P<head>\d{{5}})\s(?P<tail>{_CAP}(?:\s{_CAP}){{0,2}})",
)
_LABEL = r"[\p{L}\d](?:[\p{L}\d-]*[\p{L}\d])?"
_LOCAL = r"(?<![\p{L}\d._+-])[\p{L}\d][\p{L}\d._+-]*+"
_DOT = r"(?:\.|\s?[\[({](?i:dot|punkt|point|punto)[\])}]\s?|\s(?i:dot)\s)"
_MAILS = (
    rf"{_LOCAL}[@＠]{_LABEL}(?:\.{_LABEL})*\.\p{{L}}{{2,}}(?![\p{{L}}\d])",
    rf"{_LOCAL}\s?[\[({{](?i:at|@|arroba|ät)[\])}}]\s?{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,}}(?![\p{{L}}\d])",
    rf"{_LOCAL}\s(?i:at)\s{_LABEL}(?:(?:\.|\s(?i:dot)\s){_LABEL})*?(?:\s(?i:dot)\s{_LABEL})+(?![\p{{L}}\d])",
)
_B, _E = r"(?<![\p{L}\d.,/+-]|\d[ (])", r"(?![\p{L}\d/-]|[.,]\d)"
_PHONES = (
    r"(?<![\p{L}\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]\d{2,5}){1,5}(?![\p{L}\d/-])",
    r"(?<![\p{L}\d.+/-])00\d{1,3}[ -]\d{1,4}[ -]\d{4,9}(?![\p{L}\d/-])",
    rf"{_B}0\d{{1,4}}/\d{{3,6}}(?:-\d{{1,4}})?{_E}",
    rf"{_B}0\d{{2,3}} \d{{4}} \d{{4}}{_E}",
    rf"{_B}0\d(?:[. ]\d{{2}}){{4}}{_E}",
    r"(?<![\p{L}\d.+/-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\p{L}\d/-])",
    rf"{_B}[2-9]\d{{2}}[-.][2-9]\d{{2}}[-.]\d{{4}}{_E}",
)
# Labels of identity numbers.
_IDS = (
    r"(?i:\b(?:ssn|social\ssecurity(?:\s(?:number|no\.?))?|passport(?:\s(?:number|no\.?))?|identity\scard|id\scard|national\s(?:id|identity(?:\snumber)?)|tax\s(?:id|number|no\.?)|driver'?s?\slicen[cs]e|driving\slicen[cs]e"
    r"|personal\s(?:code|number)|licen[cs]e\s(?:number|no\.?)|steuer-?(?:id|nummer)|ausweis(?:nummer)?|reisepass(?:nummer)?|sozialversicherungsnummer|führerschein(?:nummer)?|passeport|carte\sd['’]identité|permis(?:\sde\sconduire)?"
    r"|numéro\s(?:fiscal|de\ssécurité\ssociale)|pasaporte|dni|nie|nif|carnet\sde\sconducir|número\s(?:fiscal|de\sidentidad)))"
    r"(?:\s(?i:is|no\.?|number|nr\.?|n°|#))?\s?:?\s*"
    r"(?P<value>[A-Z]{0,3}[\s-]?\d[\dA-Z]*(?:[ .-](?=[\dA-Z]*\d)[\dA-Z]{1,8})*(?:-[A-Z]\b)?)(?![\p{L}\d-])",
)

ENTITY = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class Detector:
    """The patterns with their word lists."""

    def __init__(self, given: frozenset[str], towns: frozenset[str], common: frozenset[str], frequent: frozenset[str]) -> None:
        self.given = given | {fold(n) for n in NICKNAMES}
        self.towns, self.common, self.frequent = towns, common, frequent
        self.memo: dict[str, bool] = {}
        self.streets = [regex.compile(p) for p in _STREETS]
        self.mails = [regex.compile(p) for p in _MAILS]
        self.phones = [regex.compile(p) for p in _PHONES]
        self.ids = [regex.compile(p) for p in _IDS]
        self.full = regex.compile(rf"(?<![\p{{L}}\d.@_'’-])(?P<given>{_CAP})(?P<mid>(?:\s\p{{Lu}}\.){{0,2}})\s(?P<part>{_PART})(?P<family>{_CAP})(?![\p{{L}}\d@_])")
        self.short = regex.compile(rf"(?<![\p{{L}}\d.@_'’-])(?P<init>\p{{Lu}}\.(?:\s?\p{{Lu}}\.)?)\s(?P<part>{_PART})(?P<family>{_CAP})(?![\p{{L}}\d@_])")
        self.small = regex.compile(r"(?<![\p{L}\d.@_'’-])(?P<given>\p{Ll}{3,})(?:\s\p{Ll}\.)?\s(?P<part>(?:(?:de la|van der|von der|van|von|de|di|du|del|der)\s)*)(?P<family>\p{Ll}[\p{Ll}'’-]{3,})(?![\p{L}\d@_.+-]*@|[\p{L}\d_])")
        self.turned = regex.compile(rf"(?<![\p{{L}}\d.@_'’-])(?P<part>{_PART})(?P<family>{_CAP}),\s(?:(?P<given>{_CAP})(?P<mid>(?:\s\p{{Lu}}\.){{0,2}})(?![\p{{L}}\d@_])|(?P<init>\p{{Lu}}\.(?:\s?\p{{Lu}}\.)?)(?![\p{{L}}\d@_]))")

    @staticmethod
    def low(word: str) -> str:
        return word.lower().replace("’", "'")

    def family(self, word: str, strict: bool) -> bool:
        low = self.low(word)
        if len(low) < 3 or low in self.common or low in PARTICLES or low in self.towns:
            return False
        return not (strict and low in self.frequent)

    def town(self, text: str) -> int:
        """How much of the capitalised words is the town."""
        words = text.split(" ")
        for n in range(len(words), 0, -1):
            if self.low(" ".join(words[:n])) in self.towns:
                return len(" ".join(words[:n]))
        if "\n" in text:
            return len(text.split("\n")[0].rstrip("\r"))
        n = 1
        while n < len(words) and self.low(words[n]) not in self.common and self.low(words[n]) not in self.frequent and fold(words[n]) not in self.given:
            n += 1
        return len(" ".join(words[:n]))

    def usual(self, word: str) -> bool:
        """Whether the word is a usual given name, in whatever letter case and with whatever accents."""
        known = self.memo.get(word)
        if known is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[word] = fold(word) in self.given
        return known

    def find(self, text: str | None, signs: bool = True) -> list[tuple[str, str, int, int]]:
        """(kind, value, start, end) of each entity, in order; earlier kinds win where spans overlap.

        Cheap signs say where a pattern can match at all; the patterns then run there and nowhere else. Without
        ``signs`` they run everywhere, with the same result.
        """
        if not text:
            return []
        taken: list[tuple[str, int, int]] = []

        def add(kind: str, start: int, end: int) -> None:
            if end > start and all(end <= s or start >= e for _, s, e in taken):
                taken.append((kind, start, end))

        low = text.lower()
        mails = ("@" in text or "＠" in text, any(x in low for x in _AT_SIGNS), _DOT_SIGN.search(low))
        for on, pattern in zip(mails, self.mails):
            if on or not signs:
                for m in pattern.finditer(text):
                    add("email", m.start(), m.end())
        whole = [(0, len(text))]
        spots = [(at, at) for at in _commas(low)] if signs and len(low) == len(text) else whole
        for lo, hi in _windows(spots, 240, 160, len(text)):
            for pattern in self.streets:
                for m in pattern.finditer(text, lo, hi):
                    end = m.end() if m.groupdict().get("code") else m.start("tail") + self.town(m.group("tail"))
                    add("address", m.start(), end)
        if not signs or any(x in low for x in _ID_SIGNS):
            for pattern in self.ids:
                for m in pattern.finditer(text):
                    if sum(c.isdigit() for c in m.group("value")) >= 5:
                        add("id_number", m.start("value"), m.end("value"))
        runs = [m.span() for m in _DIGITS.finditer(text)] if signs else whole
        for lo, hi in _windows(runs, 6, 40, len(text)):
            for pattern in self.phones:
                for m in pattern.finditer(text, lo, hi):
                    if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                        add("phone", m.start(), m.end())
        words = _WORDS.finditer(text, overlapped=True) if _NOT_LATIN.search(text) else _LATIN_WORDS.finditer(text)
        hits = [m.start() for m in words if self.usual(m[0])] if signs else range(len(text))
        initials = [m.start() for m in _INITIAL.finditer(text)] if signs else range(len(text))
        for at in hits:
            if (m := self.full.match(text, at)) and self.usual(m.group("given")) and self.family(m.group("family"), False) and not self.usual(m.group("family")):
                add("name", m.start(), m.end())
        for c in _TURN.finditer(text):
            comma, given = c.start(), c.group("given")
            if signs and given and not any(self.usual("-".join(given.split("-")[:n])) for n in range(1, given.count("-") + 2)) and not c.group("init"):
                continue
            for m in self.turned.finditer(text, max(0, comma - 60), min(len(text), comma + 62), overlapped=True):
                start = m.start("part") if m.group("part") else m.start("family")
                if m.end("family") == comma and self.family(m.group("family"), True) and not self.usual(m.group("family")) and (m.group("init") or self.usual(m.group("given"))):
                    add("name", start, m.end())
                    break
        for at in hits:
            if text[at].islower() and (m := self.small.match(text, at)) and self.usual(m.group("given")) and self.family(m.group("family"), True):
                add("name", m.start(), m.end())
        for at in initials:
            if (m := self.short.match(text, at)) and self.family(m.group("family"), True):
                add("name", m.start(), m.end())
        return [(kind, text[s:e], s, e) for kind, s, e in sorted(taken, key=lambda x: x[1])]


# Signs of a pattern, cheap to look for.
_AT_SIGNS = tuple(o + a for o in "[({" for a in ("at", "@", "arroba", "ät"))
_STREET_ENDS = ("street", "road", "lane", "terrace", "avenue", "court", "drive", "way", "square", "place", "close", "row", "crescent", "garden", "gardens")
_ID_SIGNS = ("ssn", "social", "passport", "passeport", "pasaporte", "card", "carte", "carnet", "national", "tax", "licence", "license", "personal", "steuer", "ausweis", "reisepass", "versicherung", "führerschein", "permis", "numéro", "número", "dni", "nie", "nif")
_DIGITS = re.compile(r"[+(]?\d[\d .()/+-]{6,}\d")
_DOT_SIGN = re.compile(r"\sdot\s")
_WORDS = regex.compile(r"(?<![\p{L}\d.@_'’-])\p{L}[\p{L}\p{M}'’-]*")
# The same for texts of Latin characters without marks apart from their letters, where the letters can be named by ranges.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-\u02c1"
_NOT_LATIN = re.compile("[^\0-\xb1\xb4-\xb8\xba\xbb\xbf-\u02c1\u2010-\u2027]")
_LATIN_WORDS = re.compile(rf"(?<![{_LATIN}\d.@_'’-])[{_LATIN}][{_LATIN}'’-]*+")
_INITIAL = regex.compile(r"\p{Lu}\.")
_TURN = regex.compile(rf",\s(?:(?P<init>\p{{Lu}}\.)|(?P<given>{_CAP}))")


def _commas(low: str) -> list[int]:
    """Commas after a street or a number, or before a postal code."""
    out, at = [], low.find(",")
    while at >= 0:
        last = low[at - 1 : at]
        if low[at + 1 : at + 2].isspace() and (last.isdigit() or (low[at - 2 : at - 1].isdigit() and last.isalpha()) or low[at + 2 : at + 7].isdigit() or low.endswith(_STREET_ENDS, max(0, at - 12), at)):
            out.append(at)
        at = low.find(",", at + 1)
    return out


def _windows(spots: list[tuple[int, int]], before: int, after: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches of text around the spots (start, end), joined where they overlap."""
    lo = hi = -1
    for start, end in spots:
        a, b = max(0, start - before), min(size, end + after)
        if a <= hi:
            hi = max(hi, b)
        else:
            if hi >= 0:
                yield lo, hi
            lo, hi = a, b
    if hi >= 0:
        yield lo, hi


# Mail addresses, plain and disguised, and given names or initials beside a family name, in the syntax of the JVM. A mail
# address begins where a run of its characters begins or the last match ended; a run is never tried in part.
_RUN = r"\p{L}\d._+-"
_MASKED = rf"(?:\G|(?<![{_RUN}]))[{_RUN}]++(?:[@＠]|\s?[\[({{](?i:at|@|arroba|ät)[\])}}]\s?|\s(?i:at)\s(?=\S+\s(?i:dot)\s))[\p{{L}}\d-]+(?:(?:\.|\s?[\[({{](?i:dot|punkt|point|punto)[\])}}]\s?|\s(?i:dot)\s)[\p{{L}}\d-]+)*"
_MAIL_SIGN = r"[\[({](?i:at|arroba|ät)[\])}]|\s(?i:at)\s\S+\s(?i:dot)\s"
_BEFORE = r"(?:\p{Lu}[\p{L}']+|\p{Lu}\.)\s(?:\p{Lu}\.\s?)*(?:(?:de la|van der|von der|van|von|de|di|du|del|der)\s)*"
_BESIDE = rf"(?=\p{{Lu}})(?<![\p{{L}}'-])(?=({_BEFORE}\p{{Lu}}[\p{{L}}']+)){_BEFORE}(?=\p{{Lu}}[\p{{L}}'])"
_TURNED = r"(?=\p{Lu})(?<![\p{L}'-])\p{Lu}[\p{L}']+,\s(?:\p{Lu}[\p{L}']+|\p{Lu}\.)"


def word_lists(texts: DataFrame, text: str, given: frozenset[str] = frozenset()) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Towns, words common in lower case, and words frequent at all, counted over distinct texts without their mail addresses.

    A word that stands after an initial, or beside one of the ``given`` names, in at least half of the texts that have
    it with a capital is a family name, and is neither common nor frequent. Kept are words of at least a fixed share of the texts, so their number is bounded by words per text over share.
    """
    # one pass: each text is masked once, and its words, named families and towns are counted together
    signed = F.col(text).contains("@") | F.col(text).contains("＠") | F.col(text).rlike(_MAIL_SIGN)
    masked = F.when(signed, F.regexp_replace(F.col(text), _MASKED, " ")).otherwise(F.col(text))
    spaced = texts.select(text).distinct().select(text, F.translate(masked, "’", "'").alias("s"))
    words = F.array_distinct(F.regexp_extract_all("s", F.lit(r"\p{L}[\p{L}']+"), F.lit(0)))
    before = F.transform(F.regexp_extract_all("s", F.lit(_BESIDE), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^\S+", 0).alias("g"), F.regexp_extract(x, r"[\p{L}']+$", 0).alias("w")))
    after = F.transform(F.regexp_extract_all("s", F.lit(_TURNED), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, r"\S+$", 0).alias("g"), F.substring_index(x, ",", 1).alias("w")))
    beside = F.array_distinct(F.transform(F.filter(F.concat(before, after), lambda p: p.g.endswith(".") | F.lower(p.g).isin(*sorted(given))), lambda p: F.lower(p.w)))
    coded = F.concat(
        F.regexp_extract_all(F.col(text), F.lit(r", (\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,2}) \d{5}\b"), F.lit(1)),
        F.regexp_extract_all(F.col(text), F.lit(r", \d{5} (\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,2})(?=[.,;)\r\n|]|$)"), F.lit(1)),
    )
    entry = lambda what, low, small=False: F.struct(F.lit(what).alias("what"), low.alias("low"), (F.lit(False) if small is False else small).alias("small"))
    seen = F.concat(
        F.array(entry("text", F.lit(""))),
        F.transform(words, lambda w: entry("word", F.lower(w), w == F.lower(w))),
        F.transform(beside, lambda w: entry("beside", w)),
        F.transform(F.array_distinct(coded), lambda t: entry("town", F.lower(t))),
    )
    counts = spaced.select(F.inline(seen)).groupBy("low").agg(F.count_if("small").alias("small"), *[F.count_if(F.col("what") == w).alias(c) for w, c in (("text", "rows"), ("word", "n"), ("beside", "named"), ("town", "town"))])
    counts = cut_lineage(counts)
    rows = counts.agg(F.sum("rows")).first()[0] or 0
    kept = counts.filter((F.col("small") >= max(5, rows / 5000)) | (F.col("n") >= max(20, rows / 200)))
    kept = kept.filter(F.col("named") * 2 < F.greatest(F.lit(3), F.col("n") - F.col("small")))
    common, frequent = set(), set()
    for r in kept.toLocalIterator():
        (common if r["small"] >= max(5, rows / 5000) else frequent).add(r["low"])
    towns = counts.filter(F.col("town") >= max(3, rows / 5000)).select("low")
    return frozenset(r["low"] for r in towns.toLocalIterator()), frozenset(common), frozenset(frequent | common)


def find_personal(documents: DataFrame, given: frozenset[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, entities): each text with its entities (kind, value, start, end).

    ``given`` holds usual given names, folded. Null and empty texts have no entities; texts of any length are scanned
    whole; repeated rows give repeated results; other columns are dropped; an empty table gives an empty result.
    """
    base = documents.select(F.col(key), F.col(text).cast("string").alias(text))
    towns, common, frequent = word_lists(base.filter(F.col(text).isNotNull()), text, given | {fold(n) for n in NICKNAMES})

    @F.pandas_udf(ENTITY)
    def entities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = Detector(given, towns, common, frequent)
        for batch in batches:
            yield batch.map(lambda x: [dict(zip(("kind", "value", "start", "end"), e)) for e in detector.find(x)])

    return base.withColumn("entities", F.coalesce(entities(text), F.array().cast(ENTITY)))


# Surrogates

_SYLLABLES = "ba be bi bo bu da de di do du fa fe fi fo ga ge go ha he ho ja jo ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi vo za ze zo".split()
_CYRILLIC = "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то".split()
_HAN = "安白成大方高光海和江金林明宁平山石天田文西夏新雪阳云"
# Given names that women bear; with those that end in "a" but for the exceptions, and what titles say, they tell the gender.
WOMEN = frozenset("agnes alice anais anne anneke beatrice carmen chloe deborah elizabeth elif esther grace hannah helen ingrid ines irene jacqueline jane jennifer judith karen kate katherine lucy malle margaret marie mary michelle nicole rachel rosemary ruth sarah sirin sophie stephanie sue susan tamar yasmin zoe".split())
MEN_IN_A = frozenset("andrea ezra joshua luca mustafa nikita nicola sasha".split())
# Titles of women and of men, and words of addresses that are no names.
TITLES = {"f": ("mrs", "ms", "miss", "frau", "madame", "mme", "señora", "sra", "signora"), "m": ("mr", "herr", "monsieur", "señor", "sr", "signor")}
_KEEP = frozenset("flat apt apartment unit suite street road lane terrace avenue court drive way square place close row crescent garden gardens box calle avenida camino plaza paseo carrera ronda postfach rue chemin boulevard quai impasse allee route cours passage apartado correos boite postale am an der auf dem im in den zum zur unter hinter vor de la du des del las los p o bp".split())
_LETTERS = regex.compile(r"[\p{L}\p{M}'’]+")
_AT = regex.compile(r"[@＠]|\s?[\[({](?i:at|@|arroba|ät)[\])}]\s?|\s(?i:at)\s")
_DOTS = frozenset(("dot", "punkt", "point", "punto"))
KEPT_DIGITS = 2  # digits at the start of a phone number that stay: what it is dialled with


def _draw(key: str, *parts: object) -> int:
    return int.from_bytes(hmac.new(key.encode(), "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()[:12], "big")


def _word(like: str, seed: int) -> str:
    """A lower-case word made up from the seed in the script and about the length of ``like``."""
    if regex.search(r"\p{Han}", like):
        return "".join(_HAN[(seed >> (5 * i)) % len(_HAN)] for i in range(max(2, len(like))))
    parts = _CYRILLIC if regex.search(r"\p{Cyrillic}", like) else _SYLLABLES
    out = ""
    while len(out) < max(4, min(len(like), 9)):
        out += parts[seed % len(parts)]
        seed //= len(parts)
    return out


def _cased(word: str, like: str) -> str:
    """The word in the letter case of ``like``."""
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def gender_of(given: str, told: dict[str, str] | None = None) -> str:
    """f or m of a folded given name: what titles in the corpus say, else the list, else the ending."""
    return (told or {}).get(given) or ("f" if given in WOMEN or (given.endswith("a") and given not in MEN_IN_A) else "m")


def other_names(given: frozenset[str], key: str, told: dict[str, str] | None = None) -> dict[str, str]:
    """Another given name of the same gender for each, none for two: a keyed turn of each gender's names. A name alone in its gender stays out."""
    out = {}
    for gender in "fm":
        own = sorted((g for g in given if g.isascii() and gender_of(g, told) == gender), key=lambda g: _draw(key, "given", g))
        out |= {a: b for a, b in zip(own, [*own[1:], *own[:1]]) if a != b}
    return out


class Person(NamedTuple):
    """A mention of a name in its parts, folded: given name (full form), initial, and the tokens of the family name."""

    given: str
    initial: str
    family: str


def person_of(value: str, given: frozenset[str]) -> Person:
    """The person a mention names, with initial only where the given name is not written."""
    family, first, initial, _, kind = parse_name(value, given)
    return Person(first if kind == "full" else "", initial, family)


def atoms_of(kind: str, value: str, given: frozenset[str]) -> list[str]:
    """What of an entity is replaced as one thing wherever it stands: words of family names, mail addresses and places, and whole numbers."""
    if kind in ("phone", "id_number"):
        return [f"{kind}:{''.join(c for c in value if c.isalnum()).upper()}"]
    words = [fold(m.group()) for m in _LETTERS.finditer(value)]
    if kind == "name":
        return sorted({f"word:{w}" for w in words if len(w) > 1 and w not in given and w not in PARTICLES and w not in SUFFIXES})
    if kind == "email":
        return sorted({f"word:{w}" for w in words if len(w) > 1 and w not in given and w not in _DOTS})
    return sorted({f"word:{w}" for w in words if len(w) > 1 and w not in _KEEP})


def made_up(atom: str, key: str, salt: int) -> str:
    """The surrogate of an atom, drawn by the key."""
    kind, _, value = atom.partition(":")
    draw = _draw(key, atom, salt)
    if kind == "word":
        return _word(value, draw)
    out = []
    for i, c in enumerate(value):
        draw, take = divmod(draw, 26) if draw else (0, _draw(key, atom, salt, i) % 26)
        out.append(c if kind == "phone" and i < KEPT_DIGITS else str(take % 10) if c.isdigit() else chr(65 + take) if c.isalpha() else c)
    return "".join(out)


def shifted(digits: str, key: str) -> str:
    """Another number of as many digits, with a zero at its start only if there was one; different numbers stay different."""
    low = 0 if digits[0] == "0" else 10 ** (len(digits) - 1)
    size = 10 ** (len(digits) - 1) if digits[0] == "0" else 9 * low
    turn = 1 + _draw(key, "number", len(digits)) % max(1, size - 1)
    return str(low + (int(digits) - low + turn) % size).zfill(len(digits))


def rendered(kind: str, value: str, atoms: dict[str, str], names: dict[str, str], who: str, key: str) -> str:
    """The entity with its atoms replaced, in its own format and letter case. ``who`` is the given name that an initial stands for, if known."""
    word = lambda token: _cased(atoms.get(f"word:{fold(token)}", token.lower()), token)
    if kind in ("phone", "id_number"):
        new = iter(next(iter(atoms.values())))
        return "".join((x if c.isupper() or c.isdigit() else x.lower()) if c.isalnum() and (x := next(new)) else c for c in value)
    if kind == "name":
        first = True

        def swap(m: regex.Match) -> str:
            nonlocal first
            token, low = m.group(), fold(m.group())
            if low in PARTICLES or low in SUFFIXES:
                return token
            if len(token) == 1:
                out = names.get(who, "")[:1].upper() if first and names.get(who) else chr(65 + _draw(key, "initial", low) % 26)
                first = False
                return out if token.isupper() else out.lower()
            if f"word:{low}" in atoms:
                return word(token)
            first = False
            full = fold(NICKNAMES.get(low, low))
            return _cased(names.get(full, names.get(low, _word(low, _draw(key, "given", low)))), token)

        return _LETTERS.sub(swap, value)
    digits = lambda m: shifted(m.group(), key)
    if kind == "email":
        at = _AT.search(value)
        local, sign, domain = (value[: at.start()], at.group(), value[at.end() :]) if at else (value, "", "")
        token = lambda m: _cased(names[fold(m.group())], m.group()) if fold(m.group()) in names else m.group() if fold(m.group()) in _DOTS or len(m.group()) == 1 else word(m.group())
        last = max((m.start() for m in _LETTERS.finditer(domain)), default=len(domain))
        made = regex.sub(r"\d+", digits, _LETTERS.sub(token, local))
        return made + sign + regex.sub(r"\d+", digits, _LETTERS.sub(lambda m: m.group() if m.start() == last else token(m), domain))
    return regex.sub(r"\d+", digits, _LETTERS.sub(lambda m: word(m.group()) if f"word:{fold(m.group())}" in atoms else m.group(), value))


def distinct_surrogates(atoms: DataFrame, key: str) -> DataFrame:
    """(atom, new): one surrogate for each distinct atom, no two alike and none that is itself an atom: those that are alike are drawn again until none is."""

    @F.pandas_udf(T.StringType())
    def make(atom: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([made_up(a, key, int(s)) for a, s in zip(atom, salt)], dtype=object)

    each = cut_lineage(atoms.select("atom").distinct().withColumn("salt", F.lit(0)).withColumn("new", make("atom", F.lit(0))))
    kind = F.substring_index("atom", ":", 1)
    taken = each.select(F.col("atom").alias("taken"))
    while True:
        seat = F.row_number().over(Window.partitionBy(kind, "new").orderBy("atom"))
        placed = each.withColumn("seat", seat).join(taken, F.concat(kind, F.lit(":"), F.col("new")) == F.col("taken"), "left")
        again = (F.col("seat") > 1) | F.col("taken").isNotNull()
        step = F.when(F.col("taken").isNotNull(), 1).otherwise(F.col("seat") - 1)
        placed = cut_lineage(placed.select("atom", "new", F.when(again, F.col("salt") + step).otherwise(F.col("salt")).alias("salt"), again.alias("again")))
        if placed.filter("again").isEmpty():
            return placed.select("atom", "new")
        each = placed.select("atom", "salt", F.when(F.col("again"), make("atom", "salt")).otherwise(F.col("new")).alias("new"))


def told_genders(texts: DataFrame, text: str, given: frozenset[str]) -> dict[str, str]:
    """The gender of given names that stand after a title more often of one gender than of the other: bounded by the given names."""
    pattern = rf"(?i)\b({'|'.join(w for words in TITLES.values() for w in words)})\b\.?\s+(\p{{Lu}}[\p{{L}}'-]+)"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2)).alias("n"))
    seen = texts.select(F.explode(pairs).alias("p")).select(F.lower("p.t").isin(*TITLES["f"]).alias("f"), F.lower("p.n").alias("n"))
    counts = seen.groupBy("n").agg(F.count_if(F.col("f")).alias("f"), F.count_if(~F.col("f")).alias("m")).filter("f <> m").filter(F.col("n").isin(*sorted(given)))
    return {fold(r["n"]): "f" if r["f"] > r["m"] else "m" for r in counts.toLocalIterator()}


def surrogates(spans: DataFrame, given: frozenset[str], key: str, told: dict[str, str] | None = None) -> DataFrame:
    """(k, kind, value, new): the replacement of each entity (k, kind, value) of each document.

    A person keeps one surrogate under every spelling, order and letter case: family names are replaced word by word, given
    names by another of the same gender, and an initial is that of the given name it stands for: of the one person in the
    document whom it fits, else of the one in the corpus. Mail addresses take the surrogates of the names in them,
    and their domain is replaced but for its last label. Numbers are the same under every format. No two words or
    numbers share a surrogate, and house numbers are shifted by the key, so different entities stay different.
    """
    known = given | {fold(n) for n in NICKNAMES} | {fold(n) for n in NICKNAMES.values()}
    names = other_names(known, key, told)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def atoms(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([atoms_of(k, v, known) for k, v in zip(kind, value)], dtype=object)

    @F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in Person._fields]))
    def person(value: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([person_of(v, known) for v in value], columns=Person._fields)

    @F.pandas_udf(T.StringType())
    def render(kind: pd.Series, value: pd.Series, pairs: pd.Series, who: pd.Series) -> pd.Series:
        return pd.Series([rendered(k, v, {p["atom"]: p["new"] for p in ps} if ps is not None else {}, names, w or "", key) for k, v, ps, w in zip(kind, value, pairs, who)], dtype=object)

    mentions = spans.select("k", "kind", "value").distinct()
    values = cut_lineage(mentions.select("kind", "value").distinct().withColumn("atoms", atoms("kind", "value")))
    each = values.select("kind", "value", F.explode("atoms").alias("atom"))
    drawn = each.join(distinct_surrogates(each, key), "atom").groupBy("kind", "value").agg(F.collect_list(F.struct("atom", "new")).alias("pairs"))
    people = cut_lineage(mentions.filter("kind = 'name'").withColumn("p", person("value")).select("k", "value", "p.*"))
    only = F.when(F.min("given") == F.max("given"), F.min("given"))
    full = people.filter("given <> ''")
    here = full.groupBy("k", "family", "initial").agg(only.alias("here"))
    anywhere = full.groupBy("family", "initial").agg(only.alias("anywhere"))
    who = people.filter("given = ''").join(here, ["k", "family", "initial"], "left").join(anywhere, ["family", "initial"], "left").select("k", F.lit("name").alias("kind"), "value", F.coalesce("here", "anywhere").alias("who"))
    out = mentions.join(drawn, ["kind", "value"], "left").join(who, ["k", "kind", "value"], "left")
    return out.select("k", "kind", "value", render("kind", "value", "pairs", "who").alias("new"))


@F.pandas_udf(T.StringType())
def _spliced(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, found in zip(text, spans):
        if t is None or found is None or not len(found):
            out.append(t)
            continue
        parts, at = [], 0
        for s in sorted(found, key=lambda x: x["start"]):
            parts += [t[at : s["start"]], s["new"]]
            at = s["end"]
        out.append("".join([*parts, t[at:]]))
    return pd.Series(out, dtype=object)


def pseudonymise(documents: DataFrame, given: frozenset[str], secret: str, key: str = "doc_id", text: str = "text", style: str = "surrogate") -> DataFrame:
    """(key, text): the texts with every entity replaced and all else unchanged.

    ``style`` is "placeholder" for "[KIND]", or "surrogate" for keyed surrogates. The key has to be unique.
    """
    found = cut_lineage(find_personal(documents, given, key, text))
    spans = found.select(F.col(key).alias("k"), F.explode("entities").alias("e")).select("k", "e.*")
    if style == "placeholder":
        new = spans.withColumn("new", F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    else:
        told = told_genders(documents.filter(F.col(text).isNotNull()), text, given)
        new = spans.join(surrogates(spans, given, secret, told), ["k", "kind", "value"])
    lists = new.groupBy("k").agg(F.collect_list(F.struct("start", "end", "new")).alias("spans"))
    return found.join(lists, F.col(key) == F.col("k"), "left").select(key, _spliced(text, "spans").alias(text))
