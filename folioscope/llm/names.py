"""Variant spellings of people's names: parsing, exact radius joins in metric cells, and linking.

A typed name is brought to one form and parsed into family, given name and initials. Spellings that differ by form,
order, accents, transliteration, suffix or nickname meet by key. Spellings that differ by a typing error meet in a
radius join: names live in the metric space of the unrestricted Damerau-Levenshtein distance; the pivots are the
words "aaaa…", "bbbb…" and so on, whose distance to a name is known in closed form (the pivot's length less the
letter's count), so a cell is a vector of pivot distances. By the triangle inequality the vectors of two names within
the radius differ by at most the radius in each way; each name is replicated to the cells that its boundary reaches,
and inside a cell every pair is held against the true distance.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.graph import components
from folioscope.llm.textform import transducer
from folioscope.session import cut_lineage

# Short forms of given names, and the full forms they may stand for (the first one counts).
NICKNAMES = {
    "alex": "alexander", "andy": "andrew", "bea": "beatrice", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "beppe": "giuseppe", "bill": "william", "bob": "robert",
    "charlie": "charles", "chris": "christopher", "dan": "daniel", "dave": "david", "debbie": "deborah", "dick": "richard", "fred": "frederick", "gabe": "gabriel", "gosia": "malgorzata",
    "greg": "gregory", "hannes": "johannes", "harry": "harold", "jackie": "jacqueline", "jim": "james", "joe": "joseph", "kasia": "katarzyna", "kate": "katherine", "larry": "lawrence",
    "leo": "leonard", "liz": "elizabeth", "lupe": "guadalupe", "maggie": "margaret", "matt": "matthew", "mike": "michael", "nacho": "ignacio", "nate": "nathaniel", "ned": "edward",
    "nick": "nicholas", "ola": "aleksandra", "paco": "francisco", "pat": "patricia", "peggy": "margaret", "pepe": "jose", "pete": "peter", "rick": "richard", "sam": "samuel",
    "sasha": "alexander", "steph": "stephanie", "steve": "stephen", "sue": "susanna", "ted": "theodore", "tim": "timothy", "tom": "thomas", "tony": "anthony", "trish": "patricia",
    "val": "valentina", "vicky": "victoria", "will": "william", "zack": "zachary",
}
# Particles before a family name, suffixes after it, and letters without a decomposition.
PARTICLES = frozenset("de la los las van von der den del della di da dos du le ter ten zu el".split())
SUFFIXES = frozenset("jr sr ii iii iv phd md dr prof".split())
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "a", "œ": "o", "ı": "i", "’": "'", "ʼ": "'", "‐": "-", "‑": "-"})
DIGRAPHS = regex.compile(r"(?<=[aou])e")

FORM = T.StructType([*(T.StructField(c, T.StringType()) for c in ("family", "given", "initial", "middle", "kind")), T.StructField("borne", T.IntegerType())])
RARE = 8  # a family name of at most so many given names is rare enough for an initial to name one person anywhere


def fold(text: str) -> str:
    """Lower case, accents and transliterated umlauts off."""
    low = unicodedata.normalize("NFKD", text.lower().translate(LETTERS))
    low = "".join(c for c in low if not unicodedata.combining(c)).replace("''", "'")
    return DIGRAPHS.sub("", low)


def parse_name(raw: str, known: frozenset[str] = frozenset(), near: frozenset[str] = frozenset()) -> tuple[str, str, str, str, str]:
    """Family, given name, first initial, middle initial and kind (full, initials or mono) of a name as typed.

    ``known`` holds usual given names, ``near`` what they become with one letter taken out; with them a family name
    typed first is told apart from a given name.
    """
    text = transducer().apply(raw).strip()
    text = regex.sub(r"""\s*["“(][^"”)]*["”)]\s*""", " ", text)
    shout = text.upper() == text
    before, comma, after = text.partition(",")

    def cut(part: str) -> list[str]:
        out = []
        for token in regex.sub(r"(?<=\b\p{L})\.(?=\S)", ". ", part).split():
            low = fold(token).strip(".'\"")
            if not low or low in SUFFIXES:
                continue
            bare = token.strip(".")
            if not shout and 2 <= len(bare) <= 3 and bare.isalpha() and bare.isupper() and low not in known:
                out.extend(low)
            else:
                out.append(low)
        return out

    if comma:
        family, given = cut(before), cut(after)
    else:
        tokens = cut(text)
        turn = 0
        if len(tokens) > 1 and len(tokens[0]) > 1 and tokens[0] not in known:
            spots = [i for i in range(1, len(tokens)) if tokens[i] in known]
            if not spots and not _close(tokens[0], known, near):
                spots = [i for i in range(1, len(tokens)) if len(tokens[i]) > 3 and _close(tokens[i], known, near)]
            turn = spots[0] if spots else 0
        if turn:
            family, given = tokens[:turn], tokens[turn:]
        elif len(tokens) == 1:
            return tokens[0], "", "", "", "mono"
        else:
            split = max((i for i in range(1, len(tokens)) if len(tokens[i]) > 1), default=len(tokens) - 1)
            family, given = tokens[split:], tokens[:split]
    family = [t for t in family if t not in PARTICLES] or family
    given = [t for t in given if t not in PARTICLES] or given
    if not given:
        return " ".join(family), "", "", "", "mono"
    first = _full_form().get(given[0], given[0])
    middle = given[1][0] if len(given) > 1 else ""
    if len(first) == 1:
        return " ".join(family), "", first, middle, "initials"
    return " ".join(family), first, first[0], middle, "full"


@functools.cache
def _full_form() -> dict[str, str]:
    """Short forms and full forms, folded as names are."""
    return {fold(short): fold(whole) for short, whole in NICKNAMES.items()}


def _close(token: str, known: frozenset[str], near: frozenset[str]) -> bool:
    """Whether the token is a known given name but for one letter."""
    return token in known or token in near or any(token[:i] + token[i + 1 :] in known or token[:i] + token[i + 1 :] in near for i in range(len(token)))


def edit_distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, and swap, which is a metric."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    grid = [[top] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        grid[i + 1][1] = i
    for j in range(len(b) + 1):
        grid[1][j + 1] = j
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            cost = x != y
            if not cost:
                seen = j
            grid[i + 1][j + 1] = min(grid[i][j] + cost, grid[i + 1][j] + 1, grid[i][j + 1] + 1, grid[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return grid[-1][-1]


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int32")


def cells_of(word: str, radius: int) -> set[int]:
    """The cell of a word, which is the vector of its letter counts, and the cells that its boundary reaches: up to ``radius`` letters taken out."""
    letters = "".join(sorted(word))
    every = level = {letters}
    for _ in range(radius):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w)) if not i or w[i] != w[i - 1]}
        every = every | level
    return {xxhash.xxh64_intdigest(w) - (1 << 63) for w in every}


def radius_join(names: DataFrame, column: str, radius: int = 1) -> DataFrame:
    """(a, b) with a < b: all pairs of different values of ``column`` at a distance of 1 to ``radius``.

    Exact: an edit takes at most one letter from either word and gives it at most one, so two such values share a cell
    after at most ``radius`` letters are taken out of each. Nulls are dropped, repeats count once. Cells hold words with
    the same letters, so none is large unless the values themselves are anagrams.
    """

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def cells(words: pd.Series) -> pd.Series:
        return pd.Series([list(cells_of(w, radius)) for w in words], dtype=object)

    spread = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    word = names.select(F.col(column).alias("word")).filter("word is not null").distinct().repartition(spread, "word")
    placed = word.select("word", F.explode(cells("word")).alias("cell"))
    left, right = placed.withColumnRenamed("word", "a"), placed.withColumnRenamed("word", "b")
    near = left.join(right, "cell").filter("a < b").select("a", "b").filter(F.abs(F.length("a") - F.length("b")) <= radius).distinct()
    # a swap counts two letters replaced
    near = near.filter(F.levenshtein("a", "b", 2 * radius) >= 0)
    return near.filter((F.levenshtein("a", "b", radius) >= 0) | (_distance("a", "b") <= radius))


def given_lexicon(values: DataFrame, column: str, share: float = 1e-4, least: int = 3) -> dict[str, int]:
    """Usual given names and the number of families that bear each: first words of names, or words after "Family,".

    Kept are names borne by at least ``least`` families and the ``share`` of all families, so the result is bounded
    by the names per family divided by ``share`` whatever the size of the table.
    """

    name = F.trim(F.regexp_replace(F.lower(F.col(column)), r"[\"“”(][^\"“”()]*[\"“”)]", " "))
    parts = F.filter(F.split(F.regexp_replace(name, ",", " , "), r"\s+"), lambda w: w != "")
    turned = F.array_contains(parts, ",")
    given = F.when(turned, F.try_element_at(parts, (F.array_position(parts, ",") + 1).cast("int"))).otherwise(F.try_element_at(parts, F.lit(1)))
    family = F.when(turned, F.try_element_at(parts, (F.array_position(parts, ",") - 1).cast("int"))).otherwise(F.try_element_at(parts, F.lit(-1)))
    seen = values.select(column).filter(F.col(column).isNotNull()).distinct().select(given.alias("given"), family.alias("family"), F.size(parts).alias("n"))
    counts = cut_lineage(seen.filter((F.col("n") > 1) & F.col("given").rlike(r"^[^\s.,\d]{2,}$")).groupBy("given").agg(F.count_distinct("family").alias("families")))
    total = counts.agg(F.sum("families")).first()[0] or 0
    out: dict[str, int] = {}
    for row in counts.filter(F.col("families") >= max(least, total * share)).toLocalIterator():
        out[fold(row["given"])] = out.get(fold(row["given"]), 0) + row["families"]
    return {g: n for g, n in out.items() if g not in PARTICLES}


def parse_column(lexicon: dict[str, int]):
    """A column function that parses names with the lexicon; borne is how many families have the given name, null for none of the usual ones."""
    known = frozenset(lexicon) | frozenset(_full_form())
    near = frozenset(g[:i] + g[i + 1 :] for g in lexicon if len(g) > 3 for i in range(len(g)))

    @F.pandas_udf(FORM)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def parsed(x: str) -> tuple:
            form = parse_name(x, known, near)
            return (*form, lexicon.get(form[1]))

        one = functools.lru_cache(100_000)(parsed)
        for batch in batches:
            yield pd.DataFrame([one(x) for x in batch], columns=FORM.names).astype({"borne": "Int32"})

    return parse


def people(mentions: DataFrame, circles: DataFrame | None, typed_ratio: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Person of each (id, name) of ``mentions``, and the circles with what joins them.

    Returns (id, name, circle, person), (src, dst): edges between circles that share a person, and (id, circle). ``circles`` gives
    keys (id, key) that put papers into one circle besides shared full names, for instance their venue. Initials are
    resolved inside a circle where they fit exactly one person. Where they fit none there, they name the one person of
    the whole table that they fit, if the paper is alone in its circle or the family name is rare (``RARE``) and no middle
    initial speaks against it; a family name that never stands with a given name is one person per initial. A given name
    one letter off another counts as a typing error only where one of the two is none of the usual ones or is borne by
    ``typed_ratio`` times fewer families. Between two circles of several papers each, only errors that leave no other
    well-formed name are followed: a letter too many, too few or swapped, beside a name of the same spelling. A name
    of one word has no error that could be told from another name. Rows with a null name are dropped.
    """
    base = mentions.select("id", "name").filter("name is not null").distinct()
    lexicon = given_lexicon(base, "name")
    parse = parse_column(lexicon)
    rows = base.withColumn("f", parse("name")).select("id", "name", "f.*")
    rows = cut_lineage(rows.withColumn("full", F.when(F.col("kind") != "initials", F.concat_ws(" ", F.nullif("given", F.lit("")), "family"))))

    # circles: papers tied by a key or a full name; every paper hangs on one key, its series if it has one
    named = rows.filter("full is not null").select("id", F.xxhash64(F.lit("n"), "full").alias("key"))
    ids, keys = rows.select("id"), named
    hub = named.groupBy("id").agg(F.min("key").alias("hub"))
    if circles is not None:
        tied = circles.filter("key is not null").select("id", F.xxhash64(F.lit("v"), "key").alias("key"))
        ids, keys = ids.union(circles.select("id")), named.union(tied)
        hub = hub.join(tied.groupBy("id").agg(F.min("key").alias("series")), "id", "full").select("id", F.coalesce("series", "hub").alias("hub"))
    hub = cut_lineage(ids.distinct().join(hub, "id", "left").select("id", F.coalesce("hub", F.xxhash64(F.lit("p"), "id")).alias("hub")))
    placed = components(keys.join(hub, "id").filter("hub != key").select(F.col("hub").alias("src"), F.col("key").alias("dst")))
    home = cut_lineage(hub.join(placed, hub.hub == placed.node, "left").select("id", F.coalesce("component", "hub").alias("circle")))
    size = home.groupBy("circle").agg(F.count("*").alias("papers"))
    rows = cut_lineage(rows.join(home, "id"))

    # full names: typing errors
    full = cut_lineage(rows.filter("full is not null").groupBy("full", "given", "family", "borne").agg(F.min("circle").alias("circle")).join(size, "circle"))
    close = radius_join(full.filter("given != ''"), "full")
    one, two = (full.select(F.col("full").alias(x), F.col("circle").alias(f"{x}_c"), F.col("given").alias(f"{x}_g"), F.col("family").alias(f"{x}_f"), F.col("borne").alias(f"{x}_n"), F.col("papers").alias(f"{x}_p")) for x in "ab")
    pairs = close.join(one, "a").join(two, "b")
    borne = lambda c: F.coalesce(F.col(c), F.lit(1))
    unusual = F.col("a_n").isNull() != F.col("b_n").isNull()
    slip = unusual | (F.greatest(borne("a_n"), borne("b_n")) >= typed_ratio * F.least(borne("a_n"), borne("b_n")))
    typed = (F.col("a_g") == F.col("b_g")) | ((F.col("a_f") == F.col("b_f")) & slip)
    near_by = (F.col("a_c") == F.col("b_c")) | (F.col("a_p") == 1) | (F.col("b_p") == 1)
    broken = (F.length("a") != F.length("b")) | (F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", "")))
    afar = broken & ((F.col("a_g") == F.col("b_g")) | ((F.col("a_f") == F.col("b_f")) & unusual))
    links = cut_lineage(pairs.filter(typed & (near_by | afar)).select(F.xxhash64("a").alias("src"), F.xxhash64("b").alias("dst"), "a_c", "b_c"))
    merged = components(links)
    person = full.withColumn("node", F.xxhash64("full")).join(merged, "node", "left").select("full", F.coalesce("component", "node").alias("person"))
    person = cut_lineage(person)

    # initials: the one person of the circle they fit, with a middle initial the one that has it; else the one they fit anywhere
    at = rows.filter("kind = 'full'").select("circle", "family", "given", "initial", "middle", "full").distinct().join(person, "full")
    only = F.when(F.min("person") == F.max("person"), F.min("person"))
    fits = at.groupBy("circle", "family", "initial").agg(only.alias("person"), F.lit(True).alias("some"))
    exact = at.filter("middle != ''").groupBy("circle", "family", "initial", "middle").agg(only.alias("by_middle")).filter("by_middle is not null")
    middles = F.collect_set(F.nullif("middle", F.lit("")))  # at most one per letter
    every = at.groupBy("family", "initial").agg(only.alias("anywhere"), F.min("circle").alias("there"), middles.alias("has"))
    bearers = at.groupBy("family").agg(F.count_distinct("given").alias("bearers"))
    short = rows.filter("kind = 'initials'").select("circle", "family", "initial", "middle").distinct()
    solo = short.groupBy("family", "initial").agg(F.min("circle").alias("low"), F.count_distinct(F.nullif("middle", F.lit(""))).alias("middles"))
    short = short.join(fits, ["circle", "family", "initial"], "left").join(exact, ["circle", "family", "initial", "middle"], "left").join(every, ["family", "initial"], "left")
    short = short.join(bearers, "family", "left").join(solo, ["family", "initial"], "left").join(size, "circle")
    agrees = (F.col("middle") == "") | (F.size("has") == 0) | F.array_contains("has", F.col("middle"))
    far = F.col("some").isNull() & F.col("anywhere").isNotNull() & agrees & ((F.col("papers") == 1) | (F.col("bearers") <= RARE))
    nameless = F.col("some").isNull() & F.col("bearers").isNull() & (F.col("middles") <= 1)
    alone = F.xxhash64(F.lit("i"), "circle", "family", "initial", F.when(F.col("some"), F.col("middle")))
    who = F.coalesce("person", "by_middle", F.when(far, F.col("anywhere")), F.when(nameless, F.xxhash64(F.lit("i"), "family", "initial")), F.when(F.col("some").isNull(), alone))
    there = F.when(far, F.col("there")).when(nameless & (F.col("low") != F.col("circle")), F.col("low"))
    short = cut_lineage(short.select("circle", "family", "initial", "middle", who.alias("person"), there.alias("there")))

    fulls = rows.filter("full is not null").join(person, "full").select("id", "name", "circle", "person")
    shorts = rows.filter("kind = 'initials'").join(short, ["circle", "family", "initial", "middle"], "left").select("id", "name", "circle", "person")
    joined = links.filter("a_c != b_c").select(F.col("a_c").alias("src"), F.col("b_c").alias("dst")).union(short.filter("there is not null").select(F.col("circle").alias("src"), F.col("there").alias("dst")))
    return fulls.union(shorts), joined, home


def persons_of(persons: DataFrame) -> DataFrame:
    """(name, person): each spelling with the person it names; a spelling that names several has several rows, one that names none is left out."""
    return persons.filter("person is not null").select("name", "person").distinct()


def variant_pairs(persons: DataFrame, block: int = 200) -> DataFrame:
    """(name_a, name_b), name_a < name_b: different spellings of one person. Rows without a person give no pair.

    A person of more than ``block`` spellings is spread: one side of its pairs is cut into blocks by hash, the other
    side is sent to each, so that no task makes all pairs of a person.
    """
    own = persons_of(persons)
    parts = own.groupBy("person").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    own = cut_lineage(own.join(parts.filter("parts > 1"), "person", "left").withColumn("parts", F.coalesce("parts", F.lit(1))))
    left = own.select("person", F.col("name").alias("name_a"), F.pmod(F.hash("name"), F.col("parts")).alias("part"))
    right = own.select("person", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["person", "part"]).filter("name_a < name_b").select("name_a", "name_b").distinct()
