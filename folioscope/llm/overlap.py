"""Records of evaluation splits that also stand in the training split, exactly or almost.

Keys of the words of the evaluation titles are partitioned together with those of the training titles, training is
scanned for hits, and the containment of each evaluation record in each training record it meets is computed; what
is contained is held word for word against the training title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.splits import series_key
from folioscope.llm.titles import doi_parts, judge, may_be_one, shaped, title_id, title_pairs, usual_tokens, usual_words
from folioscope.session import cut_lineage, release

CONTAINED = 0.6  # share of the evaluation title's words that the training title holds
GENERIC = 4  # a title of so many different proper DOIs says nothing about the work


def prepared(df: DataFrame, usual: frozenset[str]) -> DataFrame:
    """Key columns of a paper table: tokens, variant, cut, DOI, series."""
    key, kind = doi_parts("doi")
    base = df.select("id", *(["source_split"] if "source_split" in df.columns else []), "title", F.col("year").cast("int").alias("year"), key.alias("doi_key"), kind.alias("doi_kind"), F.regexp_extract(F.lower("doi"), r"paper/([0-9a-f]{8,})", 1).alias("page"), series_key("venue").alias("series"))
    return shaped(base, "title", usual).drop("title")


def generic_titles(train: DataFrame) -> DataFrame:
    """(title): titles that many different works bear."""
    proper = train.filter("doi_kind = 'proper'").select("title", F.xxhash64("doi_key").alias("d"))
    return proper.distinct().groupBy("title").agg(F.count("*").alias("works")).filter(F.col("works") >= GENERIC).select("title")


def _volumes(series: str, year: str, doi: str, page: str):
    """Keys of the volume that a generic title belongs to."""
    by_doi = F.when(F.col(doi).isNotNull(), F.xxhash64(F.lit("doi"), F.col(doi)))
    by_series = F.when(F.col(series).isNotNull() & F.col(year).isNotNull(), F.xxhash64(F.lit("vol"), F.col(series), F.col(year)))
    by_page = F.when(F.col(page) != "", F.xxhash64(F.lit("page"), F.col(page)))
    return F.filter(F.array(by_doi, by_series, by_page), lambda x: x.isNotNull())


def cross_split_overlaps(tests: DataFrame, train: DataFrame) -> DataFrame:
    """(source_split, test_id, train_id, containment): evaluation papers and the training papers that are the same work.

    ``tests`` has source_split beside id, title, venue, year and doi; ``train`` has the latter. Null and empty titles
    meet nothing; a title that many works bear counts only inside one volume; repeated rows count once, and every
    different row of one id is compared; ties are all reported, each pair with its largest containment; other columns
    are not read; an empty table gives an empty result.
    """
    usual = usual_words(train, "title")
    held = lambda df: df.withColumn("title", title_id("tokens")).withColumn("text", F.array_join("tokens", " ")).drop("tokens")
    words = lambda text: F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
    t, e = cut_lineage(held(prepared(train, usual)).distinct()), cut_lineage(held(prepared(tests, usual)).distinct().withColumn("ref", F.xxhash64("source_split", "id")))
    release(t.sparkSession)
    plain = usual | usual_tokens(t.select(words("text").alias("tokens")), "tokens")
    generic = cut_lineage(generic_titles(t))
    side = lambda df, key: df.filter("text <> ''").select(key, "title", words("text").alias("tokens"), _volumes("series", "year", "doi_key", "page").alias("volumes"))
    near = cut_lineage(title_pairs(side(e, "ref"), side(t.withColumnRenamed("id", "train_id"), "train_id"), "ref", "train_id", plain, generic))
    release(t.sparkSession)
    some = generic.withColumn("generic", F.lit(True))
    t, e = t.join(some, "title", "left"), e.join(some, "title", "left")
    ours = e.select("ref", "source_split", F.col("id").alias("test_id"), F.col("text").alias("ea"), F.col("variant").alias("ev"), F.col("cut").alias("ec"), F.col("year").alias("ey"), F.col("doi_key").alias("ed"), F.col("doi_kind").alias("ek"), F.col("page").alias("ep"), F.col("series").alias("es"), F.col("generic").alias("eg"))
    theirs = t.select(F.col("id").alias("train_id"), F.col("text").alias("ta"), F.col("variant").alias("tv"), F.col("cut").alias("tc"), F.col("year").alias("ty"), F.col("doi_key").alias("td"), F.col("doi_kind").alias("tk"), F.col("page").alias("tp"), F.col("series").alias("ts"), F.col("generic").alias("tg"))
    pairs = near.join(ours.hint("merge"), "ref").join(theirs.hint("merge"), "train_id")
    pairs = pairs.withColumns({"ea": words("ea"), "ta": words("ta"), "generic": F.coalesce("eg", "tg")}).filter(may_be_one("ea", "ta"))  # texts go through the joins, as they are smaller
    # words that both hold, misspelt ones counted: of all words of the evaluation title, and where one of the two is cut, of the cut one
    pairs = pairs.withColumn("j", judge(F.array_join("ea", " "), F.array_join("ta", " ")))
    shared = F.round(F.col("j.score") * (F.size("ea") + F.size("ta")) / (1 + F.col("j.score")))
    pairs = pairs.withColumn("containment", shared / F.size("ea"))
    part_of = F.when((F.col("ec") | F.col("tc") | (F.col("j.relation") == "prefix")) & (F.size("ta") < F.size("ea")), shared / F.size("ta")).otherwise(F.col("containment"))
    pairs = pairs.filter(part_of >= CONTAINED)
    doi_same = F.coalesce(F.col("ed") == F.col("td"), F.lit(False)) & (F.col("ek") == "proper") | F.coalesce((F.col("ep") != "") & (F.col("ep") == F.col("tp")), F.lit(False))
    doi_other = F.coalesce((F.col("ek") == "proper") & (F.col("tk") == "proper") & (F.col("ed") != F.col("td")), F.lit(False))
    year_near = F.coalesce(F.abs(F.col("ey") - F.col("ty")) <= 2, F.lit(True))
    series_other = F.coalesce(F.col("es") != F.col("ts"), F.lit(False))
    variant_same = (F.col("ev") == F.col("tv")) | (doi_same & (F.col("ec") | F.col("tc")))
    whole = (F.col("j.relation") == "same") & (doi_same | (year_near & ~(doi_other & (series_other | F.coalesce("generic", F.lit(False))))))
    part = (F.col("j.relation") == "prefix") & (doi_same | (year_near & ~doi_other & ~series_other))
    one_volume = F.coalesce(F.col("ed") == F.col("td"), F.lit(False)) | F.coalesce((F.col("es") == F.col("ts")) & (F.col("ey") == F.col("ty")), F.lit(False)) | F.coalesce((F.col("ep") != "") & (F.col("ep") == F.col("tp")), F.lit(False))
    found = pairs.filter(variant_same & (whole | part) & (F.col("generic").isNull() | one_volume))
    return found.groupBy("source_split", "test_id", "train_id").agg(F.max("containment").alias("containment"))
