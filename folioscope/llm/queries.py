"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import leakage, linkage, names, overlap, personal, splits, survivors, textform, tokens
from folioscope.operators.packed import explode_packed
from folioscope.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(table(spark, sf_dir, "train", "id", "authors"), "authors", value="name").select("id", "name")


def p1_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group_id, split): train papers in splits that keep persons and series together."""
    return splits.grouped_split(table(spark, sf_dir, "train", "id", "venue", "label"), _mentions(spark, sf_dir), SHARES)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, group_id): the group of each train paper."""
    return p1_split(spark, sf_dir).select("id", "group_id")


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, openalex_id, confidence): records of train papers."""
    records = table(spark, sf_dir, "openalex_title_features", "openalex_id", "openalex_title", "openalex_year", "openalex_doi")
    return linkage.link_sources(table(spark, sf_dir, "train", "id", "title", "venue", "year", "doi"), records)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, openalex_id): the same work."""
    return p3_links(spark, sf_dir).select("id", "openalex_id")


def _crawls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    abstracts = table(spark, sf_dir, "abstracts_merged_v3", "rec_id", "source_split", "id", "title", "abstract", "oat_match_score", "fetched_at")
    return abstracts, table(spark, sf_dir, "s2_match_abstracts", "rec_id", "source_split", "id", "source_title", "found", "tldr", "match_score", "error", "fetched_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_split, id, field, rec_id): the record whose value survives, of groups of two records or more."""
    long = survivors.survivors(survivors.unpivoted(*_crawls(spark, sf_dir)))
    return long.filter("records > 1").select("source_split", "id", "field", "rec_id")


def p4_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One abstract and one tldr per paper."""
    return survivors.merged_papers(*_crawls(spark, sf_dir))


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "train", "id", "venue").select("id", splits.series_key("venue").alias("key"))
    return names.people(_mentions(spark, sf_dir), papers)[0]


def p5_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, person): each spelling with the person it names."""
    return names.persons_of(_persons(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name_a, name_b): different spellings of one person."""
    return names.variant_pairs(_persons(spark, sf_dir))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("id", "title", "venue", "year", "doi")
    parts = [table(spark, sf_dir, s, *columns).withColumn("source_split", F.lit(s)) for s in ("public_test", "private_test")]
    return overlap.cross_split_overlaps(parts[0].unionByName(parts[1]), table(spark, sf_dir, "train", *columns))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_split, test_id, train_id): test papers that also stand in train."""
    return _overlaps(spark, sf_dir).select("source_split", "test_id", "train_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_split, series, papers, pairs): overlaps per test split and venue series."""
    tests = [table(spark, sf_dir, s, "id", "venue").withColumn("source_split", F.lit(s)) for s in ("public_test", "private_test")]
    venue = tests[0].unionByName(tests[1]).select("source_split", F.col("id").alias("test_id"), splits.series_key("venue").alias("series"))
    found = p6_found(spark, sf_dir).join(venue.dropDuplicates(["source_split", "test_id"]), ["source_split", "test_id"], "left")
    return found.groupBy("source_split", "series").agg(F.count_distinct("test_id").alias("papers"), F.count("*").alias("pairs"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, field): cells of train with a character that stands in for a usual one."""
    cells = textform.disguised_cells(table(spark, sf_dir, "train", "id", "title", "authors"), "id", "title", "authors")
    return cells.select("id", "field").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): token ids of each document."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY)


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score): documents with the evaluation items that leaked into them."""
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "eval_items", "item_id", "text").orderBy("item_id").toLocalIterator()]
    return leakage.leaked(table(spark, sf_dir, "documents", "doc_id", "text"), items)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id): documents that hold a passage of an item."""
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def _given(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    return frozenset(names.given_lexicon(_mentions(spark, sf_dir), "name"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, kind, value): each different piece of personal information of a document."""
    found = personal.find_personal(table(spark, sf_dir, "documents", "doc_id", "text"), _given(spark, sf_dir))
    return found.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.kind", "e.value").distinct()


def p10_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents with keyed surrogates in the place of personal information."""
    return personal.pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"), _given(spark, sf_dir), "folioscope")


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents with typed placeholders in the place of personal information."""
    return personal.pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"), _given(spark, sf_dir), "folioscope", style="placeholder")


QUERIES = {"p10_found": p10_found, "p10_masked": p10_masked, "p10_text": p10_text, "p1_found": p1_found, "p1_split": p1_split, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_papers": p4_papers, "p5_found": p5_found, "p5_persons": p5_persons, "p6_found": p6_found, "p6_report": p6_report, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p9_leaks": p9_leaks}
ORACLES: dict[str, str] = {}
