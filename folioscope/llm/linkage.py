"""Records of two sources that describe one work but share no identifier, each match with a confidence.

Soft logic: every candidate pair is a truth value in [0, 1]; weighted rules on likeness, identifiers, years, variants,
exclusivity and transitivity are hinges of these values, and their weighted sum, a convex problem, is minimised by
alternating directions: each rule moves its own copy of the values it mentions, in closed form; copies meet in their
average; duals carry what is left over, until all agree. Rules tie pairs of one record only, so records are spread over
tasks and their copies are columns of numbers there. The resulting values are the confidences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.overlap import GENERIC
from folioscope.llm.splits import series_key
from folioscope.llm.titles import doi_parts, judged, may_be_one, shaped, title_id, title_pairs, usual_tokens, usual_words
from folioscope.session import cut_lineage, release

# Weights of the rules.
WEIGHTS = {"title": 3.0, "prefix": 2.0, "doi": 2.0, "other doi": 2.5, "other doi and series": 1.5, "year": 1.0, "year of a prefix": 0.7, "variant": 6.0, "prior": 0.4, "exclusive": 2.0, "together": 1.0}
STEP = 1.0  # the penalty of the alternating directions
CLOSE = 1e-4  # how far copies and values may be apart at the end
MOST_STEPS = 50_000  # a task that needs more fails
ROWS_PER_TASK = 200_000


def _sides(papers: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[str]]:
    usual = usual_words(papers, "title")
    key, kind = doi_parts("doi")
    t = papers.select(F.col("id"), "title", F.col("year").cast("int").alias("ty"), key.alias("td"), kind.alias("tk"), series_key("venue").alias("ts")).dropDuplicates(["id"])
    key, kind = doi_parts("openalex_doi")
    o = records.select("openalex_id", "openalex_title", F.col("openalex_year").cast("int").alias("oy"), key.alias("od"), kind.alias("ok")).dropDuplicates(["openalex_id"])
    o = o.withColumn("os", F.nullif(F.regexp_extract("od", r"/([a-z]+)\.\d{4}\.", 1), F.lit("")))
    t = shaped(t, "title", usual).drop("title").withColumnsRenamed({"tokens": "ta", "variant": "tv", "cut": "tc"})
    o = shaped(o, "openalex_title", usual).drop("openalex_title").withColumnsRenamed({"tokens": "oa", "variant": "ov", "cut": "oc"})
    return t, o, usual


def candidate_pairs(papers: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs of like titles or of one proper DOI, with what the rules look at; titles that many works bear, however typed, inside one volume."""
    t, o, usual = _sides(papers, records)
    held = lambda df, words: df.withColumn(words, F.array_join(words, " "))
    t, o = cut_lineage(held(t.withColumns({"tkey": F.xxhash64("ta", "tv"), "title": title_id("ta")}), "ta")), cut_lineage(held(o.withColumn("title", title_id("oa")), "oa"))
    words = lambda text: F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
    usual |= usual_tokens(t.select(words("ta").alias("ta")), "ta")
    generic = cut_lineage(t.filter("tk = 'proper'").select("title", "td").distinct().groupBy("title").agg(F.count("*").alias("n")).filter(F.col("n") >= GENERIC).select("title"))
    volumes = lambda year, doi, series: F.filter(F.array(F.when(F.col(doi).isNotNull(), F.xxhash64(F.lit("d"), doi)), F.when(F.col(series).isNotNull() & F.col(year).isNotNull(), F.xxhash64(F.lit("v"), series, year))), lambda x: x.isNotNull())
    left = t.select("id", "title", words("ta").alias("tokens"), volumes("ty", "td", "ts").alias("volumes"))
    right = o.select("openalex_id", "title", words("oa").alias("tokens"), volumes("oy", "od", "os").alias("volumes"))
    near = title_pairs(left.filter(F.size("tokens") > 0), right.filter(F.size("tokens") > 0), "id", "openalex_id", usual, generic)
    by_doi = t.filter("tk = 'proper'").select("id", "td").join(o.filter("ok = 'proper'").select("openalex_id", "od").hint("merge"), F.col("td") == F.col("od")).select("id", "openalex_id")
    some = generic.withColumn("generic", F.lit(True))
    t = t.join(some, "title", "left").drop("title").withColumnRenamed("generic", "tg")
    o = o.join(some, "title", "left").drop("title").withColumnRenamed("generic", "og")
    pairs = cut_lineage(near.union(by_doi).distinct())
    del near, left, right
    release(pairs.sparkSession)
    pairs = pairs.join(t.hint("merge"), "id").join(o.hint("merge"), "openalex_id")
    pairs = pairs.withColumns({"ta": words("ta"), "oa": words("oa"), "generic": F.coalesce("tg", "og")})  # texts go through the joins, as they are smaller
    by_doi = F.coalesce((F.col("td") == F.col("od")) & (F.col("tk") == "proper"), F.lit(False))
    return judged(pairs.filter(by_doi | may_be_one("ta", "oa")), "ta", "oa")  # no rule speaks for any other pair


_EVIDENCE = ["up", "down", "title", "doi", "other", "year", "variant"]


def with_evidence(pairs: DataFrame) -> DataFrame:
    """(id, openalex_id, tkey, evidence…): what speaks for and against each pair, as the point and the weights of its rules.

    Pairs of which no rule says that they are one work have the value 0, whatever else holds, and are left out.
    """
    w = WEIGHTS
    yes = lambda c: F.coalesce(c, F.lit(False))
    on = lambda cond, weight: F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
    doi_same = yes((F.col("td") == F.col("od")) & (F.col("tk") == "proper"))
    doi_other = yes((F.col("td") != F.col("od")) & (F.col("tk") == "proper") & (F.col("ok") == "proper"))
    series_other = yes(F.col("ts") != F.col("os"))
    year_far = yes(F.abs(F.col("ty") - F.col("oy")) > 2)
    variant = (F.col("tv") != F.col("ov")) & ~(doi_same & (F.col("tc") | F.col("oc")))
    same, prefix = F.col("j.relation") == "same", F.col("j.relation") == "prefix"
    support = F.when(same, 1.0).when(prefix, 0.75).when(doi_same & (F.col("j.score") >= 0.6), 0.6).otherwise(F.round(F.lit(0.2) * F.col("j.score"), 3))
    near = F.when(prefix, F.lit(w["prefix"])).when(same | (support == 0.6), F.lit(w["title"])).otherwise(F.lit(0.0))
    rows = pairs.select(
        "id", "openalex_id", "tkey", support.alias("up"), support.alias("down"), near.alias("title"), on(doi_same, w["doi"]).alias("doi"),
        (on(doi_other, w["other doi"]) + on(doi_other & (series_other | yes(F.col("generic"))), w["other doi and series"])).alias("other"),
        (on(year_far & ~doi_same, w["year"]) + on(year_far & prefix & ~doi_same, w["year of a prefix"])).alias("year"), on(variant, w["variant"]).alias("variant"),
    )
    return rows.filter("title > 0 or doi > 0")


def minimise(cells: pd.DataFrame) -> np.ndarray:
    """The values that minimise the weighted rules of whole records, by alternating directions run until copies and values agree.

    ``cells`` has openalex_id, tkey, the evidence and ``papers``: how many pairs a row stands for. Records do not touch each
    other, so those that have converged are left out of the steps that follow.
    """
    n, w = len(cells), WEIGHTS
    record = pd.factorize(cells["openalex_id"])[0]
    work = pd.factorize(pd.MultiIndex.from_arrays([record, cells["tkey"]]))[0]
    m = cells["papers"].to_numpy(float)
    share = 1.0 / np.bincount(work, m)[work]
    full = lambda v: np.full(n, float(v))
    sign = np.array([1, -1, 1, -1, -1, -1, -1])[:, None]
    at = np.stack([cells["up"].to_numpy(float), cells["down"].to_numpy(float), full(1), full(0), full(0), full(0), full(0)])
    weight = np.stack([cells["title"].to_numpy(float), full(w["title"]), *(cells[c].to_numpy(float) for c in ("doi", "other", "year", "variant")), full(w["prior"])])
    out, x = np.zeros(n), cells["up"].to_numpy(float).copy()
    live = np.arange(n)
    u, ue, ut = np.zeros_like(weight), np.zeros(n), np.zeros(n)
    for step in range(1, MOST_STEPS + 1):
        r, k = pd.factorize(record[live])[0], pd.factorize(work[live])[0]
        held = weight[:, live] > 0
        z = x[None, :] - u
        p, pull = at[:, live], weight[:, live] / STEP
        a = np.where(sign == 1, np.where(z >= p, z, np.minimum(z + pull, p)), np.where(z <= p, z, np.maximum(z - pull, p)))
        ze, zt, s, q = x - ue, x - ut, share[live], m[live]
        # exclusivity: of the works that a record may be, at most one; papers entered twice count as one work
        over = np.bincount(r, q * s * ze) - 1
        ae = ze - (np.clip(over / np.bincount(r, q * s * s), 0, w["exclusive"] / STEP))[r] * s
        # transitivity: papers that are one work match a record together
        mean = (np.bincount(k, q * zt) / np.bincount(k, q))[k]
        am = mean + (zt - mean) * STEP / (STEP + 2 * w["together"])
        new = np.clip((np.where(held, a + u, 0).sum(0) + ae + ue + am + ut) / (held.sum(0) + 2), 0, 1)
        u, ue, ut = np.where(held, u + a - new, 0), ue + ae - new, ut + am - new
        apart = np.maximum(np.where(held, np.abs(a - new), 0).max(0), np.maximum(np.abs(ae - new), np.maximum(np.abs(am - new), np.abs(new - x))))
        x = new
        if step % 10 == 0 or step == MOST_STEPS:
            rest = (np.maximum.reduceat(apart[o := np.argsort(r, kind="stable")], np.flatnonzero(np.diff(r[o], prepend=-1))) > CLOSE)[r]
            out[live] = x
            if not rest.any():
                return out
            live, x, u, ue, ut = live[rest], x[rest], u[:, rest], ue[rest], ut[rest]
    raise RuntimeError(f"{len(live)} pairs have not converged after {MOST_STEPS} steps")


def infer(pairs: DataFrame) -> DataFrame:
    """(id, openalex_id, confidence): the minimiser of the weighted rules.

    Pairs of one record, one title and like evidence are one row with a count, so a record is small however many
    papers bear its title; records are spread over tasks by hash.
    """
    spark = pairs.sparkSession
    rows = cut_lineage(with_evidence(pairs))
    del pairs
    release(spark)
    same = ["openalex_id", "tkey", *_EVIDENCE]
    cells = rows.groupBy(*same).agg(F.count("*").alias("papers"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(spread, -(-rows.count() // ROWS_PER_TASK))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[same].assign(confidence=minimise(frame).round(4))

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    solved = cells.groupBy(F.pmod(F.hash("openalex_id"), F.lit(buckets)).alias("b")).applyInPandas(solve, ", ".join([*(f"{c} {kinds[c]}" for c in same), "confidence double"]))
    return rows.join(solved, same).select("id", "openalex_id", "confidence")


def link_sources(papers: DataFrame, records: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, openalex_id, confidence): pairs of one work whose confidence is at least ``least``.

    ``papers`` has id, title, venue, year, doi; ``records`` openalex_id, openalex_title, openalex_year, openalex_doi.
    Null and empty titles match by a proper DOI alone never; titles that many works bear match inside one volume only;
    repeated rows count once; a work may have several records on either side, and ties are all kept; other columns
    are not read; an empty table on either side gives an empty result.
    """
    return infer(candidate_pairs(papers, records)).filter(F.col("confidence") >= least)
