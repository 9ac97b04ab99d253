"""Queries of score families, reports, caches, encoders, ranks with fallback and audits, beside their SQL."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import enrich as en
from folioscope.operators import features as fe
from folioscope.operators import metrics as me
from folioscope.operators import ranking as rk
from folioscope.operators.edits import edits
from folioscope.operators.marks import BITS, First, kept, marked
from folioscope.operators.profile import domain_distribution
from folioscope.plans.base import CUTS, PAPERS_SQL, TESTS_SQL, held_out, papers, with_folds
from folioscope.plans.ordinal_queries import MET, P, PF, _DOI, _TF, r6
from folioscope.session import cut_lineage, ensure_checkpoint_dir
from folioscope.sources import cache
from folioscope.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query beside its SQL."""

    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep


def _folder(s: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(s)}/{name}-{s.sparkContext.applicationId}"


# score families


def _families(s: SparkSession, d: str) -> list[DataFrame]:
    """Each family as its own table, under the name that its maker gave the column."""
    p = papers(s, d)
    return [cache.score_family(p.select("id", F.col(f"s{i}").alias(name)), "id", ["oof", "score", name], f"s{i}") for i, name in ((1, "oof_score"), (2, "score"), (3, "pred_cont"))]


@query("s7_f6_score_family", P + "select id, round(s1,6) as s1 from papers")
def _(s, d):
    return _families(s, d)[0].select("id", r6("s1").alias("s1"))


@query("j6_j7_anchor_join", P + "select id, label, round(s1,6) as s1, round(s2,6) as s2, case when id%3<>0 then round(s3,6) end as s3 from papers where id%5<>0")
def _(s, d):
    """Families joined by id: one that every row needs, one that lacks rows."""
    a, b, c = _families(s, d)
    out = table(s, d, "train", "id", "label").join(a.filter("id % 5 <> 0"), "id").join(b, "id").join(c.filter("id % 3 <> 0"), "id", "left")
    return out.select("id", "label", *[r6(x).alias(x) for x in ("s1", "s2", "s3")])


@query("j11_sample_order", f"with {TESTS_SQL} select cast(row_number() over(order by md5(id::varchar||source_split), source_split, id) as int) as position, source_split, id, p1 as label from tests")
def _(s, d):
    """Predictions in the order of a sample, here that of a digest."""
    p = held_out(s, d).select("source_split", "id", F.col("p1").alias("label"))
    sample = rk.report_position(p.select("source_split", "id", F.md5(F.concat(F.col("id").cast("string"), "source_split")).alias("o")), [F.col("o"), F.col("source_split"), F.col("id")])
    return sample.join(p, ["source_split", "id"], "left").select("position", "source_split", "id", "label")


@query("u2_symmetric_difference", "select venue, 'public_test' as side from (select distinct venue from public_test except select venue from train) union all select venue, 'train' from (select distinct venue from train except select venue from public_test)")
def _(s, d):
    a, b = table(s, d, "public_test", "venue").distinct(), table(s, d, "train", "venue").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("public_test")).union(b.exceptAll(a).withColumn("side", F.lit("train")))


# readers and writers


@query("s2_s3_first_existing", "select count(*) as first_of, 0::bigint as missing from train")
def _(s, d):
    """The first table that exists, and an empty one in the place of a table that does not."""
    schema = table(s, d, "train", "id").schema
    first = cache.first_existing(s, [f"{d}/no_such_table.parquet", f"{d}/train.parquet"], schema).agg(F.count("*").alias("first_of"))
    return first.crossJoin(cache.read_if_exists(s, f"{d}/no_such_table.parquet", schema).agg(F.count("*").alias("missing")))


@query("s9_replaced_csv", "select id, label+1 as label from train")
def _(s, d):
    """A CSV table that is written twice: readers get the second."""
    path, df = _folder(s, "replaced"), table(s, d, "train", "id", "label")
    cache.replace_csv(df, path)
    cache.replace_csv(df.select("id", (F.col("label") + 1).alias("label")), path)
    return cache.read_csv(s, path, df.schema)


@query("s19_report", "select '| '||label||' | '||count(*)||' |' as line from train group by label union all select unnest(['# Labels','','| label | n |','| --- | --- |']) as line")
def _(s, d):
    """The label report as a markdown file, read back by line."""
    path = _folder(s, "report")
    cache.write_report(table(s, d, "train", "label").groupBy("label").agg(F.count("*").alias("n")).orderBy("label"), path, "Labels")
    return s.read.text(path).select(F.regexp_replace("value", r"^\| --- \| --- \|$", "| --- | --- |").alias("line"))


@query("s21_embedding_cache", "select vec_id, len(embedding) as size, round(sqrt(list_sum(list_transform(embedding, lambda y: y::double*y::double))),4) as norm from embeddings")
def _(s, d):
    """Encoded the first time, read from the cache the second."""
    path, df = _folder(s, "vectors"), table(s, d, "embeddings", "vec_id", "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    encode = lambda x: x.select("vec_id", F.size("embedding").alias("size"), norm.alias("norm"))
    cache.encoded_once(df, path, encode)
    return cache.encoded_once(df, path, encode).select("vec_id", F.col("size").cast("long").alias("size"), F.round("norm", 4).alias("norm"))


# encoders

_NUMERIC, _CATEGORICAL = ["year", "label", "pages"], ["venue", "publisher"]


@query("e8_column_transformer", "with m as (select (select median(year) from train) as y, (select median(label) from train) as l), r as (select coalesce(year,y)::double as year, coalesce(label,l)::double as label from train cross join m), n as (select 'year' as feature, (year-(select avg(year) from r))/(select stddev_pop(year) from r) as w from r union all select 'label', (label-(select avg(label) from r))/(select stddev_pop(label) from r) from r union all select 'venue='||venue, 1.0 from train where venue in (select venue from train where venue is not null group by 1 having count(*)>=2)) select feature, count(*) as n, round(sum(w*w),4) as squares from n group by 1")
def _(s, d):
    """Numbers imputed and scaled, categories one-hot; columns of the list that the table lacks are skipped."""
    x = fe.column_transformer(table(s, d, "train", "id", "year", "label", "venue"), "id", _NUMERIC, _CATEGORICAL)
    return x.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum(F.col("weight") * F.col("weight")), 4).alias("squares"))


_CHARS = "cw as (select id, unnest(list_filter(string_split(trim(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9]+',' ','g')),' '), lambda w: w<>'')) as w from train), cp as (select id, ' '||w||' ' as w from cw), cg as (" + " union all ".join(f"select id, unnest(list_transform(range(1,greatest(length(w)-{n}+1,1)+1), lambda i: substring(w,i,{n}))) as term from cp" for n in (3, 4, 5)) + "), ctf as (select id,term,count(*) tf from cg where length(term)>=3 group by 1,2), cvoc as (select term, count(*) df, sum(tf) total from ctf group by 1 order by total desc, term limit 3000), craw as (select ctf.id, ctf.term, (1+ln(ctf.tf))*(ln((1+(select count(*) from train))/(1+cvoc.df)::double)+1) as w from ctf join cvoc using(term)), cn as (select id, sqrt(sum(w*w)) as n from craw group by 1)"


@query("e2_e3_feature_union", f"with {_TF}, {_CHARS} select 'word:'||term as feature, count(*) as docs, round(sum(w/n),4) as total from raw join nrm using(id) group by 1 union all select 'char:'||term, count(*), round(sum(w/n),4) from craw join cn using(id) group by 1")
def _(s, d):
    """Word and character TF-IDF side by side."""
    x = table(s, d, "train", "id", "title")
    both = fe.feature_union({"word": fe.tfidf(x, "id", fe.word_grams(F.col("title")), limit=2000), "char": fe.tfidf(x, "id", fe.char_grams(F.col("title")), limit=3000)}, "id")
    return both.groupBy("feature").agg(F.count("*").alias("docs"), F.round(F.sum("weight"), 4).alias("total"))


@query("e4_test_encoding", "select p.id, round((coalesce(k.s,0)+(select avg(label) from train)*20)/(coalesce(k.n,0)+20)::double,6) as encoded from public_test p left join (select venue, sum(label) s, count(label) n from train group by 1) k on p.venue is not distinct from k.venue")
def _(s, d):
    return fe.encoding_of_train(table(s, d, "train", "venue", "label"), table(s, d, "public_test", "id", "venue"), "venue", "label").select("id", r6("encoded").alias("encoded"))


# Feature groups: the columns that each may use.
GROUPS = {"identity": ["id", "doi"], "text": ["title", "abstract"], "people": ["authors", "affiliations"], "series": ["venue", "year"], "counts": ["cited_by_count"]}


_TRAIN = ("id", "doi", "title", "authors", "venue", "year")


def _group_sql(name: str, wanted: list[str]) -> str:
    have = [c for c in wanted if c in _TRAIN]
    filled = f"round(({'+'.join(f'count({c})' for c in have)})/count(*)::double/{len(have)},6) as filled from train" if have else "null::double as filled"
    return f"select '{name}' as feature_group, {len(have)} as available, {len(wanted)} as wanted, {filled}"


@query("e13_feature_groups", " union all ".join(_group_sql(g, cs) for g, cs in GROUPS.items()))
def _(s, d):
    """Each group with the columns the table has, and how far they are filled: one pass for all groups."""
    x = table(s, d, "train")
    have = {g: [c for c in cs if c in x.columns] for g, cs in GROUPS.items()}
    filled = lambda cs: sum((F.count(c) for c in cs), F.lit(0)) / F.count("*") / len(cs) if cs else F.lit(None).cast("double")
    one = x.agg(*[r6(filled(cs)).alias(g) for g, cs in have.items()])
    entries = [F.struct(F.lit(g).alias("feature_group"), F.lit(len(have[g])).alias("available"), F.lit(len(GROUPS[g])).alias("wanted"), F.col(g).alias("filled")) for g in GROUPS]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


# ranks and audits

_PCT = "(rank() over(partition by {k} order by s1)+(count(*) over(partition by {k},s1)-1)/2.0)/count(*) over(partition by {k})"


@query("w2_rank_with_fallback", P + f", r as (select id, {_PCT.format(k='venue,year')} as a, count(*) over(partition by venue,year) as na, {_PCT.format(k='venue')} as b, count(*) over(partition by venue) as nb, {_PCT.format(k='year')} as c, count(*) over(partition by year) as nc, {_PCT.format(k='1')} as g from papers) select id, round(case when na>=5 then a when nb>=5 then b when nc>=5 then c else g end,6) as pct from r")
def _(s, d):
    """Rank by venue and year, by venue, by year, or in the whole table, by the first that has five rows."""
    return rk.rank_with_fallback(papers(s, d).select("id", "venue", "year", "s1"), "s1", [["venue", "year"], ["venue"], ["year"]], "pct").select("id", r6("pct").alias("pct"))


_FA = "coalesce(list_last(regexp_extract_all(lower(split_part(coalesce(authors,''),',',1)),'[a-z0-9]+')),'none')"


@query(
    "a12_author_risk",
    f"with {TESTS_SQL}, tr as (select {_FA} as author, count(label) as train_count, count(distinct label) as labels, min(label) as low, max(label) as high, avg(label) as mean from train group by 1), te as (select {_FA} as author, count(id) as test_count, count(*) filter(where source_split='public_test') as public_count, min(p1) as plow, max(p1) as phigh, avg(p1) as pmean from tests group by 1) select author, test_count, public_count, coalesce(train_count,0) as train_count, train_count is not null as seen, coalesce(train_count=1 and test_count>=2,false) as single, coalesce(train_count=1 and test_count>=2 and low=5,false) as single5, coalesce(train_count>=2 and labels=1 and test_count>=2,false) as pure, coalesce(labels=1 and plow=low and phigh=low,false) as matched, round(mean,6) as mean_label, round(pmean,6) as mean_pred from te left join tr using(author)",
)
def _(s, d):
    """First authors of the test splits beside what train says of them, with five flags of risk."""
    train = table(s, d, "train", "authors", "label").groupBy(t.first_author_token("authors").alias("author")).agg(F.count("label").alias("train_count"), F.count_distinct("label").alias("labels"), F.min("label").alias("low"), F.avg("label").alias("mean"))
    test = held_out(s, d).groupBy(t.first_author_token("authors").alias("author")).agg(F.count("id").alias("test_count"), F.count_if(F.col("source_split") == "public_test").alias("public_count"), F.min("p1").alias("plow"), F.max("p1").alias("phigh"), F.avg("p1").alias("pmean"))
    yes = lambda e: F.coalesce(F.expr(e), F.lit(False))
    return test.join(train, "author", "left").select(
        "author", "test_count", "public_count", F.coalesce("train_count", F.lit(0)).alias("train_count"), F.col("train_count").isNotNull().alias("seen"), yes("train_count = 1 and test_count >= 2").alias("single"), yes("train_count = 1 and test_count >= 2 and low = 5").alias("single5"),
        yes("train_count >= 2 and labels = 1 and test_count >= 2").alias("pure"), yes("labels = 1 and plow = low and phigh = low").alias("matched"), r6("mean").alias("mean_label"), r6("pmean").alias("mean_pred"),
    )


@query("a19_both_ends", P + "select id, papers.label, case when s1>=h then 'high' else 'low' end as side from papers join (select label, quantile_cont(s1,0.8) as h, quantile_cont(s1,0.2) as l from papers group by 1) q on papers.label=q.label and (s1>=h or s1<=l)")
def _(s, d):
    """The cleanest fifth of each label at either end."""
    b = papers(s, d).select("id", "label", "s1")
    q = rk.quantiles(b, "s1", {"h": 0.8, "l": 0.2}, ["label"])
    return b.join(F.broadcast(q), "label").filter("s1 >= h or s1 <= l").select("id", "label", F.when(F.expr("s1 >= h"), "high").otherwise("low").alias("side"))


_GATED = ["s1", "s4", "year", "flat"]


@query("a21_gated_spearman", P + ", x as (select id, label, s1, s4, year::double as year, 1.0::double as flat from papers) " + " union all ".join(f"select '{c}' as feature, count({c}) as n, case when count({c})>=20 and count(distinct {c})>1 then round(corr(rx,ry),6) end as rho from (select {c}, rank() over(order by {c})+(count(*) over(partition by {c})-1)/2.0 as rx, rank() over(order by label)+(count(*) over(partition by label)-1)/2.0 as ry from x where {c} is not null)" for c in _GATED))
def _(s, d):
    """Rank correlation of each feature with the label, where at least 20 values and more than one different are there."""
    x = papers(s, d).select("label", "s1", "s4", F.col("year").cast("double").alias("year"), F.lit(1.0).alias("flat"))
    out = None
    for c in _GATED:
        rows = x.select(c, "label").filter(F.col(c).isNotNull())
        ranked = rk.global_percentile_rank(rk.global_percentile_rank(rows, c, "rx"), "label", "ry")
        one = ranked.agg(F.count("*").alias("n"), F.count_distinct(c).alias("u"), F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("r")).select(F.lit(c).alias("feature"), "n", F.when((F.col("n") >= 20) & (F.col("u") > 1), r6("r")).alias("rho"))
        out = one if out is None else out.unionByName(one)
    return out


_NO_ABSTRACT = "m as (select p.*, coalesce(a.h,0) as h, least(" + ",".join(f"abs(s1-{c}::double)" for c in CUTS) + ") as g from papers p left join (select id, max(has_abstract::int) as h from abstracts_merged_v3 where source_split='train' group by 1) a using(id))"


@query("a24_missing_abstracts", P + f", {_NO_ABSTRACT} select h, count(*) as n, {MET.format(p='p1')}, count(*) filter(where g<0.05) as near, " + ", ".join(f"round(count(*) filter(where label={k})/count(*)::double,6) as share_{k}" for k in range(1, 6)) + " from m group by 1")
def _(s, d):
    """Papers with and without an abstract: label shares, agreement, and rows near a cut point."""
    a = table(s, d, "abstracts_merged_v3", "source_split", "id", "has_abstract").filter("source_split = 'train'").groupBy("id").agg(F.max(F.col("has_abstract").cast("int")).alias("h"))
    near = F.least(*[F.abs(F.col("s1") - c) for c in CUTS]) < 0.05
    shares = [r6(F.count_if(F.col("label") == k) / F.count("*")).alias(f"share_{k}") for k in range(1, 6)]
    return papers(s, d).join(a, "id", "left").withColumn("h", F.coalesce("h", F.lit(0))).groupBy("h").agg(F.count("*").alias("n"), *me.scored("label", "p1"), F.count_if(near).alias("near"), *shares)


@query("a2_distribution_by_split", f"with {TESTS_SQL} select source_split, d.label, coalesce(n,0)/t::double as share from (select unnest([1,2,3,4,5]) as label) d cross join (select source_split, count(*) as t from tests group by 1) left join (select source_split, p1 as label, count(*) as n from tests group by 1,2) using(source_split,label)")
def _(s, d):
    return domain_distribution(held_out(s, d), "p1", by=["source_split"]).select("source_split", "label", "share")


# enrichment

def _key_sql(split: str) -> str:
    doi, page = _DOI.format(c="doi"), "regexp_extract(coalesce(doi,''),'/paper/([0-9a-fA-F]{40})',1)"
    return f"case when {doi}<>'' then 'DOI:'||{doi} when {page}<>'' then 'S2:'||lower({page}) else 'TITLE:'||{split}||':'||id::varchar end"



def _lookup(split) -> F.Column:
    doi, page = t.normalize_doi("doi"), t.page_id("doi")
    return F.when(doi != "", F.concat(F.lit("DOI:"), doi)).when(page != "", F.concat(F.lit("S2:"), page)).otherwise(F.concat(F.lit("TITLE:"), split, F.lit(":"), F.col("id").cast("string")))


_USABLE = "length(trim(coalesce(abstract,'')))>30"


@query(
    "x5_merged_sources",
    f"with w as (select id, {_key_sql(chr(39) + 'train' + chr(39))} as k from train), a as (select {_key_sql('source_split')} as k, min(rec_id) as r from abstracts_merged_v3 where {_USABLE} group by 1), b as (select source_split, id, min(rec_id) as r from s2_match_abstracts where {_USABLE} group by 1,2), c as (select source_split, id, min(rec_id) as r from abstracts_merged_v3 where {_USABLE} group by 1,2) select w.id, coalesce(a.r,b.r,c.r) as rec, case when a.r is not null then 'by key' when b.r is not null then 'by match' when c.r is not null then 'by id' else 'none' end as phase from w left join a using(k) left join b on b.source_split='train' and b.id=w.id left join c on c.source_split='train' and c.id=w.id",
)
def _(s, d):
    """Abstracts in three phases: by lookup key, by title match, by id; a later phase fills what is still missing."""
    usable = F.length(F.trim(F.coalesce("abstract", F.lit("")))) > 30
    wanted = table(s, d, "train", "id", "doi").select("id", _lookup(F.lit("train")).alias("k"))
    first = table(s, d, "abstracts_merged_v3", "rec_id", "source_split", "id", "doi", "abstract").filter(usable)
    by_key = first.groupBy(_lookup(F.col("source_split")).alias("k")).agg(F.min("rec_id").alias("a"))
    by_match = table(s, d, "s2_match_abstracts", "rec_id", "source_split", "id", "abstract").filter(usable & (F.col("source_split") == "train")).groupBy("id").agg(F.min("rec_id").alias("b"))
    by_id = first.filter("source_split = 'train'").groupBy("id").agg(F.min("rec_id").alias("c"))
    out = wanted.join(by_key, "k", "left").join(by_match, "id", "left").join(by_id, "id", "left")
    value, phase = en.found_first([(name, F.col(c).isNotNull(), F.col(c)) for name, c in (("by key", "a"), ("by match", "b"), ("by id", "c"))])
    return out.select("id", value.alias("rec"), phase.alias("phase"))


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9]+',' ','g')),' '), lambda w: w<>''))"
_TOKENS = "(select id, year, unnest(" + _WORDS + ") as w from {t})"
_FIVE = (
    f"with df as (select w, count(*) as n from {_TOKENS.format(t='train')} group by 1), rare as (select id, w, n from (select t.id, w, n, row_number() over(partition by t.id order by n, w) as r from {_TOKENS.format(t='public_test')} t join df using(w)) where r<=3), "
    f"pairs as (select rare.id, t.id as train_id, sum(1.0::double/rare.n) as s from rare join {_TOKENS.format(t='train')} t using(w) group by 1,2), five as (select id, train_id, round(s,6) as score from (select *, row_number() over(partition by id order by round(s,9) desc, train_id) as r from pairs) where r<=5)"
)


def subset_sums(rows: list[np.ndarray], most: int) -> list[np.ndarray]:
    """For each array the sums of all its sets of one to ``most`` values; sets come in the same order in arrays of one length."""
    out: list = [row[:0] for row in rows]
    size = np.array([len(row) for row in rows], int)
    for m in np.unique(size[size > 0]):
        at = np.flatnonzero(size == m)
        held = np.stack([rows[i] for i in at])
        sums = np.concatenate([held[:, np.array(list(itertools.combinations(range(m), k)))].sum(2) for k in range(1, min(most, m) + 1)], 1)
        for i, one in zip(at, sums):
            out[i] = one
    return out


def search(queries: DataFrame, titles: DataFrame, most: int = 5, words: int = 3) -> DataFrame:
    """(id, train_id, score): for each query title the ``most`` titles that share its rarest ``words``, weighted by their rarity; ties go to the smaller id.

    The score says which of the rare words a title holds and nothing else. A title among the ``most`` best is therefore
    among the ``most`` smallest ids that hold all the words it shares, as any other title that holds them scores no less.
    So each set of words (the sum of their hashes) keeps that many ids, queries of the same words are searched once, and
    no frequent word meets all its titles. Marks of the words and sets that are asked for leave out most others early.
    """
    parts = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda w: w != ""))
    bag = lambda x: x.select("id", F.explode(parts).alias("w"))
    rare = rk.top_per_group(bag(queries).join(bag(titles).groupBy("w").agg(F.count("*").alias("n")), "w"), ["id"], [F.col("n"), F.col("w")], words)
    asked = cut_lineage(rare.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("w").alias("h")))).alias("rare")))
    sums = lambda kind: F.pandas_udf(lambda x: pd.Series(subset_sums(list(x), words), dtype=object), f"array<{kind}>")
    sets = asked.select("rare").distinct().select("rare", F.arrays_zip(sums("bigint")("rare.h").alias("key"), sums("double")(F.transform("rare.n", lambda n: 1.0 / n)).alias("s")).alias("sets"))
    wanted = cut_lineage(sets.select("rare", F.inline("sets").alias("key", "s")))
    known, sought = marked(asked.select(F.explode("rare.h").alias("h")).distinct()), marked(wanted.select("key").distinct())

    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        first = First(most)
        for ids, hashes in batches:
            held = subset_sums([kept(x, known) for x in hashes], words)
            n, flat = len(held), np.concatenate(held)
            at = np.flatnonzero(sought[flat & (BITS - 1)])
            row = np.repeat(np.arange(n), [len(x) for x in held])[at]
            some = first.may_stay(flat[at], ids.to_numpy()[row])
            yield pd.Series(np.split(flat[at[some]], np.searchsorted(row[some], np.arange(1, n))), dtype=object)

    ids = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    found = titles.select(F.col("id").alias("train_id"), F.explode(keys(ids, F.transform(parts, lambda w: F.xxhash64(w)))).alias("key"))
    first = rk.top_per_group(found, ["key"], [F.col("train_id")], most)
    scored = wanted.join(first, "key").groupBy("rare", "train_id").agg(F.max("s").alias("s"))
    best = rk.top_per_group(scored, ["rare"], [F.desc(F.round("s", 9)), F.col("train_id")], most)
    return asked.join(best, "rare").select("id", "train_id", r6("s").alias("score"))


@query("x4_candidates", _FIVE + " select id, train_id, score from five")
def _(s, d):
    """The five train titles that share the rarest three words of a test title: the search that a remote service would do."""
    return search(table(s, d, "public_test", "id", "title"), table(s, d, "train", "id", "title"))


_PLAIN = "trim(regexp_replace(lower(coalesce({c},'')),'[^a-z0-9]+',' ','g'))"
FOUND = 0.86


@query(
    "x1_x3_title_match",
    _FIVE + f", m as (select five.id, train_id, p.year as qy, t.year as cy, {_PLAIN.format(c='p.title')} as q, {_PLAIN.format(c='t.title')} as c from five join public_test p on p.id=five.id join train t on t.id=train_id), g as (select id, train_id, 1-levenshtein(q,c)/greatest(length(q),length(c))::double as sim, case when abs(qy-cy)<=1 then 0.05 when abs(qy-cy)<=3 then 0.02 else 0.0 end::double as bonus from m), b as (select *, row_number() over(partition by id order by round(sim+bonus,9) desc, train_id) as r from g) select id, train_id, round(sim,6) as sim, sim>={FOUND} as found from b where r=1",
)
def _(s, d):
    """The best of the five candidates of a title by edit similarity with a year bonus, and whether it counts as found."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    a, b = table(s, d, "public_test", "id", "title", "year"), table(s, d, "train", "id", "title", "year")
    near = search(a.select("id", "title"), b.select("id", "title")).select("id", "train_id")
    near = near.join(a.select("id", plain("title").alias("q"), F.col("year").alias("qy")), "id").join(b.select(F.col("id").alias("train_id"), plain("title").alias("c"), F.col("year").alias("cy")), "train_id")
    bonus = F.when(F.abs(F.col("qy") - F.col("cy")) <= 1, 0.05).when(F.abs(F.col("qy") - F.col("cy")) <= 3, 0.02).otherwise(0.0)
    near = near.withColumn("sim", 1 - edits("q", "c") / F.greatest(F.length("q"), F.length("c"))).select("id", "train_id", "sim", bonus.alias("bonus"))
    best = near.withColumn("score", F.round(F.col("sim") + F.col("bonus"), 9)).groupBy("id").agg(F.max_by(F.struct("train_id", "sim"), F.struct("score", -F.col("train_id"))).alias("b"))
    return best.select("id", "b.train_id", r6("b.sim").alias("sim"), (F.col("b.sim") >= FOUND).alias("found"))


@query(
    "x2_pair_bonus",
    f"select t.id, o.openalex_id, case when abs(t.year-o.openalex_year)<=1 then 0.05 when abs(t.year-o.openalex_year)<=3 then 0.02 else 0.0 end::double as bonus from (select id, year, {_DOI.format(c='doi')} as k from train) t join (select openalex_id, openalex_year, {_DOI.format(c='openalex_doi')} as k from openalex_title_features) o using(k) where k<>''",
)
def _(s, d):
    """The year bonus of papers and records of one DOI."""
    a = table(s, d, "train", "id", "year", "doi").select("id", "year", t.normalize_doi("doi").alias("k")).filter("k <> ''")
    b = table(s, d, "openalex_title_features", "openalex_id", "openalex_year", "openalex_doi").select("openalex_id", "openalex_year", t.normalize_doi("openalex_doi").alias("k"))
    gap = F.abs(F.col("year") - F.col("openalex_year"))
    return a.join(b, "k").select("id", "openalex_id", F.when(gap <= 1, 0.05).when(gap <= 3, 0.02).otherwise(0.0).alias("bonus"))


# folds

_SEEDS = (252, 777)
_REPEATS = ", ".join(f"f{x} as (select id, s2, label, cast((row_number() over(partition by label order by md5('{x}'||'|'||cast(id as varchar)))-1)%5 as int) as fold from papers)" for x in _SEEDS)


@query("m4_repeated_cv", P + f", {_REPEATS}, o as (" + " union all ".join(f"select a.id, b.m as x from f{x} a join (select p.fold, avg(q.label*1.0::double) as m from (select distinct fold from f{x}) p join f{x} q on q.fold<>p.fold group by 1) b using(fold)" for x in _SEEDS) + ") select id, count(*) as repeats, round(avg(x),6) as oof from o group by 1")
def _(s, d):
    """Out-of-fold means over repeats, each with the folds of its own seed; the model of a fold is the mean of the other folds."""
    base, out = papers(s, d).select("id", "label"), None
    for seed in _SEEDS:
        rows = with_folds(base, seed=seed)
        per = rows.groupBy("fold").agg(F.sum("label").alias("s"), F.count("*").alias("n"))
        total = per.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
        model = per.crossJoin(F.broadcast(total)).select("fold", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("x"))
        one = rows.join(F.broadcast(model), "fold").select("id", "x")
        out = one if out is None else out.union(one)
    return out.groupBy("id").agg(F.count("*").alias("repeats"), r6(F.avg("x")).alias("oof"))


PARTNERS = (1, 7, 19)
_PLACED = "pl as (select fold, label, s1, row_number() over(partition by fold order by md5('pair|'||id::varchar), id)-1 as r, count(*) over(partition by fold) as n from folds)"


@query("j15_m20_pair_loss", PF + f", {_PLACED} select a.fold, count(*) as n, round(avg(ln(1+exp(-sign(a.label-b.label)*(a.s1-b.s1)))*abs(a.label-b.label)),6) as loss from pl a cross join (select unnest([{','.join(map(str, PARTNERS))}]) as o) join pl b on b.fold=a.fold and b.r=(a.r+o)%a.n where a.label<>b.label group by 1")
def _(s, d):
    """Ranking loss over pairs of different labels inside a fold: each row meets the same number of partners, so pairs grow with the rows."""
    b = with_folds(papers(s, d).select("id", "label", "s1"))
    placed = rk.hashed_rank(b, ["fold"], F.md5(F.concat(F.lit("pair|"), F.col("id").cast("string")))).withColumn("r", F.col("rank") - 1)
    size = placed.groupBy("fold").agg(F.count("*").alias("n"))
    left = placed.join(F.broadcast(size), "fold").select("fold", "label", "s1", F.col("n"), F.col("r"), F.explode(F.array(*map(F.lit, PARTNERS))).alias("o"))
    left = left.select("fold", "label", "s1", ((F.col("r") + F.col("o")) % F.col("n")).alias("r"))
    pairs = left.join(placed.select("fold", "r", F.col("label").alias("other"), F.col("s1").alias("t1")), ["fold", "r"]).filter("label <> other")
    loss = F.log1p(F.exp(-F.signum(F.col("label") - F.col("other")) * (F.col("s1") - F.col("t1")))) * F.abs(F.col("label") - F.col("other"))
    return pairs.groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg(loss)).alias("loss"))
