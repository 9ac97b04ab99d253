"""Queries of profiles, windows, sorts, set operations, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import profile as pr
from folioscope.operators import ranking as rk
from folioscope.plans.base import CUTS, FOLDS_SQL, LONG_SQL, PAPERS_SQL, clip, long_scores, papers
from folioscope.sources.tables import require_columns, table

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


def r6(c):
    return F.round(c, 6)


P = f"with {PAPERS_SQL} "
_DOMAIN = "(select unnest([1,2,3,4,5])::int as label)"

# expressions


@query("c30_safe_cast", "select id, try_cast(regexp_extract(coalesce(doi,''),'\\.(\\d{4})\\.',1) as int) as doi_year from train")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "train").select("id", F.regexp_extract(F.coalesce("doi", F.lit("")), r"\.(\d{4})\.", 1).try_cast("int").alias("doi_year"))


@query("c31_c32_counts", "select openalex_id, case when cited_by_count is not null then round(ln(1+greatest(cited_by_count,0)),6) end as log_cited, greatest(2026-openalex_year+1,1) as age, round(cited_by_count/greatest(2026-openalex_year+1,1)::double,6) as velocity from openalex_title_features")
def _(s, d):
    age = F.greatest(2026 - F.col("openalex_year") + 1, F.lit(1))
    logged = F.when(F.col("cited_by_count").isNotNull(), F.log1p(F.greatest(F.col("cited_by_count"), F.lit(0))))
    return table(s, d, "openalex_title_features").select("openalex_id", r6(logged).alias("log_cited"), age.alias("age"), r6(F.try_divide(F.col("cited_by_count"), age)).alias("velocity"))


@query(
    "c33_row_statistics",
    "select rec_id, list_max(v) as top, round(list_avg(v),6) as mean, round(list_stddev_samp(v),6) as std, cast(len(v) as int) as n from (select rec_id, list_filter([s2_citation_count::double, oa_cited_by_count::double, abstract_len::double], lambda x: x is not null) as v from abstracts_merged_v3)",
)
def _(s, d):
    v = F.filter(F.array(F.col("s2_citation_count").cast("double"), F.col("oa_cited_by_count").cast("double"), F.col("abstract_len").cast("double")), lambda x: x.isNotNull())
    base = table(s, d, "abstracts_merged_v3", "rec_id", "s2_citation_count", "oa_cited_by_count", "abstract_len").withColumn("v", v)
    base = base.withColumn("mean", F.try_divide(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), F.size("v")))
    square = F.aggregate(F.transform("v", lambda x: (x - F.col("mean")) * (x - F.col("mean"))), F.lit(0.0), lambda a, x: a + x)
    return base.select("rec_id", F.array_max("v").alias("top"), r6("mean").alias("mean"), r6(F.sqrt(F.try_divide(square, F.nullif(F.size("v") - 1, F.lit(0))))).alias("std"), F.size("v").alias("n"))


@query("c34_ratio", "select openalex_id, round(cited_by_count/nullif(referenced_works_count,0)::double,6) as ratio from openalex_title_features")
def _(s, d):
    return table(s, d, "openalex_title_features").select("openalex_id", r6(F.try_divide(F.col("cited_by_count"), F.nullif("referenced_works_count", F.lit(0)))).alias("ratio"))


@query("c35_flag_sum", "select openalex_id, coalesce(title_search_found,false)::int+coalesce(is_retracted,false)::int+(openalex_doi is not null)::int as flags from openalex_title_features")
def _(s, d):
    flags = F.coalesce("title_search_found", F.lit(False)).cast("int") + F.coalesce("is_retracted", F.lit(False)).cast("int") + F.col("openalex_doi").isNotNull().cast("int")
    return table(s, d, "openalex_title_features").select("openalex_id", flags.alias("flags"))


@query("c38_has_abstract", "select rec_id, length(coalesce(abstract,''))>30 as has_text from abstracts_merged_v3")
def _(s, d):
    return table(s, d, "abstracts_merged_v3", "rec_id", "abstract").select("rec_id", (F.length(F.coalesce("abstract", F.lit(""))) > 30).alias("has_text"))


@query("c39_c40_clip_round", P + "select id, round(s1,6) as clipped, cast(least(greatest(round_even(s1,0),1),5) as int) as rounded from papers")
def _(s, d):
    return papers(s, d).select("id", r6("s1").alias("clipped"), F.least(F.greatest(F.bround("s1"), F.lit(1)), F.lit(5)).cast("int").alias("rounded"))


@query("c41_rule_bins", P + "select id, case when g>=2 then 5 when g=1 then 4 when g=0 then 3 when g=-1 then 2 else 1 end as bin from (select id, p1-p4 as g from papers)")
def _(s, d):
    g = F.col("p1") - F.col("p4")
    return papers(s, d).select("id", F.when(g >= 2, 5).when(g == 1, 4).when(g == 0, 3).when(g == -1, 2).otherwise(1).alias("bin"))


_INV = "select doc_id, w, i from (select doc_id, unnest(ws) as w, unnest(range(1,len(ws)+1)) as i from (select doc_id, string_split(trim(regexp_replace(coalesce(text,''),'\\s+',' ','g'),' '),' ') as ws from documents))"


@query("c42_inverted_index", "select doc_id, md5(trim(regexp_replace(coalesce(text,''),'\\s+',' ','g'),' ')) as h from documents")
def _(s, d):
    """A text rebuilt from word to positions: the index is made first, then turned back."""
    words = table(s, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split(t.squeeze("text"), " ")).alias("pos", "word"))
    index = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("positions"))
    back = index.select("doc_id", F.explode("positions").alias("pos"), "word")
    return back.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x.word), " ")).alias("h"))


@query("c43_c44_json", "select event_id, cast(json_extract_string(props,'$.k') as int) as k, '{\"k\":'||json_extract_string(props,'$.k')||'}' as js from events")
def _(s, d):
    parsed = F.from_json("props", "k int")
    return table(s, d, "events", "event_id", "props").select("event_id", parsed.k.alias("k"), F.to_json(F.struct(parsed.k.alias("k"))).alias("js"))


@query("c45_xml_entries")
def _(s, d):
    """Entries built from papers and read back with a schema."""
    entry = F.concat(F.lit("<entry><title>"), t.normalize_words("title"), F.lit("</title><year>"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("</year></entry>"))
    parsed = F.from_xml(entry, "title string, year int")
    return table(s, d, "train", "id", "title", "year").select("id", parsed.title.alias("title"), parsed.year.alias("year"))


_SM = "select id, list_transform([s1,s2,s3,s4], lambda x: exp(x - greatest(s1,s2,s3,s4))) as e from papers"


@query("c46_c47_softmax", P + f"select id, round(list_sum(list_transform([1,2,3,4], lambda i: i*e[i]/list_sum(e))),6) as expected, round(list_max(e)/list_sum(e),6) as top, cast(list_position(e,list_max(e)) as int) as arg from ({_SM})")
def _(s, d):
    x = F.array("s1", "s2", "s3", "s4")
    e = papers(s, d).select("id", F.transform(x, lambda v: F.exp(v - F.array_max(x))).alias("e")).withColumn("z", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    expected = F.aggregate(F.transform("e", lambda v, i: (i + 1) * v / F.col("z")), F.lit(0.0), lambda a, v: a + v)
    return e.select("id", r6(expected).alias("expected"), r6(F.array_max("e") / F.col("z")).alias("top"), F.array_position("e", F.array_max("e")).cast("int").alias("arg"))


@query("c48_row_z", P + "select id, round((s1-m)/coalesce(nullif(sd,0),1),6) as z1 from (select id, s1, list_avg([s1,s2,s3,s4]) as m, list_stddev_pop([s1,s2,s3,s4]) as sd from papers)")
def _(s, d):
    x = F.array("s1", "s2", "s3", "s4")
    b = papers(s, d).withColumn("m", F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / 4)
    b = b.withColumn("sd", F.sqrt(F.aggregate(F.transform(x, lambda v: (v - F.col("m")) * (v - F.col("m"))), F.lit(0.0), lambda a, v: a + v) / 4))
    return b.select("id", r6((F.col("s1") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("z1"))


@query("c49_threshold_margin", P + "select id, round(least(abs(s1-1.7::double),abs(s1-2.4::double),abs(s1-3.0::double),abs(s1-3.8::double)),6) as margin from papers")
def _(s, d):
    cuts = F.array(*[F.lit(c) for c in CUTS])
    return papers(s, d).select("id", r6(F.array_min(F.transform(cuts, lambda c: F.abs(F.col("s1") - c)))).alias("margin"))


@query("c50_step_proposal", P + "select id, cast(least(greatest(p1+sign(p2-p1),1),5) as int) as proposed, greatest(p1-1,1) as demoted from papers")
def _(s, d):
    return papers(s, d).select("id", F.least(F.greatest(F.col("p1") + F.signum(F.col("p2") - F.col("p1")), F.lit(1)), F.lit(5)).cast("int").alias("proposed"), F.greatest(F.col("p1") - 1, F.lit(1)).alias("demoted"))


# filters


@query("f1_f4_filters", P + "select id, label from papers where (coalesce(doi,'')='' or label in (1,5)) and year between 2018 and 2022 and (p1>=p2 or p3<>4)")
def _(s, d):
    key = (F.coalesce("doi", F.lit("")) == "") | F.col("label").isin(1, 5)
    return papers(s, d).filter(key & F.col("year").between(2018, 2022) & ((F.col("p1") >= F.col("p2")) | (F.col("p3") != 4))).select("id", "label")


@query("f5_having", "select lower(title) as title_key, count(*) as n from train group by 1 having count(*)>1")
def _(s, d):
    return table(s, d, "train", "title").groupBy(F.lower("title").alias("title_key")).agg(F.count("*").alias("n")).filter("n > 1")


@query("f6_null_check", P + "select count(*) as n, count(*) filter(where s1 is null or isnan(s1)) as missing from papers")
def _(s, d):
    return papers(s, d).agg(F.count("*").alias("n"), F.count_if(F.isnan("s1") | F.col("s1").isNull()).alias("missing"))


@query("f7_u4_id_sets", "select count(*) filter(where a and b) as both_sides, count(*) filter(where a and not b) as only_train, count(*) filter(where b and not a) as only_test from (select id, bool_or(a) as a, bool_or(b) as b from (select id, true as a, false as b from train union all select id, false, true from public_test) group by id)")
def _(s, d):
    both = table(s, d, "train", "id").withColumns({"a": F.lit(1), "b": F.lit(0)}).union(table(s, d, "public_test", "id").withColumns({"a": F.lit(0), "b": F.lit(1)}))
    each = both.groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("both_sides"), F.count_if(F.expr("a = 1 and b = 0")).alias("only_train"), F.count_if(F.expr("b = 1 and a = 0")).alias("only_test"))


# aggregations


@query("a1_value_counts", "select label as value, count(*) as n, round(100*count(*)/sum(count(*)) over()::double,2) as percent from train group by label")
def _(s, d):
    return pr.value_counts(table(s, d, "train", "label"), "label")


@query("a2_domain_distribution", P + f"select d.label, coalesce(n/t::double,0) as share from {_DOMAIN} d left join (select p1 as label, count(*) as n from papers group by 1) using(label) cross join (select count(*) as t from papers)")
def _(s, d):
    return pr.domain_distribution(papers(s, d), "p1").select("label", "share")


@query("a3_r7_distribution_l1", P + f"select round(sum(abs(coalesce(a.n/t::double,0)-coalesce(b.n/t::double,0))),6) as l1 from {_DOMAIN} d left join (select p1 as label,count(*) n from papers group by 1) a using(label) left join (select label,count(*) n from papers group by 1) b using(label) cross join (select count(*) t from papers)")
def _(s, d):
    b = papers(s, d)
    return pr.distribution_distance(pr.domain_distribution(b, "p1"), pr.domain_distribution(b, "label")).select(r6("l1").alias("l1"))


@query("a4_group_stats", "select venue, year, count(label) as n, round(avg(label),6) as mean, round(median(label),6) as median, round(stddev_samp(label),6) as std from train group by 1,2")
def _(s, d):
    return pr.group_stats(table(s, d, "train", "venue", "year", "label"), ["venue", "year"], "label").select("venue", "year", "n", r6("mean").alias("mean"), r6("median").alias("median"), r6("std").alias("std"))


@query("a5_group_values", "select lower(title) as k, count(*) as n, count(distinct label) as n_unique, string_agg(distinct label::varchar, ',' order by label::varchar) as \"values\" from train group by 1")
def _(s, d):
    return pr.group_values(table(s, d, "train", "title", "label").withColumn("k", F.lower("title")), ["k"], "label")


_COLS = ["title", "venue", "year", "authors", "doi"]


@query("a6_missing_profile", " union all ".join(f"select '{c}' as \"column\", count(*) filter(where {c} is null) as missing, count(*) filter(where {c} is null or trim({c}::varchar)='') as blank, round(100*count(*) filter(where {c} is null or trim({c}::varchar)='')/count(*)::double,2) as percent from train" for c in _COLS))
def _(s, d):
    return pr.missing_profile(require_columns(table(s, d, "train"), *_COLS), _COLS)


@query(
    "a7_split_overlap",
    "select count(*) as n, count(*) filter(where lower(title) in (select lower(title) from train)) as title_seen, count(*) filter(where venue not in (select venue from train where venue is not null)) as venue_unseen from public_test",
)
def _(s, d):
    seen = table(s, d, "train", "title").select(F.lower("title").alias("k")).distinct().withColumn("t", F.lit(1))
    venues = table(s, d, "train", "venue").filter("venue is not null").distinct().withColumn("v", F.lit(1))
    p = table(s, d, "public_test", "title", "venue").withColumn("k", F.lower("title")).join(seen, "k", "left").join(venues, "venue", "left")
    return p.agg(F.count("*").alias("n"), F.count_if(F.expr("t = 1")).alias("title_seen"), F.count_if(F.expr("venue is not null and v is null")).alias("venue_unseen"))


def _flags():
    return {g: t.pattern_flag("title", p) for g, p in t.KEYWORD_GROUPS.items()}


def _flag_sql(by: str = "") -> str:
    pick = f"{by}," if by else ""
    parts = " union all ".join(f"select {pick} '{g}' as flag, regexp_matches(coalesce(title,''),'(?i){'|'.join(p)}') as o, label from train" for g, p in t.KEYWORD_GROUPS.items())
    return f"select {pick} flag, count(*) filter(where o) as n_with, count(*) filter(where not o) as n_without, round(avg(label) filter(where o),6) as mean_with, round(avg(label) filter(where not o),6) as mean_without, round(avg(label) filter(where o)-avg(label) filter(where not o),6) as delta, round(avg((label=5)::int) filter(where o),6) as share_5_with from ({parts}) group by all"


def _rounded_contrast(df, by=()):
    return df.select(*by, "flag", "n_with", "n_without", r6("mean_with").alias("mean_with"), r6("mean_without").alias("mean_without"), r6("delta").alias("delta"), r6("share_5_with").alias("share_5_with"))


@query("a8_contrast", _flag_sql())
def _(s, d):
    return _rounded_contrast(pr.contrast(table(s, d, "train", "title", "label"), _flags(), "label"))


@query("a8_contrast_by_year", _flag_sql("year"))
def _(s, d):
    return _rounded_contrast(pr.contrast(table(s, d, "train", "title", "label", "year"), _flags(), "label", by=["year"]), ("year",))


@query("a9_missing_authors", "select count(*) filter(where o) as n_with, count(*) filter(where not o) as n_without, round(avg(label) filter(where o),6) as mean_with, round(avg(label) filter(where not o),6) as mean_without from (select label, authors is null or trim(authors)='' as o from train)")
def _(s, d):
    c = pr.contrast(table(s, d, "train", "authors", "label"), {"missing": F.col("authors").isNull() | (F.trim("authors") == "")}, "label")
    return c.select("n_with", "n_without", r6("mean_with").alias("mean_with"), r6("mean_without").alias("mean_without"))


_FA = "coalesce(list_last(regexp_extract_all(lower(split_part(coalesce(authors,''),',',1)),'[a-z0-9]+')),'none')"


@query("a10_author_coverage", f"with st as (select {_FA} as a, count(*) n, avg(label) m from train group by 1) select count(*) as rows_, count(n) as matched, count(*) filter(where n=1) as single, round(avg(m),6) as mean_matched from (select {_FA} as a from public_test) left join st using(a)")
def _(s, d):
    stats = table(s, d, "train", "authors", "label").groupBy(t.first_author_token("authors").alias("a")).agg(F.count("*").alias("n"), F.avg("label").alias("m"))
    p = table(s, d, "public_test", "authors").select(t.first_author_token("authors").alias("a")).join(stats, "a", "left")
    return p.agg(F.count("*").alias("rows_"), F.count("n").alias("matched"), F.count_if(F.expr("n = 1")).alias("single"), r6(F.avg("m")).alias("mean_matched"))


@query("a11_keyword_coverage", " union all ".join(f"select '{s}' as source_split, '{g}' as flag, round(avg(regexp_matches(coalesce(title,''),'(?i){'|'.join(p)}')::int),6) as share, sum(regexp_matches(coalesce(title,''),'(?i){'|'.join(p)}')::int)::bigint as n from {s}" for s in ("train", "public_test", "private_test") for g, p in t.KEYWORD_GROUPS.items()))
def _(s, d):
    from folioscope.operators.enrich import stacked

    rows = stacked({n: table(s, d, n, "title") for n in ("train", "public_test", "private_test")}).select("source_split", *[c.alias(g) for g, c in _flags().items()])
    return rows.unpivot(["source_split"], list(t.KEYWORD_GROUPS), "flag", "on").groupBy("source_split", "flag").agg(r6(F.avg("on")).alias("share"), F.sum("on").alias("n"))


@query(
    "a12_author_audit",
    P + f", a as (select {_FA} as author, label, p1 from papers), g as (select author, count(*) n, avg(label) y, avg(p1) p, avg(abs(label-p1)) e from a group by 1), w as (select avg(label) y, avg(abs(label-p1)) e from a) select author, n, round(g.y,6) as mean_label, round(g.p,6) as mean_pred, round(g.e,6) as error, (n<3)::int+(g.e>w.e)::int+(abs(g.y-g.p)>0.5)::int+(abs(g.y-w.y)>1)::int as risk from g cross join w",
)
def _(s, d):
    a = papers(s, d).select(t.first_author_token("authors").alias("author"), "label", "p1")
    err = F.avg(F.abs(F.col("label") - F.col("p1")))
    g = a.groupBy("author").agg(F.count("*").alias("n"), F.avg("label").alias("y"), F.avg("p1").alias("p"), err.alias("e"))
    w = a.agg(F.avg("label").alias("wy"), err.alias("we"))
    x = g.crossJoin(F.broadcast(w))
    risk = (F.col("n") < 3).cast("int") + (F.col("e") > F.col("we")).cast("int") + (F.abs(F.col("y") - F.col("p")) > 0.5).cast("int") + (F.abs(F.col("y") - F.col("wy")) > 1).cast("int")
    return x.select("author", "n", r6("y").alias("mean_label"), r6("p").alias("mean_pred"), r6("e").alias("error"), risk.alias("risk"))


@query("a13_pivot_counts", "select year, " + ", ".join(f"count(*) filter(where label={k}) as \"{k}\"" for k in range(1, 6)) + " from train group by 1")
def _(s, d):
    return pr.pivot_counts(table(s, d, "train", "year", "label"), "year", "label", [1, 2, 3, 4, 5])


@query("a14_count_map", "select year, string_agg(label::varchar||':'||n::varchar, ',' order by label::varchar) as counts from (select year,label,count(*) n from train group by 1,2) group by 1")
def _(s, d):
    return pr.count_map(table(s, d, "train", "year", "label"), ["year"], "label")


@query("a15_coverage", "select source_split, count(*) as n, sum(has_abstract::int)::bigint as found, round(avg(has_abstract::int),6) as share from abstracts_merged_v3 group by 1")
def _(s, d):
    f = F.col("has_abstract").cast("int")
    return table(s, d, "abstracts_merged_v3", "source_split", "has_abstract").groupBy("source_split").agg(F.count("*").alias("n"), F.sum(f).alias("found"), r6(F.avg(f)).alias("share"))


@query("a16_describe", "select count(abstract_len) as n, round(avg(abstract_len),6) as mean, round(stddev_samp(abstract_len),6) as std, min(abstract_len) as min, quantile_cont(abstract_len,0.25) as q25, quantile_cont(abstract_len,0.5) as q50, quantile_cont(abstract_len,0.75) as q75, max(abstract_len) as max from abstracts_merged_v3")
def _(s, d):
    return pr.describe(table(s, d, "abstracts_merged_v3", "abstract_len"), "abstract_len").withColumns({"mean": r6("mean"), "std": r6("std")})


_EDGES = [0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.01]


@query("a17_histogram", " union all ".join(f"select {i} as bucket, count(*) filter(where oat_match_score>={lo} and oat_match_score<{hi}) as n from abstracts_merged_v3" for i, (lo, hi) in enumerate(zip(_EDGES, _EDGES[1:]))))
def _(s, d):
    return pr.histogram(table(s, d, "abstracts_merged_v3", "oat_match_score"), "oat_match_score", _EDGES)


_STOP = ",".join(f"'{w}'" for w in t.STOP_WORDS)


@query(
    "a18_lift",
    f"with b as (select id, label, list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(title,'')),'[^a-z]+',' ','g')),' '), lambda w: length(w)>=3 and w not in ({_STOP}))) as ws from train), e as (select label, unnest(ws) as token from b), c as (select label, token, count(*) n from e group by 1,2), a as (select token, sum(n) n from c group by 1 having sum(n)>=6), z as (select label, count(*) s from b group by 1) select c.label, c.token, c.n, round(c.n/z.s::double-a.n/(select count(*) from b)::double,6) as lift from c join a using(token) join z using(label)",
)
def _(s, d):
    return pr.lift(table(s, d, "train", "id", "title", "label"), "id", t.tokens("title"), "label").withColumn("lift", r6("lift"))


@query("a19_cleanest", P + "select id, p.label from papers p join (select label, quantile_cont(s1,0.8) as q from papers group by 1) q on p.label=q.label and p.s1>=q.q")
def _(s, d):
    b = papers(s, d).select("id", "label", "s1")
    q = rk.quantiles(b, "s1", {"q": 0.8}, ["label"])
    return b.join(F.broadcast(q), "label").filter("s1 >= q").select("id", "label")


@query("a20_correlation", P + "select round(corr(s1,s2),6) as c12, round(corr(s1,s3),6) as c13, round(corr(s1,s4),6) as c14, round(corr(s2,s3),6) as c23, round(corr(s2,s4),6) as c24, round(corr(s3,s4),6) as c34 from papers")
def _(s, d):
    return papers(s, d).agg(*[r6(F.corr(f"s{i}", f"s{j}")).alias(f"c{i}{j}") for i in range(1, 5) for j in range(i + 1, 5)])


@query("a21_spearman", P + ", r as (select (rank() over(order by s1)+(count(*) over(partition by s1)-1)/2.0) as x, (rank() over(order by label)+(count(*) over(partition by label)-1)/2.0) as y from papers) select round(corr(x,y),6) as rho, count(*) as n from r")
def _(s, d):
    b = papers(s, d).select("id", "s1", "label")
    ranked = rk.global_percentile_rank(rk.global_percentile_rank(b, "s1", "x"), "label", "y")
    return ranked.agg(r6(F.corr("x", "y")).alias("rho"), F.count("*").alias("n"))


_CH = "count(*) filter(where p1<>p2) as changed, count(*) filter(where abs(label-p2)<abs(label-p1)) as improved, count(*) filter(where abs(label-p2)>abs(label-p1)) as worsened, round(avg(abs(label-p2)-abs(label-p1)),6) as delta, count(*) filter(where p2>p1 and label<=2) as risky, count(*) filter(where p2<p1 and label=5) as demoted_core"


@query("a22_g7_change_summary", P + f"select {_CH}, count(*) filter(where id%10=0 and p2=1 and p1<>1) as forbidden from papers")
def _(s, d):
    e1, e2 = F.abs(F.col("label") - F.col("p1")), F.abs(F.col("label") - F.col("p2"))
    return papers(s, d).agg(
        F.count_if(F.expr("p1 <> p2")).alias("changed"), F.count_if(e2 < e1).alias("improved"), F.count_if(e2 > e1).alias("worsened"), r6(F.avg(e2 - e1)).alias("delta"),
        F.count_if(F.expr("p2 > p1 and label <= 2")).alias("risky"), F.count_if(F.expr("p2 < p1 and label = 5")).alias("demoted_core"), F.count_if(F.expr("id % 10 = 0 and p2 = 1 and p1 <> 1")).alias("forbidden"),
    )


@query("a23_g9_diff", P + "select p1, p2, count(*) as n, round(avg(s2-s1),6) as shift from papers where p1<>p2 group by 1,2")
def _(s, d):
    return papers(s, d).filter("p1 <> p2").groupBy("p1", "p2").agg(F.count("*").alias("n"), r6(F.avg(F.col("s2") - F.col("s1"))).alias("shift"))


@query("a24_missing_impact", P + ", m as (select p.*, coalesce(a.h,0) as h, least(abs(s1-1.7::double),abs(s1-2.4::double),abs(s1-3.0::double),abs(s1-3.8::double)) as g from papers p left join (select id, max(has_abstract::int) as h from abstracts_merged_v3 where source_split='train' group by 1) a using(id)) select h, count(*) as n, round(avg(abs(label-p1)),6) as mae, count(*) filter(where g<0.05::double) as near from m group by 1")
def _(s, d):
    a = table(s, d, "abstracts_merged_v3", "source_split", "id", "has_abstract").filter("source_split = 'train'").groupBy("id").agg(F.max(F.col("has_abstract").cast("int")).alias("h"))
    near = F.least(*[F.abs(F.col("s1") - c) for c in CUTS]) < 0.05
    return papers(s, d).join(a, "id", "left").withColumn("h", F.coalesce("h", F.lit(0))).groupBy("h").agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("label") - F.col("p1")))).alias("mae"), F.count_if(near).alias("near"))


@query("a25_mean_by_label", P + "select label, round(avg(s1),6) as s1, round(avg(s2),6) as s2 from papers group by 1")
def _(s, d):
    return papers(s, d).groupBy("label").agg(r6(F.avg("s1")).alias("s1"), r6(F.avg("s2")).alias("s2"))


# windows


@query("w1_global_rank", "select openalex_id, case when fwci is null or isnan(fwci) then null else round((rank() over(order by case when isnan(fwci) then null else fwci end)+(count(*) over(partition by case when isnan(fwci) then null else fwci end)-1)/2.0 - (select count(*) from openalex_title_features where fwci is null or isnan(fwci))*0)/(select count(*) from openalex_title_features where fwci is not null and not isnan(fwci)),6) end as pct from openalex_title_features")
def _(s, d):
    b = table(s, d, "openalex_title_features", "openalex_id", "fwci").withColumn("fwci", F.when(~F.isnan("fwci"), F.col("fwci")))
    return rk.global_percentile_rank(b, "fwci", "pct").select("openalex_id", r6("pct").alias("pct"))


@query("w2_group_rank", "select event_id, round((rank() over(partition by event_type order by value)+(count(*) over(partition by event_type,value)-1)/2.0)/count(value) over(partition by event_type),6) as pct from events")
def _(s, d):
    return rk.percentile_rank(table(s, d, "events", "event_id", "event_type", "value"), "value", ["event_type"], "pct").select("event_id", r6("pct").alias("pct"))


@query("w3_report_position", "select venue, n, cast(row_number() over(order by n desc, venue) as int) as pos from (select coalesce(venue,'') as venue, count(*) as n from train group by 1)")
def _(s, d):
    report = table(s, d, "train", "venue").groupBy(F.coalesce("venue", F.lit("")).alias("venue")).agg(F.count("*").alias("n"))
    return rk.report_position(report, [F.desc("n"), F.col("venue")], "pos")


@query("w4_s10_keep_last", "select source_split, id, rec_id, batch_no from (select *, row_number() over(partition by source_split,id order by batch_no desc, rec_id desc) as r from s2_match_abstracts) where r=1")
def _(s, d):
    return rk.keep_last(table(s, d, "s2_match_abstracts", "source_split", "id", "rec_id", "batch_no"), ["source_split", "id"], ["batch_no", "rec_id"])


@query("w5_best_candidate", "select source_split, id, rec_id from (select *, row_number() over(partition by source_split,id order by match_score desc, rec_id) as r from s2_match_abstracts where match_score is not null and not isnan(match_score)) where r=1")
def _(s, d):
    b = table(s, d, "s2_match_abstracts", "source_split", "id", "rec_id", "match_score").filter("match_score is not null and not isnan(match_score)")
    return b.groupBy("source_split", "id").agg(F.max_by("rec_id", F.struct("match_score", -F.col("rec_id"))).alias("rec_id"))


@query("w6_top_per_label", P + "select id, label from (select id, label, row_number() over(partition by label order by s1 desc, id) as r from papers) where r<=5")
def _(s, d):
    return rk.top_per_group(papers(s, d).select("id", "label", "s1"), ["label"], [F.desc("s1"), F.col("id")], 5).select("id", "label")


# sorts and sets


@query("o1_o2_winners", P + "select id, label, round(s1,6) as s1 from papers order by label desc, s1, id limit 10")
def _(s, d):
    return papers(s, d).orderBy(F.desc("label"), "s1", "id").limit(10).select("id", "label", r6("s1").alias("s1"))


@query("o3_priority_top", P + "select id from papers where p1<>p2 order by abs(s1-s2) desc, id limit 20")
def _(s, d):
    return papers(s, d).filter("p1 <> p2").orderBy(F.desc(F.abs(F.col("s1") - F.col("s2"))), "id").limit(20).select("id")


@query("o4_seeded_sample", "select id from train order by md5('7|'||id::varchar), id limit 50")
def _(s, d):
    return table(s, d, "train", "id").orderBy(F.md5(F.concat(F.lit("7|"), F.col("id").cast("string"))), "id").limit(50)


@query("u1_s5_stacked", "select 'train' as source_split, id, title, label from train union all select 'public_test', id, title, null from public_test union all select 'private_test', id, title, null from private_test")
def _(s, d):
    from folioscope.operators.enrich import stacked

    return stacked({"train": table(s, d, "train", "id", "title", "label"), "public_test": table(s, d, "public_test", "id", "title"), "private_test": table(s, d, "private_test", "id", "title")}).select("source_split", "id", "title", "label")


@query("u2_difference", "select distinct venue from public_test except select venue from train")
def _(s, d):
    return table(s, d, "public_test", "venue").distinct().exceptAll(table(s, d, "train", "venue").distinct())


@query("s22_experiment_id", "select id, substring(sha1(coalesce(venue,'')||'|'||coalesce(year::varchar,'')||'|'||label::varchar),1,8) as experiment from train")
def _(s, d):
    parts = [F.coalesce("venue", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.col("label").cast("string")]
    return table(s, d, "train", "id", "venue", "year", "label").select("id", F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8).alias("experiment"))
