"""Queries of joins, features, folds, metrics, thresholds, blends, gates, matching and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import enrich as en
from folioscope.operators import features as fe
from folioscope.operators import metrics as me
from folioscope.operators import ordinal as od
from folioscope.plans.base import CUTS, FOLDS_SQL, LONG_SQL, PAPERS_SQL, clip, long_scores, papers, with_folds
from folioscope.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
P = f"with {PAPERS_SQL} "
PL = f"with {PAPERS_SQL}, {LONG_SQL} "
PF = f"with {PAPERS_SQL}, {FOLDS_SQL} "


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


_DOI = "(case when regexp_replace(lower(trim(coalesce({c},''))),'^(?:https?://(?:dx\\.)?doi\\.[a-z]+/|doi:\\s*)','') like '10.%' then regexp_replace(lower(trim(coalesce({c},''))),'^(?:https?://(?:dx\\.)?doi\\.[a-z]+/|doi:\\s*)','') else '' end)"


def _oa(s, d):
    o = table(s, d, "openalex_title_features", "openalex_id", "openalex_doi", "cited_by_count").withColumn("doi_norm", t.normalize_doi("openalex_doi")).filter("doi_norm != ''")
    return o.groupBy("doi_norm").agg(F.min_by("openalex_id", "openalex_id").alias("openalex_id"), F.min_by("cited_by_count", "openalex_id").alias("cited_by_count"))


_OA = f"(select doi_norm, min(openalex_id) as openalex_id, arg_min(cited_by_count, openalex_id) as cited_by_count from (select *, {_DOI.format(c='openalex_doi')} as doi_norm from openalex_title_features) where doi_norm<>'' group by 1)"


@query("j1_j3_left_join", f"select t.id, o.openalex_id as oa_openalex_id, o.cited_by_count as oa_cited_by_count from (select id, {_DOI.format(c='doi')} as k from train) t left join {_OA} o on t.k=o.doi_norm")
def _(s: SparkSession, d: str) -> DataFrame:
    side = en.prefixed_columns(_oa(s, d), ["doi_norm"], "oa_")
    return table(s, d, "train", "id", "doi").withColumn("doi_norm", t.normalize_doi("doi")).join(side, "doi_norm", "left").select("id", "oa_openalex_id", "oa_cited_by_count")


@query("j2_composite_join", "select a.rec_id, m.rec_id as other_rec, m.found from abstracts_merged_v3 a left join s2_match_abstracts m on a.source_split=m.source_split and a.id=m.id")
def _(s, d):
    m = table(s, d, "s2_match_abstracts", "source_split", "id", "rec_id", "found").withColumnRenamed("rec_id", "other_rec")
    return table(s, d, "abstracts_merged_v3", "source_split", "id", "rec_id").join(m, ["source_split", "id"], "left").select("rec_id", "other_rec", "found")


@query("j4_suffix_join", "select a.source_split, a.id, a.abstract_len as abstract_len_x, length(m.abstract)::int as abstract_len_y from abstracts_merged_v3 a join s2_match_abstracts m using(source_split,id) where m.abstract is not null")
def _(s, d):
    m = table(s, d, "s2_match_abstracts", "source_split", "id", "abstract").filter("abstract is not null").select("source_split", "id", F.length("abstract").alias("abstract_len_y"))
    return table(s, d, "abstracts_merged_v3", "source_split", "id", "abstract_len").withColumnRenamed("abstract_len", "abstract_len_x").join(m, ["source_split", "id"]).select("source_split", "id", "abstract_len_x", "abstract_len_y")


@query("j5_null_safe_join", "select a.id, b.n from train a left join (select venue, authors, year, count(*) as n from train group by 1,2,3) b on a.venue is not distinct from b.venue and a.authors is not distinct from b.authors and a.year is not distinct from b.year")
def _(s, d):
    b = table(s, d, "train", "id", "venue", "authors", "year")
    return en.joined_null_safe(b, b.groupBy("venue", "authors", "year").agg(F.count("*").alias("n")), ["venue", "authors", "year"]).select("id", "n")


@query("j8_s11_remaining", "select distinct id from train where id not in (select id from s2_match_abstracts where source_split='train')")
def _(s, d):
    return en.remaining(table(s, d, "train", "id"), table(s, d, "s2_match_abstracts", "source_split", "id").filter("source_split = 'train'"), ["id"])


@query("s12_redo_failed", "select distinct id from train where id not in (select id from s2_match_abstracts where source_split='train' and error is null and found)")
def _(s, d):
    return en.redo(table(s, d, "train", "id"), table(s, d, "s2_match_abstracts", "source_split", "id", "error", "found").filter("source_split = 'train'"), "id", F.col("error").isNull() & F.col("found"))


@query("j9_j10_membership", "select p.id, string_agg(distinct t.label::varchar, ',' order by t.label::varchar) as labels, count(*) as n from public_test p join train t on lower(p.title)=lower(t.title) group by 1")
def _(s, d):
    k = F.lower("title").alias("k")
    m = table(s, d, "public_test", "id", "title").select("id", k).join(table(s, d, "train", "title", "label").select(k, "label"), "k")
    return m.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set(F.col("label").cast("string"))), ",").alias("labels"), F.count("*").alias("n"))


_RUB = [(1, "solving"), (2, "learning"), (3, "planning"), (4, "logic"), (5, "data")]


@query("j11_j12_expanded_pairs", "select id, rubric, name, contains(lower(coalesce(title,'')),name)::int as hit from train cross join (values " + ",".join(f"({i},'{n}')" for i, n in _RUB) + ") r(rubric,name)")
def _(s, d):
    rubrics = s.createDataFrame(_RUB, "rubric int, name string")
    return table(s, d, "train", "id", "title").crossJoin(F.broadcast(rubrics)).select("id", "rubric", "name", F.contains(F.lower(F.coalesce("title", F.lit(""))), F.col("name")).cast("int").alias("hit"))


@query("j13_lookup_default", "with m as (select venue, avg(label) as v from train where venue is not null group by 1) select p.id, round(coalesce(m.v,(select avg(label) from train)),6) as v from public_test p left join m using(venue)")
def _(s, d):
    tr = table(s, d, "train", "venue", "label")
    mapping = tr.filter("venue is not null").groupBy("venue").agg(F.avg("label").alias("v"))
    prior = tr.agg(F.avg("label").alias("prior"))
    out = table(s, d, "public_test", "id", "venue").crossJoin(F.broadcast(prior))
    return en.lookup(out, mapping, "venue", "v", F.col("prior")).select("id", r6("v").alias("v"))


_FILL = "(select source_split,id,min(rec_id) filter(where length(trim(coalesce(abstract,'')))>30) as r from {t} group by 1,2)"


@query("j14_c36_c37_gap_fill", f"select t.id, case when a.r is not null then a.r when m.r is not null then m.r end as rec, case when a.r is not null then 'merged' when m.r is not null then 'match' else 'none' end as src from train t left join {_FILL.format(t='abstracts_merged_v3')} a on a.source_split='train' and a.id=t.id left join {_FILL.format(t='s2_match_abstracts')} m on m.source_split='train' and m.id=t.id")
def _(s, d):
    def side(name, out):
        full = F.length(F.trim(F.coalesce("abstract", F.lit("")))) > 30
        return table(s, d, name, "source_split", "id", "rec_id", "abstract").filter("source_split = 'train'").groupBy("id").agg(F.min(F.when(full, F.col("rec_id"))).alias(out))

    b = table(s, d, "train", "id").join(side("abstracts_merged_v3", "a"), "id", "left").join(side("s2_match_abstracts", "m"), "id", "left")
    value, source = en.found_first([("merged", F.col("a").isNotNull(), F.col("a")), ("match", F.col("m").isNotNull(), F.col("m"))])
    return b.select("id", value.alias("rec"), source.alias("src"))


# retrieval


@query("x2_year_bonus", "select openalex_id, case when abs(openalex_year-2020)<=1 then 0.05 when abs(openalex_year-2020)<=3 then 0.02 else 0.0 end::double as bonus from openalex_title_features")
def _(s, d):
    gap = F.abs(F.col("openalex_year") - 2020)
    return table(s, d, "openalex_title_features", "openalex_id", "openalex_year").select("openalex_id", F.when(gap <= 1, 0.05).when(gap <= 3, 0.02).otherwise(0.0).alias("bonus"))


@query("x5_lookup_keys", f"select id, case when {_DOI.format(c='doi')}<>'' then 'DOI:'||{_DOI.format(c='doi')} when regexp_extract(coalesce(doi,''),'/paper/([0-9a-fA-F]{{40}})',1)<>'' then 'S2:'||lower(regexp_extract(doi,'/paper/([0-9a-fA-F]{{40}})',1)) else 'TITLE:train:'||id::varchar end as lookup_id from train")
def _(s, d):
    k = F.when(t.normalize_doi("doi") != "", F.concat(F.lit("DOI:"), t.normalize_doi("doi"))).when(t.page_id("doi") != "", F.concat(F.lit("S2:"), t.page_id("doi"))).otherwise(F.concat(F.lit("TITLE:train:"), F.col("id").cast("string")))
    return table(s, d, "train", "id", "doi").select("id", k.alias("lookup_id"))


@query("x6_e9_s6_dense_similarity", "with u as (select vec_id, label, list_transform(embedding, lambda x: x::double/sqrt(list_sum(list_transform(embedding, lambda y: y::double*y::double)))) as v from embeddings), r as (select label as rubric, v from u where vec_id<5) select u.vec_id, count(*) as n, round(max(list_sum(list_transform(list_zip(u.v,r.v), lambda z: z[1]*z[2]))),5) as best from u cross join r group by 1")
def _(s, d):
    u = table(s, d, "embeddings", "vec_id", "embedding").select("vec_id", fe.unit_vector(F.col("embedding")).alias("v"))
    r = u.filter("vec_id < 5").select(F.col("v").alias("rv"))
    return u.crossJoin(F.broadcast(r)).groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.max(fe.dot(F.col("v"), F.col("rv"))), 5).alias("best"))


_WG = "list_filter(string_split(trim(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9]+',' ','g')),' '), lambda w: length(w)>=2)"
_TF = f"ws as (select id, {_WG} as w from train), g as (select id, unnest(list_concat(w, list_transform(range(1,greatest(len(w),1)), lambda i: w[i]||' '||w[i+1]))) as term from ws), tf as (select id,term,count(*) tf from g group by 1,2), voc as (select term, count(*) df, sum(tf) total from tf group by 1 order by total desc, term limit 2000), raw as (select tf.id, tf.term, (1+ln(tf.tf))*(ln((1+(select count(*) from train))/(1+voc.df)::double)+1) as w from tf join voc using(term)), nrm as (select id, sqrt(sum(w*w)) as n from raw group by 1)"


@query("e1_word_tfidf", f"with {_TF} select term, count(*) as docs, round(sum(w/n),4) as total from raw join nrm using(id) group by 1")
def _(s, d):
    x = fe.tfidf(table(s, d, "train", "id", "title"), "id", fe.word_grams(F.col("title")), limit=2000)
    return x.groupBy("term").agg(F.count("*").alias("docs"), F.round(F.sum("weight"), 4).alias("total"))


@query("e2_char_tfidf", "with w as (select id, unnest(list_filter(string_split(trim(regexp_replace(lower(coalesce(title,'')),'[^a-z0-9]+',' ','g')),' '), lambda w: w<>'')) as w from train), p as (select id, ' '||w||' ' as w from w), g as (" + " union all ".join(f"select id, unnest(list_transform(range(1,greatest(length(w)-{n}+1,1)+1), lambda i: substring(w,i,{n}))) as term from p" for n in (3, 4, 5)) + ") select term, count(distinct id) as docs, count(*) as n from g where length(term)>=3 group by 1 having count(distinct id)>=20")
def _(s, d):
    g = table(s, d, "train", "id", "title").select("id", F.explode(fe.char_grams(F.col("title"))).alias("term"))
    per = g.groupBy("id", "term").agg(F.count("*").alias("c"))
    return per.groupBy("term").agg(F.count("*").alias("docs"), F.sum("c").alias("n")).filter("docs >= 20")


@query("x7_lexical_match", f"with {_TF}, wt as (select id, term, w/n as w from raw join nrm using(id)), rub(rubric,term) as (values (1,'query answering'),(2,'learning'),(3,'scheduling'),(4,'logic'),(5,'data')) select rubric, count(*) as n, round(sum(w),4) as total from wt join rub using(term) group by 1")
def _(s, d):
    rub = s.createDataFrame([(1, "query answering"), (2, "learning"), (3, "scheduling"), (4, "logic"), (5, "data")], "rubric int, term string")
    x = fe.tfidf(table(s, d, "train", "id", "title"), "id", fe.word_grams(F.col("title")), limit=2000)
    return x.join(F.broadcast(rub), "term").groupBy("rubric").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"))


@query("x9_cue_score", P + "select id, label from (select id, label, row_number() over(partition by label order by (length(coalesce(title,''))>80)::int+(coalesce(year,0)>=2020)::int+(doi is not null)::int desc, id) as r from papers) where r<=3")
def _(s, d):
    from folioscope.operators.ranking import top_per_group

    cue = (F.length(F.coalesce("title", F.lit(""))) > 80).cast("int") + (F.coalesce("year", F.lit(0)) >= 2020).cast("int") + F.col("doi").isNotNull().cast("int")
    return top_per_group(papers(s, d).withColumn("cue", cue).select("id", "label", "cue"), ["label"], [F.desc("cue"), F.col("id")], 3).select("id", "label")


# features and folds


@query("e4_target_encoding", PF + ", k as (select venue, fold, sum(label) s, count(label) n from folds group by 1,2), q as (select venue, fold, sum(s) over(partition by venue)-s as s, sum(n) over(partition by venue)-n as n from k) select f.id, round((q.s+(select avg(label) from papers)*20)/(q.n+20)::double,6) as encoded from folds f join q on f.venue is not distinct from q.venue and f.fold=q.fold")
def _(s, d):
    return fe.target_encoding(with_folds(papers(s, d)).select("id", "venue", "label", "fold"), "venue", "label", "fold").select("id", r6("encoded").alias("encoded"))


@query("e5_e6_impute_scale", "with m as (select openalex_id, coalesce(cited_by_count,(select median(cited_by_count) from openalex_title_features))::double as c from openalex_title_features) select openalex_id, round((c-(select avg(c) from m))/(select stddev_pop(c) from m),6) as c from m")
def _(s, d):
    x = fe.imputed(table(s, d, "openalex_title_features", "openalex_id", "cited_by_count").withColumnRenamed("cited_by_count", "c"), ["c"])
    return fe.standardised(x, ["c"]).select("openalex_id", r6("c").alias("c"))


@query("e7_one_hot", "select id, case when venue in (select venue from train where venue is not null group by 1 having count(*)>=2) then venue end as value from train")
def _(s, d):
    return fe.one_hot(table(s, d, "train", "id", "venue"), "id", "venue")


@query("e10_cleaned_vector", "select rec_id, round(case when oat_match_score is null or isnan(oat_match_score) then 0 else oat_match_score end,6) as score, coalesce(s2_citation_count,0) as cited from abstracts_merged_v3")
def _(s, d):
    return table(s, d, "abstracts_merged_v3", "rec_id", "oat_match_score", "s2_citation_count").select("rec_id", r6(F.coalesce(F.nanvl("oat_match_score", F.lit(0.0)), F.lit(0.0))).alias("score"), F.coalesce("s2_citation_count", F.lit(0)).alias("cited"))


@query("e11_scale_alignment", P + ", z as (select avg(s2) m, stddev_pop(s2) s, avg(s1) bm, stddev_pop(s1) bs from papers) select id, round(case when s=0 then bm else (s2-m)/s*bs+bm end,6) as aligned from papers cross join z")
def _(s, d):
    return od.aligned(papers(s, d), "s2", "s1").select("id", r6("aligned").alias("aligned"))


@query("e12_class_weights", "select label, round((select count(*) from train)/(5.0::double*count(*)),6) as weight from train group by 1")
def _(s, d):
    return fe.class_weights(table(s, d, "train", "label"), "label").select("label", r6("weight").alias("weight"))


@query("m1_stratified_folds", PF + "select id, fold from folds")
def _(s, d):
    return with_folds(table(s, d, "train", "id", "label")).select("id", "fold")


@query("m2_plain_folds", "select id, cast((row_number() over(order by md5('777|'||id::varchar))-1)%5 as int) as fold from train")
def _(s, d):
    return with_folds(table(s, d, "train", "id", "label"), seed=777, group=()).select("id", "fold")


@query("m16_argmax", P + "select id, cast(list_position([s1,s2,s3,s4],list_max([s1,s2,s3,s4])) as int) as best from papers")
def _(s, d):
    x = F.array("s1", "s2", "s3", "s4")
    return papers(s, d).select("id", F.array_position(x, F.array_max(x)).cast("int").alias("best"))


@query("m11_ridge_one_feature", PF + ", k as (select f.fold, avg(o.s2) mx, avg(o.label) my, sum(o.s2*o.s2) sxx, sum(o.s2*o.label) sxy, count(*) n from (select distinct fold from folds) f join folds o on o.fold<>f.fold group by 1), w as (select fold, (sxy-n*mx*my)/(sxx-n*mx*mx+5.0::double) as w, mx, my from k) select id, round(my+w*(s2-mx),4) as oof from folds join w using(fold)")
def _(s, d):
    """Out-of-fold ridge of one score in closed form: sums per fold, the own fold subtracted."""
    b = with_folds(papers(s, d).select("id", "label", "s2"))
    x, y = F.col("s2"), F.col("label")
    per = b.groupBy("fold").agg(F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.count("*").alias("n"))
    total = per.agg(*[F.sum(c).alias(f"t{c}") for c in ("x", "y", "xx", "xy", "n")])
    rest = per.crossJoin(total).select("fold", *[(F.col(f"t{c}") - F.col(c)).alias(c) for c in ("x", "y", "xx", "xy", "n")])
    mx, my = F.col("x") / F.col("n"), F.col("y") / F.col("n")
    w = rest.select("fold", mx.alias("mx"), my.alias("my"), ((F.col("xy") - F.col("n") * mx * my) / (F.col("xx") - F.col("n") * mx * mx + 5.0)).alias("w"))
    return b.join(F.broadcast(w), "fold").select("id", F.round(F.col("my") + F.col("w") * (x - F.col("mx")), 4).alias("oof"))


# metrics, thresholds, blends, gates

MET = "round(1-avg((label-{p})*(label-{p}))/nullif(var_pop(label)+var_pop({p})+power(avg(label)-avg({p}),2),0),6) as qwk, round(avg((label={p})::int),6) as accuracy, round(avg(abs(label-{p})),6) as mae, round(avg((abs(label-{p})<=1)::int),6) as adjacent"


@query("r1_r4_metrics", PL + f"select anchor, {MET.format(p='pred')} from long group by 1")
def _(s, d):
    return long_scores(papers(s, d)).groupBy("anchor").agg(*me.scored("label", "pred"))


@query("r5_macro_f1", P + "select round(avg(coalesce(2*tp/nullif(a+c,0)::double,0)),6) as macro_f1 from (select l, count(*) filter(where label=l and p1=l) tp, count(*) filter(where label=l) a, count(*) filter(where p1=l) c from papers cross join (select unnest([1,2,3,4,5]) as l) group by 1) where a+c>0")
def _(s, d):
    return me.macro_f1(papers(s, d), "label", "p1").select(r6("macro_f1").alias("macro_f1"))


@query("r6_round_qwk", P + f"select {MET.format(p='p').split(', round(avg((label=')[0]} from (select label, least(greatest(round_even(s1,0),1),5) as p from papers)")
def _(s, d):
    return papers(s, d).withColumn("p", F.least(F.greatest(F.bround("s1"), F.lit(1)), F.lit(5))).agg(r6(me.qwk("label", "p")).alias("qwk"))


@query("r9_fold_report", PF + "select fold, count(*) as n, round(avg(s1),6) as mean, round(stddev_pop(s1),6) as std from folds group by 1")
def _(s, d):
    return with_folds(papers(s, d).select("id", "label", "s1")).groupBy("fold").agg(F.count("*").alias("n"), r6(F.avg("s1")).alias("mean"), r6(F.stddev_pop("s1")).alias("std"))


@query("k1_threshold_labels", P + "select id, p1 as pred from papers")
def _(s, d):
    return papers(s, d).select("id", me.label_by_cuts("s1", CUTS).alias("pred"))


@query("k2_k3_threshold_search")
def _(s, d):
    """Cut points found on a histogram, and what they score."""
    b = papers(s, d).select("id", "label", "s1")
    hist = od.score_histogram(b, "s1", "label")
    rows = [(f"drift_{lam}", od.search_cuts(hist, drift=lam)) for lam in (0.0, 0.5, 2.0)]
    return od.evaluate_cut_sets(b, "s1", "label", s.createDataFrame(rows, "name string, cuts array<double>"))


_SETS = [("base", 0.0), ("lower", -0.1), ("higher", 0.1)]


@query("k4_threshold_variants", P + "select name, " + MET.format(p="p") + " from (select name, label, 1+(s1>=c1)::int+(s1>=c2)::int+(s1>=c3)::int+(s1>=c4)::int as p from papers cross join (values " + ",".join("('%s',%s)" % (n, ",".join(f"{c + o!r}::double" for c in CUTS)) for n, o in _SETS) + ") v(name,c1,c2,c3,c4)) group by 1")
def _(s, d):
    sets = s.createDataFrame([(n, [c + o for c in CUTS]) for n, o in _SETS], "name string, cuts array<double>")
    return od.evaluate_cut_sets(papers(s, d).select("s1", "label"), "s1", "label", sets)


_B = "0.5::double*s1+0.2::double*s2+0.3::double*s3"


@query("b1_b3_b4_blends", P + f"select id, round({_B},6) as convex, round(s1+0.3::double*(s2-s1),6) as residual, round((1-0.03::double)*((1-0.1::double)*({_B})+0.1::double*s4)+0.03::double*s2,6) as nested, round((s1+s2+s3+s4)/4,6) as mean from papers")
def _(s, d):
    stack = od.blend({"s1": 0.5, "s2": 0.2, "s3": 0.3})
    nested = (1 - 0.03) * ((1 - 0.1) * stack + 0.1 * F.col("s4")) + 0.03 * F.col("s2")
    return papers(s, d).select("id", r6(stack).alias("convex"), r6(F.col("s1") + 0.3 * (F.col("s2") - F.col("s1"))).alias("residual"), r6(nested).alias("nested"), r6((F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")) / 4).alias("mean"))


_GRID = od.weight_grid(["s1", "s2", "s3"])


def _grid(s, d):
    w = s.createDataFrame([(i, g["s1"], g["s2"], g["s3"]) for i, g in enumerate(_GRID)], "candidate int, w1 double, w2 double, w3 double")
    x = papers(s, d).select("id", "label", "s1", "s2", "s3", "p1").crossJoin(F.broadcast(w))
    return x.withColumn("p", me.label_by_cuts(F.col("w1") * F.col("s1") + F.col("w2") * F.col("s2") + F.col("w3") * F.col("s3"), CUTS))


_GS = P + ", w(candidate,w1,w2,w3) as (values " + ",".join(f"({i},{g['s1']!r}::double,{g['s2']!r}::double,{g['s3']!r}::double)" for i, g in enumerate(_GRID)) + "), x as (select *, 1+(b>=1.7::double)::int+(b>=2.4::double)::int+(b>=3.0::double)::int+(b>=3.8::double)::int as p from (select papers.*, w.*, w1*s1+w2*s2+w3*s3 as b from papers cross join w)), c as (select candidate, " + MET.format(p="p") + ", count(*) filter(where p<>p1) as changed, count(*) filter(where abs(label-p)<abs(label-p1)) as improved, count(*) filter(where abs(label-p)>abs(label-p1)) as worsened from x group by 1) "


def _candidates(s, d):
    e, e1 = F.abs(F.col("label") - F.col("p")), F.abs(F.col("label") - F.col("p1"))
    return _grid(s, d).groupBy("candidate").agg(*me.scored("label", "p"), F.count_if(F.col("p") != F.col("p1")).alias("changed"), F.count_if(e < e1).alias("improved"), F.count_if(e > e1).alias("worsened"))


@query("b2_b9_u3_weight_grid", _GS + "select candidate, qwk, accuracy, mae, changed from c")
def _(s, d):
    return _candidates(s, d).select("candidate", "qwk", "accuracy", "mae", "changed")


@query("g1_g4_gated_candidates", _GS + "select candidate, qwk, round(qwk-0.0001*changed-0.1*mae,6) as rank_score from c where improved>=worsened and mae<=(select mae from c where candidate=(select min(candidate) from c))+1 order by rank_score desc, candidate limit 5")
def _(s, d):
    """The flagship: a grid of blends scored against all papers, gated, and ranked by a penalised score."""
    c = _candidates(s, d)
    base = c.groupBy().agg(F.min_by("mae", "candidate").alias("base"))
    kept = c.crossJoin(F.broadcast(base)).filter("improved >= worsened and mae <= base + 1")
    return kept.select("candidate", "qwk", r6(F.col("qwk") - 0.0001 * F.col("changed") - 0.1 * F.col("mae")).alias("rank_score")).orderBy(F.desc("rank_score"), "candidate").limit(5)


@query("g5_g6_micro_gate", P + ", m as (select *, least(abs(s1-1.7::double),abs(s1-2.4::double),abs(s1-3.0::double),abs(s1-3.8::double)) as g from papers), k as (select id from m where g<0.15::double and p2<>p1 and abs(s1-s2)>0.3::double order by abs(s1-s2) desc, id limit 25) select m.id, case when k.id is not null then cast(p1+sign(p2-p1) as int) else p1 end as new_pred from m left join k using(id)")
def _(s, d):
    g = F.least(*[F.abs(F.col("s1") - c) for c in CUTS])
    b = papers(s, d).withColumn("g", g)
    picked = b.filter((F.col("g") < 0.15) & (F.col("p2") != F.col("p1")) & (F.abs(F.col("s1") - F.col("s2")) > 0.3)).orderBy(F.desc(F.abs(F.col("s1") - F.col("s2"))), "id").limit(25).select("id", F.lit(True).alias("on"))
    return b.join(F.broadcast(picked), "id", "left").select("id", F.when(F.col("on"), (F.col("p1") + F.signum(F.col("p2") - F.col("p1"))).cast("int")).otherwise(F.col("p1")).alias("new_pred"))


@query("b7_b8_stackers")
def _(s, d):
    """Convex weights and ridge coefficients of the four scores, fitted on sums of products."""
    b = papers(s, d).select("id", "s1", "s2", "s3", "s4", F.col("label").cast("double").alias("label"))
    convex = od.convex_weights(b, ["s1", "s2", "s3", "s4"], "label")
    w, free = od.ridge_weights(b, ["s1", "s2", "s3", "s4"], "label", 5.0)
    ridge = od.blend(dict(zip(("s1", "s2", "s3", "s4"), w.tolist()))) + F.lit(free)
    return b.withColumns({"c": clip(od.blend(convex)), "r": clip(ridge)}).withColumns({"pc": me.label_by_cuts("c", CUTS), "pr": me.label_by_cuts("r", CUTS)}).select("id", r6("c").alias("convex"), r6("r").alias("ridge"), "pc", "pr")
