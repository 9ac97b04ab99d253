"""Queries of models, caches and streams: results that SQL cannot express are checked by tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.operators import models as mo
from folioscope.operators.features import class_weights, dot, unit_vector
from folioscope.operators.metrics import scored
from folioscope.operators.ranking import top_per_group
from folioscope.plans.base import papers, with_folds
from folioscope.session import ensure_checkpoint_dir
from folioscope.sources.cache import read_csv, write_csv
from folioscope.sources.tables import table
from folioscope.streaming.upsert import windowed_counts


def _scored(df: DataFrame) -> DataFrame:
    p = F.least(F.greatest(F.bround("prediction"), F.lit(1)), F.lit(5)).cast("int")
    return df.withColumn("p", p).groupBy("fold").agg(*scored("label", "p"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_folds(papers(spark, sf_dir)).select("id", "fold", "title", "s2", "s3", "s4", "year", F.col("label").cast("double").alias("label")).cache()


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {"title_length": F.length(F.coalesce("title", F.lit(""))), "title_words": F.size(F.split(F.coalesce("title", F.lit("")), " "))}
    return mo.assembled(_base(spark, sf_dir).withColumns(sizes), ["s2", "s3", "s4", "year", *sizes])


def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mo.text_features(_base(spark, sf_dir), "title").select("id", "fold", "label", "features").cache()


def m5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold metrics of a forest on the scores."""
    df = _dense(spark, sf_dir)
    return _scored(mo.out_of_fold(df.join(F.broadcast(class_weights(df, "label")), "label"), mo.forest(), first=1))


def m6_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold metrics of one-versus-rest logistic regression on hashed title words."""
    df = _text(spark, sf_dir)
    return _scored(mo.out_of_fold(df, mo.logistic(1.0, df.count()), first=1))


def m8_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold metrics of linear support vectors on hashed title words."""
    df = _text(spark, sf_dir)
    return _scored(mo.out_of_fold(df, mo.support_vectors(1.0, df.count()), first=1))


def m17_rubric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of papers against five rubric texts, out of fold."""
    rubrics = spark.createDataFrame([(k, [w]) for k, w in enumerate(t.KEYWORD_GROUPS, 1)], "rubric int, words array<string>")
    df = with_folds(papers(spark, sf_dir)).select("id", "fold", "label", t.tokens("title").alias("terms")).cache()
    return mo.rubric_probabilities(df, rubrics).withColumn("p", F.bround("expected").cast("int")).agg(*scored("label", "p"), F.count("*").alias("n"))


def x8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean label of the five nearest rows of each stated query row (ids divisible by 100) among all others."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("v", unit_vector(F.col("embedding"))).select("vec_id", "v", "label")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    near = asked.crossJoin(rows).filter("query_id != vec_id").select("query_id", "vec_id", "label", F.round(dot(F.col("q"), F.col("v")), 6).alias("sim"))
    best = top_per_group(near, ["query_id"], [F.desc("sim"), F.col("vec_id")], 5)
    return best.groupBy("query_id").agg(F.round(F.avg("label"), 6).alias("mean_label"), F.count("*").alias("n"))


def m11_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold metrics of ridge regression on hashed title words."""
    df = _text(spark, sf_dir)
    n = df.agg(F.count("*"), F.stddev_samp("label")).first()
    return _scored(mo.out_of_fold(df, mo.ridge(8.0, n[0], n[1])))


def m12_huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold metrics of Huber regression on hashed title words."""
    df = _text(spark, sf_dir)
    return _scored(mo.out_of_fold(df, mo.huber(0.01, df.count())))


def m14_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold metrics of boosted trees on the scores."""
    return _scored(mo.out_of_fold(_dense(spark, sf_dir), mo.boosted()))


def s1_s8_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train written as CSV into the shared folder and read back."""
    df = table(spark, sf_dir, "train", "id", "title", "venue", "year", "label")
    path = f"{ensure_checkpoint_dir(spark)}/csv-{spark.sparkContext.applicationId}"
    plain = df.withColumns({c: F.when(F.col(c).isNotNull(), t.squeeze(c)) for c in ("title", "venue")})
    write_csv(plain, path)
    return read_csv(spark, path, plain.schema)


def st_windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, by the code that the stream runs."""
    return windowed_counts(table(spark, sf_dir, "events", "ts", "event_type", "value")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    "m5_forest": m5_forest, "m6_logistic": m6_logistic, "m8_support_vectors": m8_support_vectors, "m17_rubric_pairs": m17_rubric_pairs, "x8_knn": x8_knn, "m11_ridge": m11_ridge, "m12_huber": m12_huber, "m14_boosted": m14_boosted, "s1_s8_csv": s1_s8_csv, "st_windowed_events": st_windowed_events,
}
_SQZ = "trim(regexp_replace({c},'\\s+',' ','g'),' ')"
_UNIT = "list_transform(embedding, lambda x: x::double/sqrt(list_sum(list_transform(embedding, lambda y: y::double*y::double))))"
ORACLES = {
    "x8_knn": f"with u as (select vec_id, label, {_UNIT} as v from embeddings), s as (select a.vec_id as query_id, b.vec_id, b.label, round(list_sum(list_transform(list_zip(a.v,b.v), lambda z: z[1]*z[2])),6) as sim from u a join u b on a.vec_id<>b.vec_id where a.vec_id%100=0), r as (select *, row_number() over(partition by query_id order by sim desc, vec_id) as r from s) select query_id, round(avg(label),6) as mean_label, count(*) as n from r where r<=5 group by 1",
    "s1_s8_csv": f"select id, {_SQZ.format(c='title')} as title, {_SQZ.format(c='venue')} as venue, year, label from train",
    "st_windowed_events": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value),4) as total from events group by 1,2",
}
