"""Base tables that several queries share, beside their SQL: papers with scores, long scores, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.metrics import label_by_cuts
from folioscope.operators.ranking import hashed_rank
from folioscope.sources.tables import table

CUTS = [1.7, 2.4, 3.0, 3.8]
ANCHORS = ("s1", "s2", "s3", "s4")


def clip(c):
    """Scores stay on the scale of the labels."""
    return F.least(F.greatest(c, F.lit(1.0)), F.lit(5.0))


def with_scores(t: DataFrame) -> DataFrame:
    """``t`` with four score families computed from a digest of id and title and from the authors, never from the label, and the labels these scores give."""
    digest = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("title", F.lit(""))))
    part = lambda at: F.conv(F.substring("__d", at, 4), 16, 10).cast("double") / 65535.0
    t = t.withColumn("__d", digest).withColumn("s1", part(1) * 4.0 + 1.0)
    a = F.length(F.coalesce("authors", F.lit("")))
    t = t.withColumns({"s2": clip(F.col("s1") + (part(5) - 0.5) * 1.6), "s3": clip(F.col("s1") + (part(9) - 0.5) * 2.4), "s4": clip(2.5 + (a % 23 - 11) / 10.0)}).drop("__d")
    return t.withColumns({f"p{i}": label_by_cuts(f"s{i}", CUTS) for i in range(1, 5)})


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train papers with their scores."""
    return with_scores(table(spark, sf_dir, "train", "id", "title", "venue", "year", "authors", "doi", "label"))


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers of both test splits with their scores."""
    parts = [table(spark, sf_dir, s, "id", "title", "venue", "year", "authors").withColumn("source_split", F.lit(s)) for s in ("public_test", "private_test")]
    return with_scores(parts[0].unionByName(parts[1]))


_H = "(('0x'||substr(d,{k},4))::int/65535.0::double)"
_CLIP = "least(greatest({x},1.0::double),5.0::double)::double"
_SCORES = (
    "select * exclude (d), "
    + _CLIP.format(x=f"s1+({_H.format(k=5)}-0.5::double)*1.6::double")
    + " as s2, "
    + _CLIP.format(x=f"s1+({_H.format(k=9)}-0.5::double)*2.4::double")
    + " as s3, "
    + _CLIP.format(x="2.5::double+(length(coalesce(authors,''))%23-11)/10.0::double")
    + " as s4 from (select *, "
    + _H.format(k=1)
    + "*4.0::double+1.0::double as s1 from (select *, md5(id::varchar||'|'||coalesce(title,'')) as d from {t}))"
)
_BOTH = "(select id,title,venue,year,authors,'public_test' as source_split from public_test union all select id,title,venue,year,authors,'private_test' from private_test)"
_LABEL = "(1+(s{i}>=1.7::double)::int+(s{i}>=2.4::double)::int+(s{i}>=3.0::double)::int+(s{i}>=3.8::double)::int)"
PAPERS_SQL = f"papers as (select *, {', '.join(_LABEL.format(i=i) + f' as p{i}' for i in range(1, 5))} from ({_SCORES.format(t='train')}))"
TESTS_SQL = f"tests as (select *, {', '.join(_LABEL.format(i=i) + f' as p{i}' for i in range(1, 5))} from ({_SCORES.format(t=_BOTH)}))"
LONG_SQL = "long as (" + " union all ".join(f"select id,label,'s{i}' as anchor,s{i} as score,p{i} as pred from papers" for i in range(1, 5)) + ")"
FOLDS_SQL = "folds as (select *, cast((row_number() over(partition by label order by md5('252'||'|'||cast(id as varchar)))-1)%5 as int) as fold from papers)"


def long_scores(df: DataFrame) -> DataFrame:
    """(id, label, anchor, score, pred): the score families below each other."""
    entries = F.explode(F.array(*[F.struct(F.lit(f"s{i}").alias("anchor"), F.col(f"s{i}").alias("score"), F.col(f"p{i}").alias("pred")) for i in range(1, 5)]))
    return df.select("id", "label", entries.alias("e")).select("id", "label", "e.*")


def with_folds(df: DataFrame, k: int = 5, seed: int = 252, group: tuple[str, ...] = ("label",)) -> DataFrame:
    """A fold from 0 to k - 1 for each row, spread evenly inside each group in the order of a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")))
    return hashed_rank(df, list(group), digest).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")
