"""Feature encoders: TF-IDF of words and characters, target encoding without leakage, scaling, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.ranking import quantiles
from folioscope.session import cut_lineage


def word_grams(c: Column) -> Column:
    """Words of two letters or more and pairs of neighbours."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda w: F.length(w) >= 2)
    pairs = F.filter(F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.coalesce(F.get(words, i + 1), F.lit("")))), lambda p: ~F.endswith(p, F.lit(" ")))
    return F.concat(words, pairs)


def char_grams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Runs of ``low`` to ``high`` characters inside each word padded with a space on both sides."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(n: int) -> Column:
        return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))))

    return F.filter(F.concat(*[runs(n) for n in range(low, high + 1)]), lambda g: F.length(g) >= low)


def tfidf(df: DataFrame, key: str, terms: Column, limit: int | None = None, least: int = 1) -> DataFrame:
    """(key, term, weight): 1 + ln tf times ln((1 + n) / (1 + df)) + 1, rows of length one.

    The vocabulary keeps the ``limit`` terms of the largest corpus count, ties by term; all by aggregations and joins.
    """
    tf = cut_lineage(df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")))
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= least)
    if limit:
        vocabulary = vocabulary.orderBy(F.desc("total"), "term").limit(limit)
    rows = df.agg(F.count("*").alias("n"))
    idf = vocabulary.crossJoin(F.broadcast(rows)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def target_encoding(df: DataFrame, key: str, target: str, fold: str, smoothing: float = 20.0) -> DataFrame:
    """``df`` with ``encoded``: the smoothed mean of the target of the key over the other folds.

    One aggregation by key and fold and its totals; a row's own fold is subtracted, so no fold is scanned again.
    """
    per = df.groupBy(key, fold).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    total = Window.partitionBy(key)
    rest = per.select(F.col(key).alias("__k"), F.col(fold).alias("__f"), (F.sum("s").over(total) - F.col("s")).alias("s"), (F.sum("n").over(total) - F.col("n")).alias("n"))
    prior = df.agg(F.avg(target).alias("__prior"))
    out = df.join(rest, F.col(key).eqNullSafe(F.col("__k")) & (F.col(fold) == F.col("__f")), "left").crossJoin(F.broadcast(prior))
    return out.withColumn("encoded", (F.coalesce("s", F.lit(0)) + F.col("__prior") * smoothing) / (F.coalesce("n", F.lit(0)) + smoothing)).drop("__k", "__f", "s", "n", "__prior")


def encoding_of_train(train: DataFrame, test: DataFrame, key: str, target: str, smoothing: float = 20.0) -> DataFrame:
    """``test`` with ``encoded``: the smoothed mean of the target of its key over all of ``train``; a key that train lacks gets the mean of all."""
    per = train.groupBy(F.col(key).alias("__k")).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    prior = train.agg(F.avg(target).alias("__prior"))
    out = test.join(per, F.col(key).eqNullSafe(F.col("__k")), "left").crossJoin(F.broadcast(prior))
    return out.withColumn("encoded", (F.coalesce("__s", F.lit(0)) + F.col("__prior") * smoothing) / (F.coalesce("__n", F.lit(0)) + smoothing)).drop("__k", "__s", "__n", "__prior")


def feature_union(blocks: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, feature, weight): blocks of (key, term, weight) side by side, each term under the name of its block."""
    parts = [df.select(key, F.concat(F.lit(f"{name}:"), "term").alias("feature"), "weight") for name, df in blocks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def column_transformer(df: DataFrame, key: str, numeric: list[str], categorical: list[str], least: int = 2) -> DataFrame:
    """(key, feature, weight): numbers with the median for nulls and on one scale, categories that ``least`` rows have as 1; columns that ``df`` lacks are skipped."""
    numbers, names = [c for c in numeric if c in df.columns], [c for c in categorical if c in df.columns]
    parts = []
    if numbers:
        scaled = standardised(imputed(df.select(key, *numbers), numbers), numbers)
        parts.append(scaled.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("weight")) for c in numbers])).alias("e")).select(key, "e.*"))
    for c in names:
        hot = one_hot(df.select(key, F.col(c).cast("string").alias(c)), key, c, least).filter("value is not null")
        parts.append(hot.select(key, F.concat(F.lit(f"{c}="), "value").alias("feature"), F.lit(1.0).alias("weight")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with mean 0 and population deviation 1; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    x = df.crossJoin(F.broadcast(stats))
    return x.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)).alias(c) for c in columns])


def imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls as the exact median of the column."""
    x = df
    for c in columns:
        x = x.crossJoin(F.broadcast(quantiles(df, c, {f"__{c}": 0.5})))
    return x.select(*[c for c in df.columns if c not in columns], *[F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")).alias(c) for c in columns])


def one_hot(df: DataFrame, key: str, column: str, least: int = 2) -> DataFrame:
    """(key, value): the category of each row, null where fewer than ``least`` rows have it."""
    kept = df.groupBy(column).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(F.col(column).alias("__v"))
    return df.join(kept, F.col(column) == F.col("__v"), "left").select(key, F.col("__v").alias("value"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): rows over classes times rows of the class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))


def unit_vector(c: Column) -> Column:
    """The vector over its length."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
