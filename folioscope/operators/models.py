"""Linear and tree models of the ML library with out-of-fold scores; each fit is distributed."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.features import word_grams


def ridge(alpha: float, rows: int, deviation: float) -> LinearRegression:
    """Ridge with the penalty of the closed form: the library scales it by rows and the target's deviation."""
    return LinearRegression(labelCol="label", elasticNetParam=0.0, standardization=False, regParam=alpha / rows * deviation, solver="l-bfgs", maxIter=40)


def huber(alpha: float, rows: int, epsilon: float = 1.5) -> LinearRegression:
    """Huber regression."""
    return LinearRegression(labelCol="label", loss="huber", epsilon=epsilon, standardization=False, regParam=alpha / rows, maxIter=20)


def forest(trees: int = 100) -> RandomForestClassifier:
    """Forest with two rows to a leaf, the root of the features to a split, and class weights."""
    return RandomForestClassifier(labelCol="label", numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="sqrt", weightCol="weight", seed=42)


def logistic(c: float, rows: int) -> OneVsRest:
    """One-versus-rest logistic regression with the inverse penalty ``c``."""
    return OneVsRest(classifier=LogisticRegression(regParam=1 / (c * rows), standardization=False, maxIter=20), labelCol="label", parallelism=8)


def support_vectors(c: float, rows: int) -> OneVsRest:
    """One-versus-rest linear support vectors with the hinge loss."""
    return OneVsRest(classifier=LinearSVC(regParam=1 / (c * rows), standardization=False, maxIter=10), labelCol="label", parallelism=8)


def boosted(rounds: int = 30, step: float = 0.1) -> GBTRegressor:
    """Boosted regression trees."""
    return GBTRegressor(labelCol="label", maxIter=rounds, stepSize=step, maxDepth=3, minInstancesPerNode=20, seed=42)


def text_features(df: DataFrame, text: str, size: int = 1 << 12) -> DataFrame:
    """``df`` with hashed word and pair counts as a sparse vector."""
    return HashingTF(inputCol="__terms", outputCol="features", numFeatures=size).transform(df.withColumn("__terms", word_grams(F.col(text)))).drop("__terms")


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the columns as one vector; nulls count as 0."""
    return VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="features").transform(df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})).drop(*[f"__{c}" for c in columns])


def rubric_probabilities(df: DataFrame, rubrics: DataFrame, key: str = "id", label: str = "label", fold: str = "fold", folds: int = 5) -> DataFrame:
    """(key, label, probabilities, expected, best): each row against each rubric text, by one binary model per fold.

    ``df`` has terms, an array of words; ``rubrics`` has rubric and words and is a short list. A pair's features are
    the row's words, the rubric's words, and the words they share.
    """
    pairs = df.crossJoin(F.broadcast(rubrics)).withColumn("__terms", F.concat("terms", F.transform("words", lambda w: F.concat(F.lit("r:"), w)), F.transform("terms", lambda w: F.concat(F.lit("x"), F.col("rubric").cast("string"), F.lit(":"), w))))
    pairs = HashingTF(inputCol="__terms", outputCol="features", numFeatures=1 << 12).transform(pairs).withColumn("hit", (F.col("rubric") == F.col(label)).cast("double"))
    model = LogisticRegression(labelCol="hit", regParam=0.01, maxIter=15)
    parts = [model.fit(pairs.filter(F.col(fold) != i)).transform(pairs.filter(F.col(fold) == i)) for i in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    one = F.greatest(F.lit(1e-6), vector_to_array("probability")[1])
    rows = out.groupBy(key, label).agg(F.array_sort(F.collect_list(F.struct("rubric", one.alias("p")))).alias("ps"))
    total = F.aggregate("ps", F.lit(0.0), lambda a, x: a + x.p)
    shares = rows.withColumn("probabilities", F.transform("ps", lambda x: x.p / total))
    expected = F.aggregate(F.transform("probabilities", lambda p, i: p * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return shares.select(key, label, "probabilities", expected.alias("expected"), F.array_position("probabilities", F.array_max("probabilities")).cast("int").alias("best"))


def out_of_fold(df: DataFrame, model: Estimator, key: str = "id", fold: str = "fold", folds: int = 5, first: int = 0) -> DataFrame:
    """(key, fold, label, prediction): every row scored by the model of the other folds. ``df`` has features, label and fold.

    ``first`` is the lowest label; classifiers count theirs from 0.
    """
    df = df.withColumn("label", F.col("label") - first)
    parts = [model.fit(df.filter(F.col(fold) != i)).transform(df.filter(F.col(fold) == i)).select(key, fold, "label", "prediction") for i in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumns({"label": F.col("label") + first, "prediction": F.col("prediction") + first})
