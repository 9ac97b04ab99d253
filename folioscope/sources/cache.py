"""Enrichment behind a cache: what is not cached is fetched in batches inside tasks, with retries, and upserted."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.enrich import remaining, upsert

Fetch = Callable[[list[str]], list[dict]]


def with_retries(fetch: Fetch, attempts: int = 4, pause: float = 1.5) -> Fetch:
    """A fetcher that waits longer after each failure and gives error rows after the last."""

    def run(keys: list[str]) -> list[dict]:
        for attempt in range(attempts):
            try:
                return fetch(keys)
            except Exception as error:  # noqa: BLE001
                if attempt == attempts - 1:
                    return [{"key": k, "error": str(error)[:200]} for k in keys]
                time.sleep(pause * (attempt + 1))
        return []

    return run


def fetched(keys: DataFrame, key: str, fetch: Fetch, schema: T.StructType, batch: int = 100) -> DataFrame:
    """Rows that ``fetch`` gives for the distinct keys, in batches inside each partition."""
    names = schema.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = frame[key].tolist()
            for at in range(0, len(values), batch):
                rows = fetch(values[at : at + batch])
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)

    return keys.select(key).distinct().mapInPandas(run, schema)


def enriched(wanted: DataFrame, cache: DataFrame, key: str, fetch: Fetch, sequence: list[str]) -> DataFrame:
    """The cache with rows for every wanted key: cached ones are kept, the others fetched, the last of each key wins."""
    fresh = fetched(remaining(wanted, cache, [key]), key, with_retries(fetch), cache.schema)
    return upsert(cache, fresh, [key], sequence)


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at the path, or an empty one."""
    files, where = _files(spark, path)
    if files.exists(where):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def first_existing(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The first of the tables that exists, or an empty one."""
    for path in paths:
        files, where = _files(spark, path)
        if files.exists(where):
            return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and quotes doubled; Spark's commit makes it appear whole or not at all."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').csv(str(PurePath(path)))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV written by ``write_csv``; "" and null stay apart, line breaks inside quotes are kept."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "").option("emptyValue", "").csv(path)


def resolved(df: DataFrame, names: list[str]) -> str:
    """The first of the names that the table has; raises where it has none."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {', '.join(names)}")


def rejecting(df: DataFrame, column: str) -> DataFrame:
    """``df`` itself; the job fails at the first null or NaN of the column."""
    number = F.col(column).cast("double")
    return df.withColumn(column, F.when(number.isNull() | F.isnan(number), F.raise_error(F.lit(f"{column} has a null or NaN"))).otherwise(F.col(column)))


def score_family(df: DataFrame, key: str, names: list[str], out: str) -> DataFrame:
    """(key, out): the score column under whichever of the names the table has; a null or NaN fails the job."""
    return rejecting(df.select(key, F.col(resolved(df, names)).alias(out)), out)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def replace_csv(df: DataFrame, path: str, attempts: int = 5, pause: float = 0.5) -> None:
    """CSV written beside the target and put in its place by a rename, tried again after a longer pause each time; readers see the old table or the new one."""
    spark = df.sparkSession
    files, target = _files(spark, path)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    for attempt in range(attempts):
        try:
            write_csv(df, f"{path}.new")
            files.delete(target, True)
            if files.rename(fresh, target):
                return
            raise OSError(f"cannot rename to {path}")
        except Exception:
            if attempt == attempts - 1:
                raise
            time.sleep(pause * (attempt + 1))


def encoded_once(df: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The encoded table at the path; it is made and written there the first time, whole or not at all."""
    spark = df.sparkSession
    files, done = _files(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        encode(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, title: str, style: str = "markdown") -> None:
    """A short report of the rows of ``df`` in their order, one text file: a markdown table under its title, or JSON lines."""
    if style == "json":
        lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    else:
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
        head = [f"# {title}", "", f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
        lines = df.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).union(df.select(cells.alias("value")).coalesce(1))
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_npy(spark: SparkSession, path: str, rows_per_block: int = 1024) -> DataFrame:
    """(file, row, embedding): the rows of the .npy matrices under the path, each file mapped by the task that reads it."""
    import numpy as np

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["file"]:
                matrix = np.load(name.removeprefix("file:"), mmap_mode="r")
                for at in range(0, len(matrix), rows_per_block):
                    block = np.asarray(matrix[at : at + rows_per_block], np.float32)
                    yield pd.DataFrame({"file": name, "row": range(at, at + len(block)), "embedding": list(block)})

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select(F.col("path").alias("file"))
    return names.mapInPandas(run, "file string, row long, embedding array<float>")
