"""A keep-last table fed by a stream: each micro-batch is reduced, merged by key and written beside the old version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.ranking import keep_last


def keep_last_stream(spark: SparkSession, source: str, target: str, checkpoint: str, keys: list[str], sequence: list[str], files_per_batch: int = 1):
    """Starts a query that keeps the last row of each key of the Parquet files under ``source`` in ``target/v=N``."""
    schema = spark.read.parquet(source).schema

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = keep_last(batch, keys, sequence)
        if epoch:
            rows = keep_last(rows.unionByName(spark.read.parquet(f"{target}/v={epoch - 1}")), keys, sequence)
        rows.write.mode("overwrite").parquet(f"{target}/v={epoch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): tumbling windows, for streams with a watermark and for tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
