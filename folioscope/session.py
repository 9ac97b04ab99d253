"""Session building and the few settings every job relies on."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | None = None, app: str = "folioscope", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted session is used instead."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FOLIOSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is configured, one is made on a single machine; a cluster without one raises."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    target = shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(target)
    return target


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder and forget how it was made.

    Every later reader gets the stored rows, so a lost executor costs a re-read and not a re-computation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
