"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the jobs rely on; cluster sizing is left to the cluster."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A fixture may hold a third of all quotes: split it even if that costs one more exchange.
    conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Medians are per fixture over a few books, so many small buffers fit before sorting is needed.
    conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16384")
    conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    # Rows may hold long texts: hand them to Python in small batches.
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local runs that name none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="ratewright-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint, so that lost executors do not change or redo it."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
