"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "keystead", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators are written for.

    Shuffle width is left to AQE: a high initial partition number that is
    coalesced at run time suits both a laptop and a large cluster.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """Fresh folder for streaming state and intermediate tables.

    On a cluster this lies below the shared folder named in
    ``spark.checkpoint.dir``; only where that is unset (tests, laptop) a
    local temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="keystead-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For results that several later steps scan: they then read a file instead of
    repeating the work, and a lost executor costs no recomputation of it.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """A table written to the shared folder partition by partition, which keep their rows, order and numbers."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession, "kept"))
    return df.checkpoint()
