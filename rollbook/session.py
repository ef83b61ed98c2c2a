"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def tuned_session(master=None, name="rollbook", **settings):
    """A session with adaptive execution on and timestamps in UTC; callers may override any setting."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # The JVM does not compile methods above 8000 bytes. Above the limit Spark drops whole-stage code for smaller methods.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark):
    """The folder all executors can reach. The cluster names it; a local run without one gets a temporary folder."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder that every executor can reach.")
    folder = tempfile.mkdtemp(prefix="rollbook-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def saved(df, name):
    """The table written to the shared folder and read again: it stays as it is, and a lost executor costs one read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
