"""Tables written to the folder that all executors share, and small checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def folder(spark):
    """The folder named by spark.checkpoint.dir; only a local session without the setting gets one of its own."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder that every executor can reach.")
    made = tempfile.mkdtemp(prefix="rollbook-llm-")
    spark.conf.set(CHECKPOINT_SETTING, made)
    return made


def saved(df, name):
    """The table written as Parquet to the shared folder and read again: lost executors cost a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_groups(rows, groups, key, how="inner"):
    """Rows joined with groups, which have one row per key.

    Keys are compared null-safe. So the groups, if they come from an aggregation by the key, are shuffled anew for the join, and
    adaptive execution may split the rows of a hot key; behind a plain comparison it would have to leave them in one task.
    """
    named = groups.withColumnRenamed(key, f"_{key}")
    return rows.join(named, rows[key].eqNullSafe(named[f"_{key}"]), how).drop(f"_{key}")


def bounded_rows(df, limit, what):
    """Rows of a table that must be small, on the driver; a larger one raises before it gets there whole."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def texts(docs, id_col="doc_id", text_col="text", null_as_empty=True):
    """Only the id and the text, under names of our own, so that further columns can't clash."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(text, F.lit("")) if null_as_empty else text).alias("text"))
