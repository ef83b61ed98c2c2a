"""Exact dedup: grouping by a 128-bit content hash, with a comparison of bytes inside the groups.

1. Rows are grouped by (hash, text): equal means equal bytes, so texts that share a hash by accident fall apart. A task sums what it
   has before it sends anything, so of a text with very many copies each task sends one row; texts cross the network once.
2. Groups of two and more go back to narrow rows (id, digests) by a join on (hash, digest). That is not how the groups are
   partitioned, so both sides are shuffled for the join and adaptive execution may split a hot digest on the row side.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.llm.shared import texts


def content_hash(text):
    return F.unhex(F.md5(text))


def exact_dedup(docs, id_col="doc_id", text_col="text", keep="smallest", hash_of=content_hash):
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of equal texts stays. A null text counts as empty; texts are compared as they are.
    Rows that repeat both id and text count each, and one of them is kept. A null id is the lowest of all ids: it stays only
    where the keeper is a smallest id, or alone. An empty table gives an empty result. Other columns are not read.
    hash_of may be any function of the text; a poor one costs time, not correctness.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    rows = texts(docs, id_col, text_col).withColumn("hash", hash_of(F.col("text")))
    bare = F.count(F.when(F.col("doc_id").isNull(), 1))
    best = F.max("doc_id") if keep == "largest" else F.when(bare == 0, F.min("doc_id"))
    classes = rows.groupBy("hash", "text").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")
    classes = classes.select("hash", F.sha2("text", 256).alias("text_sha256"), "n", "best")
    narrow = (
        rows.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256"))
        .groupBy("doc_id", "hash", "text_sha256").agg(F.count("*").alias("copies"))
    )
    found = F.col("n").isNotNull()
    return (
        narrow.join(classes, ["hash", "text_sha256"], "left")
        .select(
            "doc_id",
            F.when(found, F.col("best")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.when(found, F.col("n")).otherwise(F.lit(1).cast("long")).alias("group_size"),
            "text_sha256",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        )
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256",
        )
    )
