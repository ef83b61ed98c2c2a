"""A corpus from raw documents to token digests, each stage written as Parquet and read again by the next.

Rows pass whole, with all their columns. Null texts count as empty everywhere. Rows that repeat an id and its text are copies of
each other, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.llm import bpe, decontaminate, quality
from rollbook.llm.exact_dedup import exact_dedup
from rollbook.llm.jaccard_join import jaccard_join
from rollbook.llm.shared import saved


def digest():
    """The digest of a text; null counts as empty."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def keep_rows(docs, kept):
    """The rows of docs whose id and text digest are among those of `kept` (null counts as an id); rows that repeat both stay once.

    kept: unique rows (doc_id, text_sha256, rows), the last being how many rows of docs have them.
    """
    own = [f"_kept_{k}" for k in range(4)]
    while set(own) & set(docs.columns):
        own = [f"_{c}" for c in own]
    ids = kept.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "text_sha256", "rows"), own)))
    same = F.col("doc_id").eqNullSafe(F.col(own[0])) & (F.col(own[3]) == F.col(own[1]))
    rows = docs.withColumn(own[3], digest()).join(ids, same).drop(own[0], own[1], own[3])
    once = rows.where(F.col(own[2]) == 1).drop(own[2])
    again = rows.where(F.col(own[2]) > 1).drop(own[2])  # ids that stand in several rows; there are hardly any
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def good_quality(spark, docs, sf_dir):
    """Documents that the classifier scores at its threshold or above stay; an empty or null text has the score of zero features."""
    vectors, network = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(vectors, network)(F.col("text")) >= quality.THRESHOLD)


def exact_copies(spark, docs, sf_dir):
    """Of documents with equal texts the one with the smallest id stays. A null text counts as empty."""
    found = exact_dedup(docs, keep="smallest").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"), F.max("kept").alias("kept"))
    return keep_rows(docs, found.where("kept"))


def near_copies(spark, docs, sf_dir):
    """Of each class of texts linked by similarity the document with the smallest id stays. Texts without words are their own classes.

    Texts are told apart by their digests, so an id that stands on different texts brings none of them back.
    """
    own = docs.select("doc_id", digest().alias("text_sha256"))
    texts = docs.select(F.unhex(digest()).alias("digest"), "text")
    classes = jaccard_join(texts, id_col="digest").select(F.lower(F.hex("doc_id")).alias("text_sha256"), "class_id").distinct()
    counted = own.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
    best = counted.join(classes, "text_sha256").groupBy("class_id").agg(F.min(F.struct("doc_id", "text_sha256", "rows")).alias("best"))
    return keep_rows(docs, best.select("best.*"))


def clean_of_benchmark(spark, docs, sf_dir):
    """Documents without any benchmark window stay, null and empty ones too; one that quotes a benchmark goes whole, not with a gap."""
    hits = decontaminate.hit_words(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.where(hits(F.col("text")) == 0)


def token_digests(spark, docs, sf_dir):
    """The number and digest of the tokens of each document, and the digest of what they decode to; null counts as empty."""
    import public_tokenizers

    return bpe.digest(bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")))


#: Name and function of each stage.
STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("byte-level BPE", token_digests),
]

#: The classifier, the path join and the tokenizer can't be stated in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage{k}")
    return docs
