"""The pipeline's stages: what each keeps, against brute force over the stage's own input."""

import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F
from rollbook.llm import quality
from rollbook.llm.shared import saved

from tests.llm.test_kernels import plain_words
from tests.llm.test_operators import brute_links

DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("_kept_0", F.lit(1))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]

    good = saved(stages[names[0]](spark, docs, DIR), "t")
    scores = quality.quality_scores(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    assert good.columns == columns
    assert {r[0] for r in good.select("doc_id").collect()} == {r[0] for r in scores.where(F.col("score") >= 0.3).select("doc_id").collect()}

    repeated = good.unionByName(good.limit(3))  # rows that repeat id and text stay once
    single = saved(stages[names[1]](spark, repeated, DIR), "t")
    first = {}
    for r in good.collect():
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(first.values())

    apart = saved(stages[names[2]](spark, single, DIR), "t")
    links = brute_links([(r["doc_id"], r["text"]) for r in single.collect()])
    assert apart.columns == columns and sorted(r["doc_id"] for r in apart.collect()) == sorted({c for _, c, _, _ in links})

    clean = saved(stages[names[3]](spark, apart, DIR), "t")
    windows = set()
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        w = plain_words(r["text"])
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    quotes = lambda t: any(tuple(w[k:k + n]) in windows for w in [plain_words(t)] for n in sizes for k in range(len(w) - n + 1))
    assert clean.columns == columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in apart.collect() if not quotes(r["text"]))

    last = stages[names[4]](spark, clean, DIR)
    want = {(r["doc_id"], r["sha"]) for r in clean.select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
    assert {(r["doc_id"], r["decoded_sha256"]) for r in last.collect()} == want


def test_run_is_registered(spark):
    queries = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)}
    rows = queries["pipeline"](spark, DIR).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)
