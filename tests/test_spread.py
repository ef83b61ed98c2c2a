"""Rows of one split are dealt over tasks before work that is heavy for each row."""

from pyspark.sql import functions as F

from rollbook.operators.skew import spread
from rollbook.plans import classify as K
from rollbook.plans import people as H
from rollbook.plans.classify import QuerySpec
from rollbook.plans.taxonomy import TermTable


def test_spread_keeps_all_rows_and_fills_several_partitions(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 2 = 0, null, 'same') as v").coalesce(1)
    dealt = spread(df)
    assert dealt.columns == df.columns
    assert sorted(dealt.collect(), key=lambda r: r["id"]) == sorted(df.collect(), key=lambda r: r["id"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in spread(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 2 * 5000 / len(sizes)


def test_people_are_judged_after_their_rows_are_dealt(spark):
    df = spark.createDataFrame([(1, "Ann", "Lee", "Software Engineer", "Google")], "_row_id long, first_name string, last_name string, occupation string, employer string")
    found = H.people_filter(df, QuerySpec(("tech",)))
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deal = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    assert not any("RLIKE" in line.upper() for line in lines[deal:])
    assert {r["bucket"] for r in found.collect()} == {"counted", "direct"}


def test_a_loaded_vocabulary_is_folded_after_its_terms_are_dealt(spark):
    """Terms of kinds that nobody asks for are not read, and folding starts behind the shuffle."""
    terms = spark.range(1).select(F.lit("Tech").alias("industry"), F.lit("company").alias("kind"), F.concat(F.lit("Acme "), F.col("id") + 1, F.lit(" Inc")).alias("term"))
    unread = spark.range(1).select(F.lit("tech").alias("industry"), F.lit("exclusion").alias("kind"), F.concat(F.lit("unread "), "id").alias("term"))
    blank = spark.range(1).select(F.lit("care").alias("industry"), F.lit("company").alias("kind"), F.lit(" -- ").alias("term"))
    vocabulary = TermTable(terms.unionByName(unread).unionByName(blank))
    assert vocabulary.industries == {"tech", "care"}
    df = spark.createDataFrame([(1, "ACME 1, Inc."), (2, "Acme 10"), (3, ""), (4, None)], "_row_id long, employer string")
    found = K.company_industries(df, taxonomies=vocabulary)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deal = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    assert not any("unread" in line or "[^a-z0-9]+,  " in line for line in lines[deal:])
    assert {r["_row_id"]: r["industries"] for r in found.collect()} == {1: ["tech"], 2: [], 3: [], 4: []}
