"""Vocabulary lookup, ranks, products of columns, row ids, free dates, provenance and streams, against plain forms of the same."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from rollbook.functions.free_dates import parse_free_date
from rollbook.functions.text import company_match, has_term, norm_company, norm_text, norm_title
from rollbook.operators import aggregate, columns as C
from rollbook.operators.ranks import ranked
from rollbook.plans import classify as K
from rollbook.plans import lookup, people as H
from rollbook.plans import schema_map as M
from rollbook.plans.taxonomy import SEED, TermTable
from rollbook.sources import files

TEXTS = (
    "software engineer", "at&t labs", "r&d lead", "outlaw firms", "law firm", "a b", "a", "", "senior data scientist r & d", "smith & cole", "c", "x law", "school y",
    "data sci", "engineers", "lab", "& cole", "bank of a", "o brien", "aa bb",
)
PHRASES = ("engineer", "law firm", "law school", "r&d", "a b", "a", "data scient", "& cole", "r & d", "labs", "at&t", "&", "bank of", "!!", "", "b", "cole", "law", "aa bb cc", "at", "t labs")


def test_lookup_finds_what_the_plan_finds(spark):
    texts = [t for t in TEXTS] + [f"{a} {b}" for a in TEXTS[:6] for b in TEXTS[8:14]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, texts[3]), (901, "")], "id long, raw string")
    rows = rows.withColumns({"_t": norm_title("raw"), "_c": norm_company("raw")})
    terms = spark.createDataFrame([(k, t) for k, t in enumerate(PHRASES)], "k int, t string")
    fields = F.explode(F.array(F.lit("t"), F.lit("c"), F.lit("both")))
    table = terms.select(fields.alias("field"), "k", "t")
    whole = F.col("field") == "c"
    table = table.select("field", F.when(whole, norm_company("t")).otherwise(norm_title("t")).alias("term"), whole.alias("whole"), F.concat("field", F.lit(":"), "k").alias("code"))
    got = {r["id"]: set(r["_hits"] or ()) for r in lookup.attach_hits(rows, {"t": ("_t",), "c": ("_c",), "both": ("_t", "_c")}, table).collect()}
    both = F.btrim(F.concat_ws(" ", "_t", "_c"))
    tests = {f"t:{k}": has_term(F.col("_t"), [t]) for k, t in enumerate(PHRASES)} | {f"c:{k}": company_match(F.col("_c"), [t]) for k, t in enumerate(PHRASES)}
    tests |= {f"both:{k}": has_term(both, [t]) for k, t in enumerate(PHRASES)}
    signs = {f"{f}:{k}" for k, t in enumerate(PHRASES) for f in ("t", "both") if re.fullmatch(r"[^a-z0-9]+", t)}  # words of signs only stand nowhere alone
    want = {r["id"]: {c for c in tests if r[c] and c not in signs} for r in rows.select("id", *(v.alias(c) for c, v in tests.items())).collect()}
    assert {i: h - signs for i, h in got.items()} == want


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(3)
    titles = ["Software Engineer", "Nurse", "Consultant", "", None, "Marketing Manager", "Law Clerk", "Head of Growth"]
    firms = ["Google", "General Hospital", "McKinsey & Company", None, "First Bank", "Acme Labs", "Orbit Cloud"]
    rows = [(i, rng.choice(["Ann", "Bo", None]), rng.choice(["Lee", "Ray"]), rng.choice(titles), rng.choice(firms), rng.choice(["hospital", None, "software"]), f"u{i}@x.com") for i in range(200)]
    return files.with_row_id(spark.createDataFrame(rows, "id long, `First Name` string, `Last Name` string, Occupation string, Employer string, `Employer Description` string, Email string"), key="id")


def seed_table(spark):
    rows = [(i, kind, t) for i in SEED for kind in ("title", "employer", "company", "exclusion", "ambiguous", "generic") for t in SEED.terms(i, kind)]
    return TermTable(spark.createDataFrame(rows, "industry string, kind string, term string"))


def test_a_table_of_terms_classifies_like_terms_in_the_plan(spark, people):
    loaded = seed_table(spark)
    for spec in (K.QuerySpec(("tech",)), K.QuerySpec(("healthcare", "consulting"), required=("finance",)), K.QuerySpec(("government",), excluded=("law",))):
        a, b = (K.classify(people, spec, t).orderBy("id").collect() for t in (SEED, loaded))
        assert a == b
    for f in (lambda t: K.profile_people(people, t), lambda t: K.match_industry(people, "tech", t), lambda t: K.company_industries(people, "Employer", t)):
        assert f(SEED).orderBy("id").collect() == f(loaded).orderBy("id").collect()
    big = spark.range(5000).select(F.lit("tech").alias("industry"), F.lit("title").alias("kind"), F.concat(F.lit("filler role "), "id").alias("term"))
    small, large = (K.classify(people, K.QuerySpec(("tech",)), TermTable(t)) for t in (loaded.table, loaded.table.unionByName(big)))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(large) < 1.2 * size(small) + 2000
    assert large.select("id", "classification").orderBy("id").collect() == small.select("id", "classification").orderBy("id").collect()
    with pytest.raises(ValueError):
        TermTable(spark.createDataFrame([("a", "nonsense", "b")], "industry string, kind string, term string"))


def test_people_filters_are_planned_quickly(people):
    group = {"type": "group", "logic": "and", "clauses": [{"type": "predicate", "predicate": {"operator": "exists", "columns": ["Email"], "values": []}}]}
    H.people_filter(people, K.QuerySpec(("tech",)))._jdf.queryExecution().executedPlan()
    for make in (
        lambda: H.people_filter(people, K.QuerySpec(("tech",))), lambda: H.composite_filter(people, K.QuerySpec(("consulting",)), group, "and"),
        lambda: H.composite_filter(people, K.QuerySpec(("tech",)), group, "or"),
    ):
        start = time.time()
        plan = make()._jdf.queryExecution().executedPlan().toString()
        assert time.time() - start < 6
        assert plan.count("Exchange hashpartitioning(_person") == 1


def test_retrieval_terms_come_from_the_vocabulary(spark, people):
    terms = spark.createDataFrame(
        [("Tech", "company", "Google"), ("tech", "retrieval", "engineer"), ("tech", "retrieval", "Google "), ("care", "retrieval", "nurse"), ("tech", "title", "manager")],
        "industry string, kind string, term string",
    )
    got = H.candidate_metrics(people, K.QuerySpec(("tech",)), ("Clerk",), ["Occupation", "Employer"], TermTable(terms), retrieval=True).first()
    hits = [
        sum(any(term in f"{(x or '').lower()}".split() or term in (x or "").lower() for x in (r["Occupation"], r["Employer"])) for term in ("google", "engineer", "clerk"))
        for r in people.collect()
    ]
    assert (got["raw_match_count"], got["candidate_count"]) == (sum(hits), sum(h > 0 for h in hits))


def test_ranks_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 30), i) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(5)
    got = {(r["g"], r["i"]): r["rank"] for r in ranked(df, ["g"], [F.desc("v"), F.col("i")], parts=7).collect()}
    for g in ("a", "b", None):
        ordered = sorted(((-v, i) for h, v, i in rows if h == g))
        assert [got[g, i] for _, i in ordered] == list(range(1, len(ordered) + 1))
    assert ranked(df.limit(0), ["g"], [F.col("i")]).count() == 0
    assert ranked(df, ["g"], [F.desc("v"), F.col("i")], limit=2).count() == 6


def test_correlations_of_many_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20)) * 10.0 ** rng.integers(-3, 6, 20) + 10.0 ** rng.integers(0, 7, 20)
    x[:, 3] = 7
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [tuple(None if math.isnan(v) else float(v) for v in line) for line in x]
    rows[5] = (float("inf"), *rows[5][1:])
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(20))).repartition(4)
    a, b, c = ({(r[0], r[1]): r[2] for r in aggregate.correlation(df, few=few, block=block).collect()} for few, block in ((100, 9), (2, 100), (2, 7)))
    a = {k: v for k, v in a.items() if "c3" not in k}
    assert set(b) == set(c) and {k for k in a if "c0" not in k} == {k for k in b if "c0" not in k} and not any("c3" in k for k in b)
    for k in a:
        if "c0" not in k:
            assert b[k] == pytest.approx(a[k], abs=1e-6) and c[k] == pytest.approx(a[k], abs=1e-6)


def test_row_ids_from_files(spark, tmp_path):
    spark.range(1000).repartition(4).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    first = files.with_row_id(df)
    ids = {r["id"]: r["_row_id"] for r in first.collect()}
    assert len(set(ids.values())) == 1000
    again = files.with_row_id(spark.read.parquet(str(tmp_path / "t")).where("id % 3 = 1"))
    assert all(ids[r["id"]] == r["_row_id"] for r in again.repartition(3).collect()) and again.count() == 333
    for bad in ([(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(ValueError):
            files.with_row_id(spark.createDataFrame(bad, "k long"), key="k")


@pytest.mark.parametrize("text, day", [
    ("2nd January 2025", "2025-01-02"), ("January 2nd, 2025", "2025-01-02"), ("Wed 1 May 2024", "2024-05-01"), ("13/02/2024", "2024-02-13"), ("02/13/2024", "2024-02-13"),
    ("2024 March 5", "2024-03-05"), ("5 March '24", "2024-03-05"), ("20240305", "2024-03-05"), ("2024-03-05 7:05am", "2024-03-05"), ("7 pm 3 May 2001", "2001-05-03"),
    ("may 2001", "2001-05-01"), ("31 April 2024", None), ("2024", None), ("", None), ("tomorrow", None), ("1.2", None), ("25:00 2024-01-01", None), ("May May 2024", None),
    ("Mon Tue 5 May 2024", None), ("2024-01-01 2024-01-02", None), ("12345", None), ("x2024-01-01", None),
])
def test_free_dates(text, day):
    found = parse_free_date(text)
    assert (found.isoformat() if found else None) == day


def test_similar_headers(spark):
    df = spark.createDataFrame([("1", "works at Goldman-Sachs", "x")], "`Person Nr` string, notes string, emplyer string")
    assert C.semantic_column(df, ["employer"]) == "emplyer" and C.semantic_column(df, ["employer"], entities=["goldman sachs"]) == "notes"
    assert C.semantic_column(df, ["person number", "PERSON NR"]) == "Person Nr" and C.semantic_column(df, ["zzz"]) is None and C.semantic_column(df, []) is None


def test_evidence_and_open_conflicts(spark, frame):
    df = frame(["City", "Home City", "E1", "Email 2", "Role", "Title", "zz"], [("a", "b", "x@a.com", "y@b.org", "r", "t", "q"), ("a", "b", "z@a.com", "w@b.org", "r", "t", "q")])
    profile = {r["canonical_field"]: r for r in M.infer_schema(df).collect()}
    assert profile["email"]["source_columns"] == ["Email 2", "E1"] and profile["email"]["method"] == "combined_inference" and len(profile["email"]["evidence"]) == 2
    conflicts = M.schema_conflicts(df)
    assert {tuple(r["canonical_fields"]) for r in conflicts.collect()} == {("city",), ("occupation",)}
    for mapping, left in (({"city": ["City"]}, {"occupation"}), ({"nickname": ["Home City"]}, {"occupation"}), ({"occupation": ["zz"]}, {"city"}), ({"phone": ["zz"]}, {"city", "occupation"})):
        confirmed = M.confirmed_profile(spark, mapping)
        assert {r["canonical_fields"][0] for r in M.open_conflicts(conflicts, confirmed).collect()} == left
    assert M.open_conflicts(conflicts, confirmed, reset=True).count() == 2
    assert [r["source"] for r in M.unmapped_columns(M.infer_schema(df), df.columns, ignored=["zz"]).orderBy("ordinal").collect()] == ["City", "Home City", "Role", "Title"]
    state = M.profile_state(M.infer_schema(df), M.confirmed_profile(spark, {"city": ["City"]}), conflicts, df.columns, ignored=["zz", "City", "gone"], status="new").first()
    assert (state["status"], state["unmapped_columns"], state["ignored_columns"], state["conflicts"]) == ("unreviewed", ["Home City", "Role", "Title"], ["zz"], 1)


def test_rates_weigh_repeated_values(spark, frame):
    df = frame(["m"], [("a@b.com",)] * 3 + [("no",), (" ",), (None,)])
    row = M.sample_rates(df).first()
    assert (row["filled"], row["email_rate"]) == (4, 0.75)
    assert M.sample_rates(df, asked={"date": ["m"]}).first()["email_rate"] == 0
    assert M.sample_rates(df, asked={}).count() == 0


def test_row_wise_operators_run_on_a_stream(spark, people, tmp_path):
    from rollbook.functions.emails import extract_emails
    from rollbook.operators.predicates import compile_group

    people.repartition(3).write.parquet(str(tmp_path / "in"))
    group = {"type": "group", "logic": "and", "clauses": [{"type": "predicate", "predicate": {"operator": "contains", "columns": ["Email"], "values": ["u1"]}}]}

    def work(df):
        rows = K.classify(df.where(F.coalesce(compile_group(df, group), F.lit(False))), K.QuerySpec(("tech",)), details=False)
        return rows.select("id", "classification", extract_emails(F.col("Email")).alias("mails"), norm_text("Employer").alias("firm"))

    batch = work(spark.read.parquet(str(tmp_path / "in")))
    stream = work(spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert len(got) > 50 and got == batch.orderBy("id").collect()
