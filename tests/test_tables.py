import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from rollbook import run
from rollbook.operators import aggregate as A
from rollbook.operators import facade
from rollbook.operators import columns as C
from rollbook.operators import order as O
from rollbook.operators import profile as R
from rollbook.operators import quantiles as Q
from rollbook.operators import search as S
from rollbook.operators import sets
from rollbook.operators.sampling import first_values
from rollbook.operators.skew import attach_groups
from rollbook.sources import files, inference


def tuples(df, *columns):
    return [tuple(r[c] for c in (columns or df.columns)) for r in df.collect()]


def test_header_repair():
    assert files.unique_columns([" a", "a", "", "nan", "a", None]) == ["a", "a_2", "Unnamed", "Unnamed_2", "a_3", "None"]


def test_csv_round_trip(spark, frame, tmp_path):
    df = frame(["id", "text"], [("1", 'say "hi", ok'), ("2", " padded "), ("3", "N/A"), ("4", None)])
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), na_tokens=files.NA_TOKENS)
    assert sorted(tuples(back)) == [("1", 'say "hi", ok'), ("2", " padded "), ("3", None), ("4", None)]
    (tmp_path / "d.csv").write_text('x, x ,\n1,"two\nlines",3\n,,\n')
    raw = files.read_csv(spark, str(tmp_path / "d.csv"), multiline=True, trim_cells=True)
    assert raw.columns == ["x", "x_2", "Unnamed"] and tuples(raw) == [("1", "two\nlines", "3")]


def test_row_ids_and_app_view(frame):
    df = frame(["k", "_row_id", "expected_industry", "eval_x"], [("1", "a", "t", "u")])
    assert files.app_view(df).columns == ["k", "_row_id"]
    assert files.with_row_id(df, key="k").first()["__row_id"] == 1


def test_types(frame):
    rows = [(str(i), f"${i}", f"2024-01-{i + 1:02d}", "x" if i else None, "12/1/2024" if i < 7 else "later") for i in range(10)]
    df = files.with_row_id(frame(["id", "money", "day", "word", "mixed"], rows), key="id")
    got = dict(tuples(inference.infer_types(df), "column", "type"))
    assert got == {"id": "number", "money": "number", "day": "date", "word": "text", "mixed": "text"}
    typed = inference.infer_datetimes(df.select(F.col("day").alias("start_date"), F.col("mixed").alias("end_time"), "word"))
    assert [f.dataType.simpleString() for f in typed.schema] == ["timestamp_ntz", "string", "string"]


def test_resolution_ladder():
    columns = ["FirstName", "Surname", "Job Title", "Company Name", "Class Year", "Lifetime Giving"]
    asked = {
        "first_name": "FirstName", "last name": "Surname", "occupation": "Job Title", "JOB TITLE": "Job Title", "job-title": "Job Title",
        "organisation": "Company Name", "grad year": "Class Year", "lifetime_giving": "Lifetime Giving",
    }
    assert {name: C.find_column(columns, name) for name in asked} == asked
    assert C.find_column(columns, "employer", {"employer": ["Surname"]}) == "Surname"
    with pytest.raises(C.UnknownColumn) as caught:
        C.resolve_column(columns, "giving total amount lifetime giving")
    assert caught.value.suggestions == ["Lifetime Giving"]
    assert C.resolve_columns(columns, ["Surname", "surname", "zip"]) == ["Surname"]


def test_display(frame):
    df = frame(["Name", "_x", "expected_y", "Match Reason", "City", "name!", "Email", "Reason"], [("a",) * 8])
    assert C.display_columns(df).columns == ["Name"]
    assert C.display_columns(df, ("email", "location")).columns == ["Name", "City", "Email"]
    people = frame(["LinkedIn", "given name", "Family Name", "role", "company", "Major"], [("a",) * 6])
    assert C.people_columns(people).columns == ["First Name", "Last Name", "Occupation", "Employer", "LinkedIn URL"]
    assert C.people_columns(people, requested=["Major", "linkedin", "role"]).columns == ["Occupation", "Major", "LinkedIn URL"]


def test_search(frame):
    df = frame(["id", "job", "firm"], [("1", "Data Lead", "Data Co"), ("2", "Analyst", "data inc"), ("3", " ", None), ("4", "Lead Analyst", "x")])
    rows = tuples(S.contains_any(df, ["job", "firm"], ["data", "LEAD"]).orderBy("id"), "id", "matched_column", "matched_term", S.REASON)
    assert rows == [
        ("1", "job", "data, LEAD", "Matched job: Data Lead"), ("2", "firm", "data", "Matched firm: data inc"),
        ("4", "job", "LEAD", "Matched job: Lead Analyst"),
    ]
    assert tuples(S.contains_all(df, ["job", "firm"], ["data", "lead"]), "id") == [("1",)]
    assert S.search_text(df, ["job"], ["data"], case_sensitive=True).count() == 0
    both = [{"columns": ["job"], "terms": ["data"]}, {"columns": ["firm"], "terms": ["data"]}]
    assert tuples(S.contains_all(df, groups=both).orderBy("id"), "id") == [("1",), ("2",)]
    metrics = S.search_metrics(df, ["job", "firm"], ["data", "lead"], limit=2).first()
    assert tuple(metrics) == (4, 4, 3, 2, True)
    assert tuples(S.filter_equals(df, "job", "ANALYST"), "id") == [("2",)]
    assert tuples(S.filter_equals(df, "firm", ""), "id") == [("3",)]
    assert tuples(S.filter_missing(df, "job"), "id") == [("3",)]
    with pytest.raises(ValueError):
        S.search_text(df, ["job"], [" "])


def test_groups(frame):
    df = frame(["g", "v"], [("x", "$100"), ("x", "bad"), ("y", "50%"), ("y", "-10"), ("z", None), (" ", "7"), (None, "1")])
    assert tuples(A.group_by_count(df, "g")) == [("Missing", 2), ("x", 2), ("y", 2), ("z", 1)]
    assert tuples(A.group_by_sum(df, "g", "v")) == [("x", 100.0), ("y", 40.0), ("Missing", 8.0)]
    assert tuples(A.group_by_average(df, "g", "v", limit=1)) == [("x", 100.0)]
    assert tuple(A.group_by_metrics(df, "v").first()) == (5, 7, 2)
    assert tuples(A.group_by_agg(df, "g", "v", "min")) == [("y", -10.0), ("Missing", 1.0), ("x", 100.0)]
    assert dict(tuples(A.group_by_agg(df, "g", "v", "sum"))) == {"x": 100.0, "y": 40.0, "Missing": 8.0, "z": 0.0}
    assert tuples(A.value_counts(df, "g", limit=1)) == [("x", 2)]
    assert tuple(A.unique_metrics(df, "g").first()) == (3, 7)


def test_months(frame):
    df = frame(["d", "v"], [("2024-01-05", "1"), ("2024-01-09", "x"), ("Mar 3, 2024", "5"), ("soon", "9"), (None, "2")])
    assert tuples(A.group_by_month(df, "d")) == [("2024-01", 2), ("2024-03", 1)]
    assert tuples(A.group_by_month(df, "d", "v", "sum", limit=1)) == [("2024-03", 5.0)]
    assert A.group_by_month(df, "v").count() == 0
    with pytest.raises(ValueError):
        A.group_by_month(df, "d", None, "sum")


def test_correlation_skips_constant_columns(frame):
    df = frame(None, [(1.0, 2.0, 3.0), (2.0, 4.0, 3.0), (3.0, None, 3.0), (4.0, 9.0, 3.0)], "a double, b double, c double")
    rows = tuples(A.correlation(df), "Column 1", "Column 2", "Correlation")
    assert [r[:2] for r in rows] == [("a", "b")]
    assert math.isclose(rows[0][2], statistics.correlation([1, 2, 4], [2, 4, 9]))
    assert A.correlation_pair(df, "a", "b").first()["n"] == 3


@pytest.mark.parametrize("few_rows", [1_000_000, 40])
def test_numeric_summary(frame, few_rows):
    values = [random.Random(3).gauss(0, 50) for _ in range(301)] + [7.0] * 200
    df = frame(None, [(v,) for v in values] + [(None,)], "v double", partitions=5)
    row = R.numeric_summary(df, few_rows=few_rows).first()
    assert (row["Count"], row["Missing"]) == (501, 1)
    for name, want in (("Median", statistics.median(values)), ("Mean", statistics.fmean(values)), ("Standard Deviation", statistics.stdev(values))):
        assert math.isclose(row[name], want, rel_tol=1e-9), name


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_against_brute_force(frame, seed):
    rng = random.Random(seed)
    shapes = [lambda: rng.random(), lambda: rng.choice([1.0, 2.0]), lambda: 10 ** rng.uniform(-12, 12), lambda: float(rng.randrange(9)) - 4]
    columns = [[shape() for _ in range(400)] for shape in shapes]
    columns[2][:3] = [math.inf, -math.inf, math.inf]
    df = frame(None, list(zip(*columns)), "a double, b double, c double, d double", partitions=3)
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = Q.exact_quantiles(df, {n: F.col(n) for n in "abcd"}, probabilities, few_rows=5)

    def want(values, p):
        values, at = sorted(values), (len(values) - 1) * p
        low, high = values[math.floor(at)], values[math.ceil(at)]
        return low if low == high else low + (high - low) * (at - math.floor(at))

    for name, values in zip("abcd", columns):
        assert got[name] == pytest.approx([want(values, p) for p in probabilities], rel=1e-12)
    assert Q.exact_quantiles(df.limit(0), {"a": F.col("a")}, (0.5,)) == {"a": [None]}


def test_profiles(frame):
    rows = [(str(i), "$%d" % i, str(1990 + i), ["x", "y", None][i % 3], f"1/{i + 1}/2024") for i in range(12)]
    df = files.with_row_id(frame(["id", "gift", "grad_year", "tag", "seen"], rows), key="id")
    flags = {r["column"]: r for r in R.profile_flags(df).collect()}
    assert flags["gift"]["currency"] and not flags["gift"]["year"] and flags["grad_year"]["year"]
    assert (flags["seen"]["type"], flags["tag"]["type"], flags["tag"]["missing"], flags["tag"]["total_missing"]) == ("date", "text", 4, 4)
    summary = {r["Column"]: tuple(r)[1:] for r in R.column_summary(df, ["tag", "gift", "seen"]).collect()}
    assert summary["tag"] == ("text", 8, 4, 2, "x, y, x")
    assert summary["gift"] == ("number", 12, 0, 12, "$0, $1, $2") and summary["seen"][0] == "date"
    context = {r["column"]: r for r in R.dataset_context(df).collect()}
    assert context["tag"]["low_cardinality_values"] == ["x", "y"] and context["id"]["sample_values"] == list("01234")
    assert tuples(R.missing_values(df, ["tag", "id"])) == [("tag", 4, 33.33), ("id", 0, 0.0)]
    top = R.categorical_summary(df.select("tag")).orderBy("rank").collect()
    assert [(r["value"], r["count"], r["unique_count"], r["missing_count"]) for r in top] == [("x", 4, 2, 4), ("y", 4, 2, 4)]
    assert R.duplicate_count(df.select("tag")).first()[0] == 9
    assert tuples(R.column_profile(df, "tag"), "value", "count", "unique") == [("x", 4, 2), ("y", 4, 2)]


def test_first_values_beyond_the_head(frame):
    rows = [(i, None if i < 900 else f"v{i % 4}", "a") for i in range(1000)]
    df = frame(None, rows, "_row_id long, late string, early string", partitions=4)
    got = {(r["column"], r["position"]): r["value"] for r in first_values(df, ["late", "early"], 2).collect()}
    assert got == {("late", 900): "v0", ("late", 901): "v1", ("early", 0): "a", ("early", 1): "a"}
    distinct = first_values(df, ["late", "early"], 3, distinct=True).collect()
    assert sorted((r["column"], r["value"]) for r in distinct) == [("early", "a"), ("late", "v0"), ("late", "v1"), ("late", "v2")]


def test_order(frame):
    df = files.with_row_id(frame(["id", "v", "t"], [("1", "$9", "b"), ("2", "10", "A"), ("3", "x", None), ("4", "10", "C")]), key="id")
    assert [r["id"] for r in O.sort_rows(df, "v").collect()] == ["1", "2", "4", "3"]
    assert [r["id"] for r in O.sort_rows(df, "v", ascending=False).collect()] == ["2", "4", "1", "3"]
    assert [r["id"] for r in O.sort_rows(df, "t").collect()] == ["2", "1", "4", "3"]
    assert [r["id"] for r in O.top_n(df, "v", 1).collect()] == ["2"]
    assert [r["id"] for r in O.bottom_n(df, "v", 2).collect()] == ["1", "2"]
    assert [r["id"] for r in O.top_rows(df, "t").collect()] == ["4", "1", "2", "3"]
    with pytest.raises(ValueError):
        O.top_n(df, "t")


def test_attach_groups_joins_null_keys(frame):
    rows = [(None if i % 3 == 0 else f"k{i % 5}" if i % 3 == 1 else "hot", i) for i in range(300)]
    df = frame(None, rows, "k string, i long", partitions=6)
    groups = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    got = sorted(tuples(attach_groups(df, groups, ["k"]), "i", "n", "first"))
    sizes, first = {}, {}
    for k, i in rows:
        sizes[k] = sizes.get(k, 0) + 1
        first.setdefault(k, i)
    assert got == sorted((i, sizes[k], first[k]) for k, i in rows)


def test_duplicates(frame):
    df = frame(["a", "b"], [("1", None), ("1", None), ("2", "x"), (None, "y"), (None, "z")])
    assert sorted(tuples(O.duplicate_rows(df)), key=str) == [("1", None), ("1", None)]
    assert O.duplicate_rows(df, ["a"], limit=None).count() == 4
    assert tuple(O.duplicate_metrics(df, ["a"]).first()) == (4, 5)


def test_duplicates_with_odd_headers(frame):
    df = frame(["No. of events", "b"], [("1", "x"), ("1", "y"), ("2", "z")])
    assert sorted(tuples(O.duplicate_rows(df, ["No. of events"]))) == [("1", "x"), ("1", "y")]
    assert tuples(O.duplicate_rows(df, ["No. of events"], limit=1)) in ([("1", "x")], [("1", "y")])


def test_dates_after_the_first_values(frame):
    """A text column whose first eleven values are no dates."""
    rows = [(f"text {i}", "1") for i in range(11)] + [(f"2024-03-{d:02d}", "2") for d in range(1, 29)] * 2
    df = frame(["seen", "v"], rows)
    assert tuples(R.date_summary(df, ["seen"]), "Column", "Parsed Count") == [("seen", 56)]
    assert [r["Column"] for r in R.date_summary(df).collect()] == ["seen"]
    assert tuples(A.group_by_month(df, "seen")) == [("2024-03", 56)]
    assert S.date_range_filter(df, "seen", "2024-03-28").count() == 2


def test_all_text_columns_are_searched(frame):
    df = frame([f"c{i}" for i in range(12)], [tuple("hit" if i == 11 else "miss" for i in range(12))])
    assert S.contains_any(df, terms=["hit"]).first()["matched_column"] == "c11"
    wide = frame(["Title", "remark"], [("x", "hit")])
    assert S.contains_any(wide, terms=["hit"]).count() == 1


def test_row_ids_without_a_key_stay(spark, frame):
    df = files.with_row_id(frame(["a"], [(str(i),) for i in range(50)], partitions=7))
    first = {r["a"]: r["_row_id"] for r in df.collect()}
    assert len(set(first.values())) == 50 and {r["a"]: r["_row_id"] for r in df.orderBy("a").collect()} == first


def test_facade_parameters(frame):
    df = files.with_row_id(frame(["id", "name", "v", "city"], [("1", "Ann", "5", "Rome"), ("2", "Bo", "7", "Rome"), ("3", "Cy", "6", "Oslo")]), key="id")
    top = facade.run(df, {"type": "top_n", "params": {"column": "v", "n": 2, "return_columns": ["name"]}}).rows
    assert tuples(top) == [("Bo",), ("Cy",)]
    found = facade.run(df, {"type": "filter_predicates", "params": {
        "logic": "and", "predicates": [{"operator": "equals", "columns": ["city"], "values": ["rome"]}], "return_columns": ["name"], "limit": 1,
    }}).rows
    assert tuples(found) == [("Ann",)]
    hits = facade.run(df, {"type": "contains_any", "params": {"term": "o", "columns": ["name", "city"], "display_columns": ["id"], "limit": 2}}).rows
    assert hits.columns[:1] == ["id"] and "matched_column" in hits.columns and hits.count() == 2
    with pytest.raises(ValueError, match="no parameter 'rows'"):
        facade.run(df, {"type": "top_n", "params": {"column": "v", "rows": 2}})
    for kind in facade.OPERATIONS:
        assert kind in facade.PARAMETERS


def test_sets(frame):
    a, b = (frame(None, [(i, tag) for i in ids], "_row_id long, tag string") for ids, tag in (([1, 2], "a"), ([2, 3], "b")))
    assert sorted(tuples(sets.union_rows(a, b))) == [(1, "a"), (2, "a"), (3, "b")]
    assert tuples(sets.intersect_rows(a, b)) == [(2, "a")] and tuples(sets.except_rows(a, b)) == [(1, "a")]


def test_facade(frame):
    df = files.with_row_id(frame(["id", "job", "v"], [("1", "lead", "5"), ("2", "clerk", "7"), ("3", "lead", "")]), key="id")
    assert tuples(run(df, {"type": "group_by_sum", "params": {"group_by": "job", "value_column": "v"}}).rows) == [("clerk", 7.0), ("lead", 5.0)]
    found = run(df, {"type": "contains_any", "params": {"columns": ["job"], "terms": ["lead"]}})
    assert found.rows.count() == 2 and found.metrics.first()["matched_row_count"] == 2
    tree = {"logic": "and", "predicates": [{"operator": "greater_than", "columns": ["v"], "values": [1]}]}
    got = run(df, {"type": "filter_predicates", "params": {**tree, "sort": {"column": "v", "direction": "desc"}}})
    assert [r["id"] for r in got.rows.collect()] == ["2", "1"] and got.metrics.first()["matched_row_count"] == 2
    jobs = {"filter_mode": "people", "people_filter": {"filter_type": "occupation", "occupation_terms": ["lead"]}}
    assert run(df, {"type": "contains_any", "params": jobs}).metrics.first()["total_matches"] == 2
    mixed = {"people_operation": {"type": "contains_any", "params": jobs}, **tree}
    got = run(df, {"type": "composite_people_filter", "params": mixed})
    assert got.rows.filter("bucket = 'counted'").count() == 1 and got.metrics.first()["direct_count"] == 1
    for bad in ({"type": "drop_table"}, {"type": "top_n", "params": {"column": "nothing here"}}, {"type": "sort_rows", "params": {}}):
        with pytest.raises(ValueError):
            run(df, bad)


def test_quantiles_of_the_least_denormals(frame):
    from rollbook.operators import profile as R

    df = frame(["v"], [(0.0,), (5e-324,), (5e-324,), (0.0,), (0.0,)], schema="v double")
    row = R.numeric_summary(df, few_rows=1).first() if "few_rows" in R.numeric_summary.__code__.co_varnames else R.numeric_summary(df).first()
    assert row["Median"] == 0.0
