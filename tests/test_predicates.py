import pytest
from pyspark.sql import functions as F

from rollbook.operators import predicates as P

COLUMNS = ["name", "giving", "events", "contact", "city", "manager", "email", "email2"]
ROWS = [
    ("a", "$5,000", "3", "2024-05-17", "New York", None, "a@alpha.edu", "x@beta.com"),
    ("b", "10,000", "0", "2025-01-02", " boston", "Sam", "b@mail.alpha.edu; b@beta.com", None),
    ("c", "N/A", "7", "bad date", "Boston", "", "nobody", "c@alpha.edu"),
    ("d", "(50)", None, "", None, "none", "d@notalpha.edu", ""),
    ("e", "100", "12", None, "San  Jose", "Lee", "", "e@beta.com"),
]


@pytest.fixture(scope="module")
def people(frame):
    return frame(COLUMNS, ROWS)


def leaf(operator, columns, *values, **options):
    columns = [columns] if isinstance(columns, str) else columns
    return {"type": "predicate", "predicate": {"operator": operator, "columns": columns, "values": list(values), **options}}


def group(logic, *clauses):
    return {"type": "group", "logic": logic, "clauses": list(clauses)}


def names(df, *clauses, logic="and"):
    return "".join(sorted(r["name"] for r in df.filter(P.compile_group(df, group(logic, *clauses))).collect()))


@pytest.mark.parametrize(
    ("clause", "expected"),
    [
        (leaf("exists", "manager"), "be"), (leaf("missing", "manager"), "acd"), (leaf("missing", "city"), "d"),
        (leaf("equals", "city", "BOSTON", "new york"), "abc"), (leaf("not_equals", "city", "boston"), "ae"),
        (leaf("contains", "city", "o"), "abce"), (leaf("not_contains", "city", "o"), ""),
        (leaf("greater_than", "giving", 5000), "b"), (leaf("greater_than_or_equal", "giving", "$5,000"), "ab"),
        (leaf("less_than", "giving", 0), "d"), (leaf("less_than_or_equal", "giving", "100"), "de"),
        (leaf("between", "giving", 100, 5000), "ae"), (leaf("between", "giving", 100, 5000, lower_inclusive=False), "a"),
        (leaf("between", "giving", 100, 5000, upper_inclusive=False), "e"),
        (leaf("in", "city", "san jose", "boston"), "bce"), (leaf("not_in", "city", "Boston"), "ae"),
        (leaf("date_before", "contact", "2025-01-01"), "a"), (leaf("date_after", "contact", "2024-05-17"), "b"),
        (leaf("date_between", "contact", "2024-05-17", "2025-01-02", upper_inclusive=False), "a"),
        (leaf("starts_with", "city", "New"), "a"), (leaf("ends_with", "city", "jose"), "e"),
        (leaf("email_domain_in", ["email", "email2"], "alpha.edu"), "abc"),
        (leaf("email_domain_in", "email", "alpha.edu", include_subdomains=False), "a"),
        (leaf("email_domain_in", ["email", "email2"], "alpha.edu", quantifier="all"), "c"),
        (leaf("email_domain_in", ["email", "email2"], "alpha.edu", quantifier="none"), "de"),
        (leaf("email_domain_not_in", ["email", "email2"], "alpha.edu"), "abde"),
        (leaf("greater_than", ["giving", "events"], 6, quantifier="all"), "ce"),
        (leaf("greater_than", ["giving", "events"], 6, quantifier="any"), "abce"),
        (leaf("greater_than", ["giving", "events"], 6, quantifier="none"), "d"),
        (leaf("equals", ["city", "manager"], "zzz", quantifier="none"), "abcde"),
        (leaf("equals", ["city", "manager"], "zzz", quantifier="none", require_valid_value=True), "abcde"),
        (leaf("equals", "city", "zzz", quantifier="none", require_valid_value=True), "abce"),
        (leaf("equals", "city", "zzz", quantifier="all"), ""),
    ],
)
def test_operators(people, clause, expected):
    assert names(people, clause) == expected


def test_groups(people):
    inner = group("or", leaf("missing", "manager"), leaf("date_before", "contact", "2025-01-01"))
    assert names(people, leaf("greater_than", "giving", 0), inner) == "a"
    assert names(people, leaf("equals", "city", "boston"), leaf("less_than", "giving", 0), logic="or") == "bcd"
    assert names(people) == "abcde"
    flat = {"logic": "or", "predicates": [leaf("missing", "city")["predicate"], leaf("exists", "manager")["predicate"]]}
    assert people.filter(P.compile_group(people, flat)).count() == 3


@pytest.mark.parametrize(
    "clause",
    [
        leaf("near", "city", 1), leaf("exists", "city", "x"), leaf("greater_than", "giving"), leaf("greater_than", "giving", 1, 2),
        leaf("greater_than", "giving", "many"), leaf("between", "giving", 1), leaf("between", "giving", 5, 1), leaf("in", "city"),
        leaf("in", "city", " ", "nan"), leaf("date_before", "contact", "someday"), leaf("date_between", "contact", "2025-01-01", "2024-01-01"),
        leaf("equals", "nowhere", "x"), leaf("equals", [], "x"), leaf("equals", "city", "x", quantifier="most"),
        leaf("equals", "city", *map(str, range(21))), {"type": "other"}, "text",
        group("xor", leaf("exists", "city")), group("and", group("and", group("and", leaf("exists", "city")))),
        group("and", *[leaf("exists", "city")] * 13),
    ],
)
def test_malformed_predicates_are_refused(people, clause):
    with pytest.raises(P.PredicateError):
        P.compile_group(people, group("and", clause))


def test_failure_counters(people):
    tree = group("and", leaf("greater_than", "giving", 1), leaf("date_after", "contact", "2000"))
    row = P.parse_failures(people, tree).first()
    assert (row.numeric_parse_failure_count, row.date_parse_failure_count) == (1, 1)
    assert P.invalid_email_rows(people, ["email"]).first()[0] == 1
    metrics = P.predicate_metrics(people, group("and", leaf("email_domain_in", "email", "alpha.edu"), group("or", leaf("exists", "city")))).first()
    assert (metrics.total_rows, metrics.matched_row_count, metrics.predicate_count, metrics.predicate_group_depth) == (5, 2, 2, 2)


def test_matching_email(people):
    tree = group("and", leaf("email_domain_in", ["email", "email2"], "alpha.edu", "beta.com"))
    rows = {r["name"]: r["Matching Email"] for r in P.filter_predicates(people, tree).collect()}
    assert rows == {"a": "a@alpha.edu; x@beta.com", "b": "b@mail.alpha.edu; b@beta.com", "c": "c@alpha.edu", "e": "e@beta.com"}
    none = group("and", leaf("email_domain_in", "email", "alpha.edu", quantifier="none"))
    assert [r["Matching Email"] for r in P.filter_predicates(people, none).collect()] == ["d@notalpha.edu"]


def test_relative_boundary():
    assert str(P.relative_boundary(30, now="2025-03-31")) == "2025-03-01"
    for bad in (-1, 36_601, True, "3"):
        with pytest.raises(P.PredicateError):
            P.relative_boundary(bad)


def test_filter_spec(people):
    spec = {"any": [{"op": "equals", "column": "city", "value": "boston"}, {"all": [{"op": "missing", "column": "city"}, {"not": {"op": "exists", "column": "manager"}}]}]}
    assert sorted(r["name"] for r in P.filter_spec(people, spec).collect()) == ["b", "c", "d"]


def test_numeric_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).withColumn("v", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select("id", "v")
    plan = P.filter_predicates(df, group("and", leaf("equals", "id", "5")), columns=["id"])
    assert "ReadSchema: struct<id:bigint>" in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("text", ["(5", "5)", "((5))", "()", "1e5"])
def test_malformed_number_literals_are_refused(text):
    with pytest.raises(P.PredicateError):
        P.number_value(text)


def test_specs_take_header_aliases_and_default_to_email(frame):
    df = frame(["Job Title", "Email"], [("Chef", "a@x.com"), ("Cook", "")])
    assert P.filter_spec(df, {"op": "equals", "column": "occupation", "value": "chef"}).count() == 1
    assert P.filter_spec(df, {"op": "not_missing"}).count() == 1
    with pytest.raises(ValueError):
        P.filter_spec(df, {"op": "equals", "column": "nowhere at all", "value": "x"})
