import random

import pytest

from rollbook.plans import evaluate as X


def test_precision_and_recall(frame):
    def score(returned, expected):
        a, b = (frame(["Full Name"], [(n,) for n in names]) for names in (returned, expected))
        row = X.precision_recall(a, b).first()
        return row.precision, row.recall

    assert score(["Ada Cho", "ada-cho", "Ben X"], ["Ada Cho", "Cy Z"]) == (0.5, 0.5)
    assert score([], ["a"]) == (1.0, 0.0)
    assert score([], []) == (1.0, 1.0)
    assert score(["a"], []) == (0.0, 0.0)


def test_result_diff(frame):
    returned, expected, known = (frame(["name"], [(n,) for n in names]) for names in (["A", "B", "X"], ["b", "C"], ["a", "b", "c"]))
    got = sorted(tuple(r) for r in X.result_diff(returned, expected, known).collect())
    assert got == [("false_negative", "c"), ("false_positive", "a"), ("false_positive", "x"), ("unknown", "x")]


def fold(text):
    return " ".join("".join(c if c.isalnum() else " " for c in str(text or "").lower()).split())


def narrow(result, gold):
    """Gold ids of one result row, by the stepwise narrowing on lists."""
    rows = [g for g in gold if fold(g["Full Name"]) == fold(result["Full Name"]) != ""]
    for field in ("Employer", "Title"):
        kept = [g for g in rows if fold(g[field]) == fold(result[field]) != ""]
        rows = kept or rows
    address = (result["Matching Email"] or "").lower()
    kept = [g for g in rows if address and address in ((g["Email"] or "").lower(), (g["Email 2"] or "").lower())]
    return {g["id"] for g in (kept or rows)}, bool(kept)


@pytest.mark.parametrize("seed", [2, 10_000])
def test_match_gold_against_brute_force(spark, seed):
    rng = random.Random(seed)
    mails = ["a@x.co", "b@x.co", "C@y.co", None]

    def person(i):
        name = "Hot Person" if rng.random() < 0.4 else rng.choice(["Ann Lee", "ann-lee", "Bo Ray", "Cy", None, ""])
        return {"id": i, "Full Name": name, "Employer": rng.choice(["Acme", "acme.", "Beta", None]), "Title": rng.choice(["Lead", "Chef", "", "Cook"])}

    gold = [person(i) | {"Email": rng.choice(mails), "Email 2": rng.choice(mails)} for i in range(80)]
    results = [person(i) | {"Employer": rng.choice(["Acme", "Other", "Beta", ""]), "Matching Email": rng.choice([*mails, "z@z.co"])} for i in range(60)]
    g = spark.createDataFrame([tuple(r.values()) for r in gold], "_row_id long, `Full Name` string, Employer string, Title string, Email string, `Email 2` string")
    r = spark.createDataFrame([tuple(x.values()) for x in results], "rid long, `Full Name` string, Employer string, Title string, `Matching Email` string")
    want = set().union(*(narrow(x, gold)[0] for x in results))
    assert {row["_row_id"] for row in X.matched_gold(r, g).collect()} == want
    matched = X.match_gold(r, g).collect()
    by_email = {(fold(x["Full Name"]), fold(x["Employer"]), fold(x["Title"]), (x["Matching Email"] or "").lower()) for x in results if narrow(x, gold)[1]}
    assert {(m["_name"], m["_employer"], m["_title"], *m["_addresses"]) for m in matched if m["by_email"]} == by_email
    assert sum(m["result_rows"] for m in matched) == sum(bool(narrow(x, gold)[0]) for x in results)


def test_composition_and_overlap(frame):
    schema = "bucket string, _row_id long, `Full Name` string"
    fuzzy = frame(None, [("direct", 1, "A"), ("direct", 2, "B"), ("adjacent", 3, "a")], schema)
    exact = frame(None, [(1,), (3,)], "_row_id long")
    right = frame(None, [("direct", 1, "A"), ("adjacent", 3, "C")], schema)
    assert X.check_composition(right, fuzzy, exact).count() == 0
    wrong = frame(None, [("direct", 2, "B"), ("adjacent", 3, "C")], schema)
    got = sorted(tuple(r) for r in X.check_composition(wrong, fuzzy, exact).collect())
    assert got == [("direct", 1, "missing"), ("direct", 2, "surplus")]
    assert [tuple(r) for r in X.bucket_overlap(fuzzy).collect()] == [("a", 2)]


def test_report(frame):
    schema = "passed boolean, precision double, recall double, unknown_names long, total_model_calls long, answer_source string"
    cases = frame(None, [(True, 1.0, 0.5, 0, 0, "rules"), (False, None, 1.0, 2, 3, None), (True, 0.5, 0.0, 0, None, "rules")], schema)
    row = X.eval_report(cases).first()
    assert tuple(row) == (3, 2, 1, 0.6667, 0.75, 0.5, 2, 3, 1, 2)
    assert X.eval_report(cases.limit(0)).first()["pass_rate"] == 0.0
    assert sorted(tuple(r) for r in X.report_breakdown(cases).collect()) == [("rules", 2), ("unknown", 1)]


def test_expected_rows(frame):
    gold = frame(["id", "expected_industry"], [("1", "Tech"), ("2", "law"), ("3", None)])
    assert [r["id"] for r in X.expected_rows(gold, industries="tech").collect()] == ["1"]
    assert [r["id"] for r in X.expected_rows(gold, spec={"op": "missing", "column": "expected_industry"}).collect()] == ["3"]
    assert X.expected_rows(gold).count() == 0
