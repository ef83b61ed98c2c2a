import random

import pytest

from rollbook.operators.predicates import compile_group
from rollbook.plans import classify as K
from rollbook.plans import people as H
from rollbook.plans.taxonomy import SEED, taxonomies, taxonomies_from_table
from rollbook.sources.files import with_row_id

WORDS = taxonomies(
    {
        "tech": {"title": ["developer"], "employer": ["software"], "company": ["Google", "Spotify"], "exclusion": ["school", "hospital"], "ambiguous": ["labs"]},
        "consulting": {"employer": ["consulting"], "company": ["Deloitte", "McKinsey & Company"], "ambiguous": ["partners"]},
        "investment_banking": {"company": ["Goldman Sachs"]},
        "banking": {"employer": ["bank"], "company": ["Capital One"]},
        "finance": {"employer": ["insurance"], "company": ["BlackRock"]},
        "government_legal": {"employer": ["department of"], "company": ["World Bank"], "ambiguous": ["public"]},
        "marketing": {"employer": ["advertising"], "company": ["Ogilvy"]},
        "operations": {"employer": ["logistics"]},
        "healthcare": {"title": ["nurse"], "employer": ["hospital"], "exclusion": ["veterinary"]},
        "media": {"company": ["Spotify"]},
    }
)

# industry, scope, title, employer, class, confidence
CASES = [
    ("tech", "industry", "Senior Software Engineer", "General Hospital", "direct_match", 0.98),
    ("tech", "industry", "Clinical Data Analyst, data scientist", "x", "adjacent", 0.58),
    ("tech", "industry", "Recruiter", "Google", "direct_match", 0.95),
    ("tech", "industry", "Recruiter", "Blue Software", "direct_match", 0.88),
    ("tech", "industry", "Teacher", "Software School", "non_match", 0.2),
    ("tech", "industry", "Product Manager", "Acme", "adjacent", 0.55),
    ("tech", "industry", "Chef", "Pepper Labs", "uncertain", 0.45),
    ("tech", "industry", "Marketplace Operations", "Google", "adjacent", 0.52),
    ("tech", "technical_role", "Recruiter", "Google", "adjacent", 0.58),
    ("tech", "tech_company", "Software Engineer", "Acme", "adjacent", 0.62),
    ("tech", "tech_company", "Software Engineer", "Deloitte Consulting", "adjacent", 0.58),
    ("ib", "industry", "Investment Banking Analyst", "Acme", "direct_match", 0.98),
    ("ib", "industry", "Analyst", "Goldman Sachs & Co", "uncertain", 0.45),
    ("ib", "industry", "Wealth Management", "Goldman Sachs", "non_match", 0.85),
    ("ib", "industry", "Engineer", "Goldman Sachs", "non_match", 0.75),
    ("banking", "industry", "", "Capital One", "direct_match", 0.78),
    ("banking", "industry", "Developer", "First Bank", "non_match", 0.8),
    ("banking", "industry", "Gardener", "First Bank", "uncertain", 0.45),
    ("banking", "industry", "Credit Analyst", "World Bank", "non_match", 0.9),
    ("finance", "industry", "Credit Analyst", "BlackRock", "non_match", 0.88),
    ("finance", "industry", "Chef", "Summit Insurance", "direct_match", 0.82),
    ("marketing", "industry", "Head of Growth", "Google", "adjacent", 0.55),
    ("marketing", "industry", "", "Ogilvy", "direct_match", 0.78),
    ("marketing", "industry", "Chef", "Ogilvy", "uncertain", 0.45),
    ("operations", "industry", "Clinical Operations Lead", "x", "non_match", 0.85),
    ("operations", "industry", "Director of Operations", "x", "direct_match", 0.95),
    ("operations", "industry", "Driver", "Swift Logistics", "uncertain", 0.45),
    ("government", "industry", "Teacher", "Department of Education", "non_match", 0.85),
    ("government", "industry", "Chef", "Public Kitchen", "uncertain", 0.4),
    ("consulting", "industry", None, None, "uncertain", 0.2),
    ("consulting", "industry", "IT Consultant", "x", "direct_match", 0.95),
    ("consulting", "industry", "Deal Advisory", "Deloitte", "direct_match", 0.9),
    ("consulting", "industry", "Deal Advisory", "Acme", "direct_match", 0.75),
    ("consulting", "industry", "Deal Advisory", "BlackRock", "adjacent", 0.6),
    ("consulting", "industry", "Deal Advisory", "Ogilvy", "uncertain", 0.55),
    ("consulting", "industry", "Financial Advisory", "Acme", "adjacent", 0.6),
    ("consulting", "industry", "Paralegal", "Deloitte", "non_match", 0.9),
    ("consulting", "industry", "Trader", "Acme", "non_match", 0.85),
    ("consulting", "industry", "Software Engineer", "McKinsey", "uncertain", 0.55),
    ("consulting", "industry", "Software Engineer", "Mackinsey", "non_match", 0.2),
    ("consulting", "industry", "Software Engineer", "McKinsey & Company", "uncertain", 0.55),
    ("consulting", "industry", "Associate", "Deloitte LLC", "direct_match", 0.8),
    ("consulting", "industry", "Adviser", "Acme", "uncertain", 0.5),
    ("consulting", "industry", "Chief of Staff", "Acme", "adjacent", 0.6),
    ("consulting", "industry", "Chef", "Acme Partners", "uncertain", 0.45),
    ("healthcare", "industry", "Nurse", "x", "direct_match", 1.0),
    ("healthcare", "industry", "Chef", "Veterinary Hospital", "direct_match", 0.9),
    ("healthcare", "industry", "Chef", "Veterinary Care", "non_match", 0.9),
    ("nowhere", "industry", "Chef", "x", "non_match", 0.0),
]


def test_policies(frame):
    df = frame(["i", "Occupation", "Employer"], [(str(i), c[2], c[3]) for i, c in enumerate(CASES)])
    for key in sorted({c[:2] for c in CASES}):
        rows = K.classify(df, K.QuerySpec((key[0],), scope=key[1]), WORDS).collect()
        for row in rows:
            case = CASES[int(row["i"])]
            if case[:2] == key:
                assert (row["classification"], row["confidence"]) == case[4:], case
                assert row["count_as_match"] == (case[4] == "direct_match" and case[5] >= 0.7)


def classified(frame, spec, *jobs):
    df = frame(["Title", "Company"], jobs)
    return [(r["classification"], r["confidence"]) for r in K.classify(df, spec, WORDS).collect()]


def test_query_logic(frame):
    advisers = [("Risk Consultant", "Deloitte"), ("Consultant", "Acme"), ("Strategy Lead", "Acme")]
    both = K.QuerySpec(("consulting",), required=("finance",))
    assert classified(frame, both, *advisers) == [("direct_match", 0.95), ("adjacent", 0.6), ("adjacent", 0.6)]
    wide = K.QuerySpec(("consulting",), functions=("internal_strategy",))
    assert classified(frame, wide, *advisers)[2] == ("direct_match", 0.85)
    without = K.QuerySpec(("tech",), excluded=("healthcare",), excluded_functions=("data_analytics",))
    assert classified(frame, without, ("Software Engineer", "General Hospital"), ("Data Scientist", "Acme"), ("Software Engineer", "Acme")) == [
        ("non_match", 0.9), ("non_match", 0.9), ("direct_match", 0.98),
    ]
    several = K.QuerySpec(("banking", "ib"))
    assert classified(frame, several, ("Investment Banking Analyst", "Goldman Sachs"), ("Chef", "First Bank")) == [("direct_match", 0.98), ("uncertain", 0.45)]
    assert classified(frame, K.QuerySpec(), ("Chef", "x")) == [("non_match", 0.0)]
    adjacent = K.classify(frame(["Title", "Company"], [("Product Manager", "Acme")]), K.QuerySpec(("tech",), include_adjacent=True), WORDS).first()
    assert adjacent["count_as_match"] and adjacent["match_reason_code"] == "product_at_nontech_or_ambiguous_employer"


def test_growth_roles_need_no_promotion_at_technology_employers(frame):
    spec = K.QuerySpec(("marketing",), functions=("marketing_growth",))
    got = classified(frame, spec, ("Head of Growth", "Google"), ("Head of Growth", "Acme"))
    assert got == [("non_match", 0.85), ("direct_match", 0.82)]


def test_profile_and_layers(frame):
    df = frame(["Occupation", "Employer", "Industry"], [("Strategy Consultant", "Spotify", None), ("Founder", "Acme", "software house"), (None, None, None), ("Chef", "Blue School", "software")])
    rows = K.profile_people(df, WORDS).collect()
    assert rows[0]["employer_industry"] == ["technology", "media"] and rows[0]["job_function"] == ["consulting_advisory"]
    assert (rows[2]["employer_industry"], rows[2]["job_function"], rows[2]["specialties"]) == (["unknown"],) * 3
    got = [(r["status"], r["match_sources"], r["confidence"]) for r in K.match_industry(df, "technology", WORDS).collect()]
    ride = "generic_business_role_with_matching_employer"
    assert got == [
        ("confirmed", ["known_company", ride], 0.95), ("confirmed", ["employer_keyword", ride], 0.82), ("excluded", [], 0.0),
        ("excluded", ["exclusion_keyword"], 0.9),
    ]
    industries = [r["industries"] for r in K.company_industries(df, taxonomies=WORDS).collect()]
    assert industries == [["media", "tech"], [], [], []]


def test_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([("Tech", "company", "B", 2), ("Tech", "company", "A", 1), ("pe", "title", "x", None)], "industry string, kind string, term string, priority int")
    loaded = taxonomies_from_table(table)
    assert loaded.terms("technology", "company") == ("A", "B") and loaded.terms("private equity", "title") == ("x",)
    with pytest.raises(ValueError):
        taxonomies({"tech": {"colour": ["x"]}})
    assert SEED.get("vc").industry == "venture_capital"


def test_explain(frame):
    df = frame(["First Name", "Last Name", "Occupation", "Employer"], [("Ada", "Cho", "Developer", "x"), ("Ben", "Chu", "Chef", "Google")])
    rows = K.explain_people(df, "cho ADA", "tech", WORDS).collect()
    assert [(r["name"], r["status"], r["match_sources"]) for r in rows] == [("Ada Cho", "confirmed", ["title_keyword"])]


JOBS = [("Software Engineer", "Acme"), ("Product Manager", "Acme"), ("Chef", "Pepper Labs"), ("Chef", "Acme"), ("Recruiter", "Google"), (None, None)]
SPEC = K.QuerySpec(("tech",))
EXACT = {"logic": "and", "predicates": [{"operator": "greater_than", "columns": ["score"], "values": [4]}]}


def crowd(spark, seed, partitions):
    """People with many rows each; one of them has a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        name = ("Hot", "Person") if rng.random() < 0.34 else (f"F{rng.randrange(25)}", rng.choice(["L", "", None]))
        title, employer = rng.choice(JOBS)
        rows.append((i, *name, title, employer, rng.choice(["a@b.co", "c@d.co", None]), rng.randrange(10)))
    schema = "id long, `First Name` string, `Last Name` string, Occupation string, Employer string, Email string, score long"
    return with_row_id(spark.createDataFrame(rows, schema).repartition(partitions), key="id"), rows


def buckets_by_loop(rows, verdicts, keys):
    """The person loop, row by row in file order."""
    counted, direct, adjacent, uncertain, skipped = {}, {}, {}, {}, []
    for row in rows:
        i, key = row[0], keys[row[0]]
        name, counts = verdicts[i]
        if counts:
            counted.setdefault(key, i)
            if name == "adjacent":
                adjacent.setdefault(key, i)
            else:
                direct[key] = i
                adjacent.pop(key, None)
                uncertain.pop(key, None)
        elif name == "adjacent" and key not in counted and key not in direct:
            adjacent.setdefault(key, i)
            uncertain.pop(key, None)
        elif name == "uncertain" and not any(key in b for b in (counted, direct, adjacent)):
            uncertain.setdefault(key, i)
        else:
            skipped.append(i)
    adjacent = {k: i for k, i in adjacent.items() if k not in counted}
    uncertain = {k: i for k, i in uncertain.items() if k not in counted and k not in adjacent}
    return {"counted": counted, "direct": direct, "adjacent": adjacent, "uncertain": uncertain}, skipped


@pytest.mark.parametrize(("seed", "partitions", "adjacent"), [(1, 1, False), (1, 8, False), (2, 5, True)])
def test_people_filter_against_the_loop(spark, seed, partitions, adjacent):
    spec = K.QuerySpec(("tech",), include_adjacent=adjacent)
    df, rows = crowd(spark, seed, partitions)
    verdicts = {r["id"]: (r["classification"], r["count_as_match"]) for r in K.classify(df, spec, WORDS).collect()}
    keys = {r["id"]: r["k"] for r in df.select("id", H.person_key(df).alias("k")).collect()}
    want, skipped = buckets_by_loop(rows, verdicts, keys)

    def shown(result):
        found = {}
        for r in result.collect():
            found.setdefault(r["bucket"], set()).add(r["_row_id"])
        return found

    ids = {b: set(people.values()) for b, people in want.items() if people}
    assert shown(H.people_filter(df, spec, WORDS)) == ids
    metrics = H.people_metrics(df, spec, WORDS).first()
    assert [metrics[c] for c in ("total_matches", "direct_count", "adjacent_count", "uncertain_count")] == [len(want[b]) for b in H.BUCKETS]

    exact = {r[0] for r in rows if r[6] > 4}
    assert shown(H.composite_filter(df, spec, EXACT, "and", WORDS)) == {b: i & exact for b, i in ids.items() if i & exact}
    first = {}
    for i in sorted(exact):
        first.setdefault(keys[i], i)
    union = {"counted": ids["counted"] | set(first.values()), "direct": ids["direct"] | set(first.values())}
    union |= {b: ids.get(b, set()) - set(first.values()) for b in ("adjacent", "uncertain")}
    assert shown(H.composite_filter(df, spec, EXACT, "or", WORDS)) == {b: i for b, i in union.items() if i}

    terms, titles = ["product manager", "google", "chef"], ("Occupation", "Employer")
    texts = {r[0]: [str(r[3] or "").lower(), str(r[4] or "").lower()] for r in rows}
    hits = {i: sum(any(t in cell for cell in cells) for t in terms) for i, cells in texts.items()}
    got = H.candidate_metrics(df, spec, terms, titles, WORDS).first()
    assert tuple(got) == (sum(hits.values()), sum(h > 0 for h in hits.values()), sum(hits[i] > 0 for i in skipped))


def test_composite_and_is_the_intersection(spark):
    df, _ = crowd(spark, 3, 4)
    fuzzy = H.people_filter(df, SPEC, WORDS)
    exact = df.filter(compile_group(df, EXACT))
    both = H.composite_filter(df, SPEC, EXACT, "and", WORDS)
    wanted = fuzzy.join(exact.select("_row_id"), "_row_id").select("bucket", "_row_id")
    assert both.select("bucket", "_row_id").exceptAll(wanted).count() == 0 == wanted.exceptAll(both.select("bucket", "_row_id")).count()


def test_person_keys(frame):
    people = [("1", "Ada", "O'Cho", "x@y.z"), ("2", " ", "Cho", "x@y.z"), ("3", None, None, ""), ("4", "Ada", "", "q")]
    df = with_row_id(frame(["nr", "First Name", "Last Name", "Email"], people), key="nr")
    assert [r[0] for r in df.select(H.person_key(df)).collect()] == ["name|ada|ocho", "stable|xyz", "row|3", "person|ada"]
    full = with_row_id(frame(["id", "Full Name"], [("1", "Ada Cho"), ("2", "ada  cho"), ("3", "")]), key="id")
    assert sorted(r["id"] for r in H.dedupe_people(full).collect()) == ["1", "3"]


def test_matching_email_column(frame):
    df = with_row_id(frame(["id", "First Name", "Last Name", "Occupation", "Email"], [("1", "A", "B", "Software Engineer", "a@x.com; b@y.com")]), key="id")
    tree = {"logic": "and", "predicates": [{"operator": "email_domain_in", "columns": ["Email"], "values": ["y.com"]}]}
    rows = H.composite_filter(df, SPEC, tree, "and", WORDS).collect()
    assert {(r["bucket"], r["Matching Email"]) for r in rows} == {("counted", "b@y.com"), ("direct", "b@y.com")}


def test_a_required_industry_must_show_in_title_or_employer(frame):
    """The description of the employer is no evidence for a required industry."""
    from rollbook.plans.classify import QuerySpec, classify

    df = with_row_id(frame(["id", "Occupation", "Employer", "Employer Description"], [("1", "Consultant", "Acme Consulting", "hospital")]), key="id")
    row = classify(df, QuerySpec(("consulting",), required=("healthcare",))).first()
    assert (row["classification"], row["confidence"]) == ("adjacent", 0.6)
    assert classify(df, QuerySpec(("consulting",))).first()["classification"] == "direct_match"
