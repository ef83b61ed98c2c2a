"""Ingest, projection, filter and predicate queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query
from checks.sql import blank, day, emails, member, moment, nullish, strict
from checks.views import events, events_sql, people, people_sql, table
from rollbook.operators import columns as C
from rollbook.operators import predicates as P
from rollbook.operators import search as S
from rollbook.session import shared_folder
from rollbook.sources import files, inference

PICKED = ["person_id", "first_name", "email", "giving", "manager", "city"]


@query("csv_scan", people_sql(f"SELECT cast(person_id AS VARCHAR) AS person_id, {', '.join(f'nullif({c}, {chr(39) * 2}) AS {c}' for c in PICKED[1:])} FROM people_v"))
def csv_scan(spark, sf_dir):
    path = f"{shared_folder(spark)}/people-{uuid.uuid4().hex}"
    files.write_csv(people(spark, sf_dir).select(*PICKED), path)
    return files.read_csv(spark, path).select(*PICKED)


@query("csv_scan_multiline", people_sql("SELECT person_id::VARCHAR AS person_id, first_name || chr(10) || '\"' || coalesce(city, '') AS note FROM people_v"))
def csv_scan_multiline(spark, sf_dir):
    path = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    notes = people(spark, sf_dir).selectExpr("person_id", "concat(first_name, '\\n\"', coalesce(city, '')) as note")
    files.write_csv(notes, path)
    return files.read_csv(spark, path, multiline=True)


@query("null_tokens", people_sql(
    "SELECT person_id, CASE WHEN giving NOT IN ('', 'N/A', 'NA', 'n/a', 'nan', 'null', 'NULL', 'None') THEN giving END AS giving, "
    "CASE WHEN city NOT IN ('nan', '') THEN city END AS city, CASE WHEN email NOT IN ('', 'n/a') THEN email END AS email FROM people_v"
))
def null_tokens(spark, sf_dir):
    return files.null_tokens(people(spark, sf_dir).select("person_id", "giving", "city", "email"))


@query("unique_columns", people_sql(
    'SELECT person_id AS "id", first_name AS "name", last_name AS "name_2", city AS "Unnamed", state AS "Unnamed_2" FROM people_v'
))
def unique_columns(spark, sf_dir):
    picked = people(spark, sf_dir).select("person_id", "first_name", "last_name", "city", "state")
    return files.with_unique_columns(picked.toDF(" id", "name", "name ", "", "nan"))


@query("infer_types", people_sql(
    "SELECT 'person_id' AS \"column\", 'number' AS type UNION ALL SELECT 'event_count', 'number' UNION ALL "
    f"SELECT 'updated_at', CASE WHEN count({moment('updated_at')}) >= 0.8 * count(*) FILTER (NOT {blank('updated_at')}) THEN 'date' ELSE 'text' END FROM people_v UNION ALL "
    f"SELECT 'last_contact', CASE WHEN count({moment('last_contact')}) >= 0.8 * count(*) FILTER (NOT {blank('last_contact')}) THEN 'date' ELSE 'text' END FROM people_v UNION ALL "
    f"SELECT 'giving', CASE WHEN count(try_cast(replace(replace(replace(giving, '$', ''), ',', ''), '%', '') AS DOUBLE)) >= 0.8 * count(*) FILTER (NOT {blank('giving')}) THEN 'number' ELSE 'text' END FROM people_v UNION ALL "
    "SELECT 'city', 'text'"
))
def infer_types(spark, sf_dir):
    names = ["person_id", "event_count", "updated_at", "last_contact", "giving", "city"]
    return inference.infer_types(people(spark, sf_dir), names)


@query("infer_datetimes", people_sql(
    f"SELECT person_id, strftime({moment('updated_at')}, '%Y-%m-%d') AS update_date, strftime({moment('last_contact')}, '%Y-%m-%d') AS contact_time, giving AS gift_date FROM people_v"
))
def infer_datetimes(spark, sf_dir):
    picked = people(spark, sf_dir).selectExpr(
        "person_id", "updated_at as update_date", "nullif(last_contact, '') as contact_time", "giving as gift_date"
    )
    typed = inference.infer_datetimes(picked)
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("update_date", "contact_time")}
    return typed.withColumns(dates)


@query("row_id", "SELECT c_custkey, c_name, c_custkey AS _row_id FROM customer")
def row_id(spark, sf_dir):
    return files.with_row_id(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), key="c_custkey")


@query("row_id_keyless", "SELECT c_custkey, row_number() OVER () - 1 AS _row_id FROM (SELECT c_custkey FROM customer ORDER BY c_custkey)")
def row_id_keyless(spark, sf_dir):
    """Ids are places in the file, which is sorted by key; two reads agree in them, whatever else they select."""
    df = files.with_row_id(table(spark, sf_dir, "customer"))
    again = files.with_row_id(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(F.col("_row_id").alias("_id"), F.col("c_custkey").alias("_key"))
    return df.join(again, (F.col("_row_id") == F.col("_id")) & (F.col("c_custkey") == F.col("_key"))).select("c_custkey", "_row_id")


@query("row_id_written", "SELECT c_custkey FROM customer")
def row_id_written(spark, sf_dir):
    """Two reads of a table that is no file agree in their ids."""
    df = files.with_row_id(table(spark, sf_dir, "customer").select("c_custkey").repartition(5))
    again = df.select(F.col("_row_id").alias("_id"), F.col("c_custkey").alias("_key"))
    return df.join(again, (F.col("_row_id") == F.col("_id")) & (F.col("c_custkey") == F.col("_key"))).select("c_custkey")


@query("app_view", people_sql("SELECT person_id, employer FROM people_v"))
def app_view(spark, sf_dir):
    labelled = people(spark, sf_dir).selectExpr("person_id", "employer", "expected_industry", "first_name as eval_first_name")
    return files.app_view(labelled)


@query("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def preview(spark, sf_dir):
    return C.preview(files.with_row_id(table(spark, sf_dir, "customer"), key="c_custkey"))


@query("select_columns", "SELECT c_mktsegment, c_custkey, c_name FROM customer")
def select_columns(spark, sf_dir):
    return C.select_columns(table(spark, sf_dir, "customer"), ["C_MKTSEGMENT", "c custkey", "C-Name", "c_name", "nothing"])


@query("resolve_column", people_sql("SELECT person_id, occupation, employer, grad_year, state FROM people_v"))
def resolve_column(spark, sf_dir):
    df = people(spark, sf_dir)
    asked = ["person id", "Job Title", "organisation", "Class Yr", "province"]
    return df.select(*(C.resolve_column(df.columns, name) for name in asked))


@query("resolve_column_similar", people_sql("SELECT person_id, occupation, employer, linkedin_url, manager FROM people_v"))
def resolve_column_similar(spark, sf_dir):
    """Misspelt headers by likeness, a contained one, and the employer by a company its cells name; nothing for an unlike name."""
    df = people(spark, sf_dir).withColumnsRenamed({"employer": "xq", "occupation": "occupatoin"})
    asked = (["person id"], ["occupation"], ["workplace"], ["LinkedIn"], ["managr"])
    found = [C.semantic_column(df, names, entities=("Goldman Sachs",) if names == ["workplace"] else ()) for names in asked]
    if C.semantic_column(df, ["zodiac sign"]) is not None:
        raise AssertionError("an unlike name was resolved")
    return df.select(*found).toDF("person_id", "occupation", "employer", "linkedin_url", "manager")


@query("display_columns", people_sql(
    "SELECT person_id, first_name, last_name, occupation, employer, employer_description, email, alt_email, giving, event_count, last_contact, "
    "updated_at, manager, linkedin_url, do_not_contact FROM people_v"
))
def display_columns(spark, sf_dir):
    return C.display_columns(people(spark, sf_dir).withColumn("Confidence", F.lit(1)), allow_groups=("email",))


@query("people_columns", people_sql(
    'SELECT first_name AS "First Name", last_name AS "Last Name", occupation AS "Occupation", employer AS "Employer", '
    'linkedin_url AS "LinkedIn URL" FROM people_v'
))
def people_columns(spark, sf_dir):
    return C.people_columns(people(spark, sf_dir))


@query("json_safe", events_sql(
    "SELECT event_id, CASE WHEN ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, "
    "CASE WHEN isfinite(value) THEN value END AS value FROM events_v"
))
def json_safe(spark, sf_dir):
    return C.json_safe(events(spark, sf_dir).select("event_id", "ts", "value"))


@query("filter_equals", "SELECT * FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_equals(spark, sf_dir):
    return S.filter_equals(table(spark, sf_dir, "customer"), "c_mktsegment", "Building")


@query("filter_missing", people_sql(f"SELECT person_id, manager FROM people_v WHERE {blank('manager')}"))
def filter_missing(spark, sf_dir):
    return S.filter_missing(people(spark, sf_dir), "manager").select("person_id", "manager")


@query("date_range_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-31'")
def date_range_filter(spark, sf_dir):
    rows = S.date_range_filter(table(spark, sf_dir, "orders"), "o_orderdate", "1996-03-01", "1996-05-31")
    return rows.select("o_orderkey", "o_totalprice")


_PART = "SELECT p_partkey, {c} AS matched_column, {t} AS matched_term, {r} AS \"MATCH REASON\" FROM part WHERE {w}"


def _evidence(*hits):
    """SQL of the evidence of some (condition, column, term) hits in order."""
    cases = ", ".join(f"CASE WHEN {cond} THEN {{'c': '{c}', 't': '{t}', 'r': 'Matched {c}: ' || {c}}} END" for cond, c, t in hits)
    found = f"list_filter([{cases}], lambda h: h IS NOT NULL)"

    def joined(field, between=", "):
        items = f"list_transform({found}, lambda h: h.{field})"
        # Order of first appearance.
        distinct = f"list_filter({items}, lambda v, i: list_position({items}, v) = i)"
        return f"array_to_string({distinct}, '{between}')"

    return {"c": joined("c"), "t": joined("t"), "r": joined("r", "; ")}


def _first_hit(term, *columns):
    """Hits of one term: only the first column that contains it."""
    hits, earlier = [], ""
    for column in columns:
        test = f"contains(lower({column}), '{term.lower()}')"
        hits.append((f"{test}{earlier}", column, term))
        earlier += f" AND NOT {test}"
    return hits


_RED_ECO = _evidence(*_first_hit("red", "p_name", "p_type"), *_first_hit("ECON", "p_name", "p_type"))


@query("filter_contains", _PART.format(**_evidence(*_first_hit("Ring", "p_name", "p_type")), w="contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')"))
def filter_contains(spark, sf_dir):
    rows = S.filter_contains(table(spark, sf_dir, "part"), ["p_name", "p_type"], ["Ring"])
    return rows.select("p_partkey", "matched_column", "matched_term", S.REASON)


@query("search_text", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'heon') AND contains(lower(text), 'tion')")
def search_text(spark, sf_dir):
    return S.search_text(table(spark, sf_dir, "documents"), ["text"], ["heon", "tion"], require_all=True).select("doc_id", "n_chars")


@query("contains_any", _PART.format(**_RED_ECO, w="contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_name), 'econ') OR contains(lower(p_type), 'econ')"))
def contains_any(spark, sf_dir):
    rows = S.contains_any(table(spark, sf_dir, "part"), ["p_name", "p_type"], ["red", "ECON"])
    return rows.select("p_partkey", "matched_column", "matched_term", S.REASON)


@query("contains_any_wide", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'econ')")
def contains_any_wide(spark, sf_dir):
    """A search of all text columns, of which the last of twelve holds the term."""
    wide = table(spark, sf_dir, "part").select("p_partkey", *(F.lit("-").alias(f"title_{i}") for i in range(11)), F.col("p_type").alias("remark"))
    return S.contains_any(wide, terms=["econ"]).select("p_partkey")


_GROUPED = [{"columns": ["p_name"], "terms": ["red", "ring"]}, {"columns": ["p_brand", "p_type"], "terms": ["ring", "1"]}]


@query("contains_all", _PART.format(
    **_evidence(*_first_hit("red", "p_name"), *_first_hit("ring", "p_name"), *_first_hit("ring", "p_brand", "p_type"), *_first_hit("1", "p_brand", "p_type")),
    w="contains(lower(p_name), 'red') AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')) "
    "AND (contains(lower(p_brand), '1') OR contains(lower(p_type), '1'))",
))
def contains_all(spark, sf_dir):
    rows = S.contains_all(table(spark, sf_dir, "part"), groups=_GROUPED)
    return rows.select("p_partkey", "matched_column", "matched_term", S.REASON)


@query("match_evidence", "WITH h AS (SELECT p_partkey, unnest([{'c': 'p_name', 't': 'red', 'v': p_name}, {'c': 'p_name', 't': 'widget', 'v': p_name}]) AS h FROM part) "
       "SELECT p_partkey, h.c AS \"column\", h.t AS term, h.v AS value FROM h WHERE contains(lower(h.v), h.t)")
def match_evidence(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    groups = S.search_groups(df, ["p_name", "p_brand"], ["red", "widget"])
    return df.select("p_partkey", F.inline(S.match_hits(df, groups)))


@query("search_metrics", "WITH h AS (SELECT (contains(lower(p_name), 'red'))::INT + (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring'))::INT AS n FROM part) "
       "SELECT count(*) AS total_rows, cast(sum(n) AS BIGINT) AS raw_match_count, count(*) FILTER (n > 0) AS matched_row_count, "
       "least(count(*) FILTER (n > 0), 100) AS returned_row_count, sum(n) <> count(*) FILTER (n > 0) AS deduplicated FROM h")
def search_metrics(spark, sf_dir):
    return S.search_metrics(table(spark, sf_dir, "part"), ["p_name", "p_type"], ["red", "ring"], limit=100)


def predicate(operator, column, *values, **options):
    names = [column] if isinstance(column, str) else list(column)
    return {"type": "predicate", "predicate": {"operator": operator, "columns": names, "values": list(values), **options}}


def group(logic, *clauses):
    return {"type": "group", "logic": logic, "clauses": list(clauses)}


FLAGSHIP = group(
    "and",
    predicate("greater_than", "giving", 5000),
    group("or", predicate("missing", "manager"), predicate("date_before", "last_contact", "2025-01-01")),
)


def flagship(spark, sf_dir):
    """Givers above 5000 without a manager or not contacted since 2025, largest gift first."""
    from rollbook.operators.order import top_n

    return top_n(P.filter_predicates(people(spark, sf_dir), FLAGSHIP), "giving", 25).select(
        "person_id", "first_name", "last_name", "giving", "manager", "last_contact"
    )


_FLAG_WHERE = f"{strict('giving')} > 5000 AND ({nullish('manager')} OR coalesce({day('last_contact')} < DATE '2025-01-01', false))"


@query("filter_predicates", people_sql(
    f"SELECT person_id, first_name, last_name, giving, manager, last_contact FROM people_v WHERE {_FLAG_WHERE} ORDER BY {strict('giving')} DESC, person_id LIMIT 25"
))
def filter_predicates(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("predicate_group", people_sql(
    f"SELECT person_id FROM people_v WHERE ({member('city')} = 'boston' OR ({strict('grad_year::VARCHAR')} BETWEEN 2000 AND 2010 AND NOT {nullish('email')})) AND coalesce(event_count > 3, false)"
))
def predicate_group(spark, sf_dir):
    tree = group(
        "and",
        group(
            "or",
            predicate("equals", "city", "Boston"),
            group("and", predicate("between", "grad_year", 2000, 2010), predicate("exists", "email")),
        ),
        predicate("greater_than", "event_count", 3),
    )
    return P.filter_predicates(people(spark, sf_dir), tree, columns=["person_id"])


def _pair(op, a, b, test):
    x, y = test.format(a), test.format(b)
    return {
        "any": f"coalesce({x}, false) OR coalesce({y}, false)",
        "all": f"({x} IS NOT NULL OR {y} IS NOT NULL) AND coalesce({x}, true) AND coalesce({y}, true)",
        "none": f"({x} IS NOT NULL OR {y} IS NOT NULL) AND NOT (coalesce({x}, false) OR coalesce({y}, false))",
    }[op]


@query("predicate_quantifier", people_sql(
    f"SELECT 'any' AS quantifier, person_id FROM people_v WHERE {_pair('any', 'giving_n', 'event_n', '({} >= 10)')} UNION ALL "
    f"SELECT 'all', person_id FROM p WHERE {_pair('all', 'giving_n', 'event_n', '({} >= 10)')} UNION ALL "
    f"SELECT 'none', person_id FROM p WHERE {_pair('none', 'giving_n', 'event_n', '({} >= 10)')}".replace("FROM people_v", "FROM p"),
    f"p AS (SELECT person_id, {strict('giving')} AS giving_n, event_count AS event_n FROM people_v)",
))
def predicate_quantifier(spark, sf_dir):
    df = people(spark, sf_dir)

    def one(quantifier):
        tree = group("and", predicate("greater_than_or_equal", ["giving", "event_count"], 10, quantifier=quantifier))
        return P.filter_predicates(df, tree).select(F.lit(quantifier).alias("quantifier"), "person_id")

    return one("any").unionAll(one("all")).unionAll(one("none"))


@query("parse_failures", people_sql(
    f"SELECT count(*) FILTER (NOT {nullish('giving')} AND {strict('giving')} IS NULL) AS numeric_parse_failure_count, "
    f"count(*) FILTER (NOT {nullish('last_contact')} AND {day('last_contact')} IS NULL) AS date_parse_failure_count FROM people_v"
))
def parse_failures(spark, sf_dir):
    return P.parse_failures(people(spark, sf_dir), FLAGSHIP)


@query("invalid_email_rows", people_sql(
    f"SELECT count(*) FILTER ((NOT {blank('email')} OR NOT {blank('alt_email')}) AND len({emails('email')}) + len({emails('alt_email')}) = 0) AS invalid_email_row_count FROM people_v"
))
def invalid_email_rows(spark, sf_dir):
    return P.invalid_email_rows(people(spark, sf_dir), ["email", "alt_email"])


@query("predicate_base_filter", people_sql(
    "SELECT person_id, occupation FROM people_v WHERE coalesce(event_count > 5, false) AND (contains(lower(coalesce(occupation, '')), 'analyst') OR contains(lower(coalesce(occupation, '')), 'engineer'))"
))
def predicate_base_filter(spark, sf_dir):
    rows = P.filter_predicates(
        people(spark, sf_dir),
        group("and", predicate("greater_than", "event_count", 5)),
        base_filter=lambda df: S.contains_any(df, ["occupation"], ["analyst", "engineer"]),
    )
    return rows.select("person_id", "occupation")


@query("filter_spec", people_sql(
    f"SELECT person_id FROM people_v WHERE (coalesce({member('state')} = 'ma', false) OR NOT coalesce(contains({member('employer')}, 'bank'), false)) AND NOT {nullish('giving')}"
))
def filter_spec(spark, sf_dir):
    spec = {
        "all": [
            {"any": [{"op": "equals", "column": "state", "value": "MA"}, {"not": {"op": "contains", "column": "employer", "value": "bank"}}]},
            {"op": "not_missing", "column": "giving"},
        ]
    }
    return P.filter_spec(people(spark, sf_dir), spec).select("person_id")


def _register_operators():
    """One query per predicate operator."""
    text = member("city")
    number, when = strict("giving"), day("last_contact")
    found = f"(SELECT list_transform({emails('email')}, lambda e: split_part(e, '@', 2)))"
    inside = "(d = 'alpha.edu' OR d LIKE '%.alpha.edu')"
    cases = {
        "exists": (("exists", "city"), f"NOT {nullish('city')}"),
        "missing": (("missing", "city"), nullish("city")),
        "equals": (("equals", "city", "new york", "Chicago"), f"{text} IN ('new york', 'chicago')"),
        "not_equals": (("not_equals", "city", "BOSTON", "Chicago"), f"{text} NOT IN ('boston', 'chicago')"),
        "contains": (("contains", "city", "san", "york"), f"contains({text}, 'san') OR contains({text}, 'york')"),
        "not_contains": (("not_contains", "city", "o"), f"NOT contains({text}, 'o')"),
        "gt": (("greater_than", "giving", 5000), f"{number} > 5000"),
        "gte": (("greater_than_or_equal", "giving", "$5,000"), f"{number} >= 5000"),
        "lt": (("less_than", "giving", 0), f"{number} < 0"),
        "lte": (("less_than_or_equal", "giving", "(75)"), f"{number} <= -75"),
        "in": (("in", "state", "MA", "il"), f"{member('state')} IN ('ma', 'il')"),
        "not_in": (("not_in", "state", "MA", "il"), f"{member('state')} NOT IN ('ma', 'il')"),
        "date_before": (("date_before", "last_contact", "2024-01-01"), f"{when} < DATE '2024-01-01'"),
        "date_after": (("date_after", "last_contact", "March 5, 2024"), f"{when} > DATE '2024-03-05'"),
        "starts_with": (("starts_with", "city", "New Y"), f"{text} LIKE 'new y%'"),
        "ends_with": (("ends_with", "city", "ON"), f"{text} LIKE '%on'"),
        "email_domain_in": (("email_domain_in", "email", "@Alpha.edu"), f"len(list_filter({found}, lambda d: {inside})) > 0"),
        "email_domain_not_in": (("email_domain_not_in", "email", "alpha.edu"), f"len(list_filter({found}, lambda d: NOT {inside})) > 0"),
    }
    options = {
        "between": (predicate("between", "giving", 0, 5001, upper_inclusive=False), f"{number} >= 0 AND {number} < 5001"),
        "date_between": (
            predicate("date_between", "last_contact", "2024-01-01", "2025-01-02", lower_inclusive=False),
            f"{when} > DATE '2024-01-01' AND {when} <= DATE '2025-01-02'",
        ),
        "relative_date": (
            predicate("date_after", "last_contact", P.relative_boundary(400, now="2025-06-30")),
            f"{when} > DATE '2024-05-26'",
        ),
    }
    clauses = {name: (predicate(*args), where) for name, (args, where) in cases.items()} | options

    def register(name, clause, where):
        @query(f"pred_{name}", people_sql(f"SELECT person_id FROM people_v WHERE coalesce({where}, false)"))
        def run(spark, sf_dir):
            df = people(spark, sf_dir)
            return df.filter(P.compile_group(df, group("and", clause))).select("person_id")

    for name, (clause, where) in clauses.items():
        register(name, clause, where)


_register_operators()


def run(df, kind, **params):
    from rollbook.operators.facade import run as run_operation

    return run_operation(df, {"type": kind, "params": params}).rows


@query("run_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def run_top_n(spark, sf_dir):
    df = files.with_row_id(table(spark, sf_dir, "orders"), key="o_orderkey")
    return run(df, "top_n", column="o_totalprice", n=7, return_columns=["o_orderkey", "o_totalprice"])


@query("run_filter_predicates", people_sql(
    f"SELECT first_name, city FROM people_v WHERE {strict('giving')} > 5000"
))
def run_filter_predicates(spark, sf_dir):
    tree = group("and", predicate("greater_than", "giving", 5000))
    return run(people(spark, sf_dir), "filter_predicates", predicate_group=tree, sort={"column": "giving"}, return_columns=["first_name", "city"])


@query("run_contains_any", "SELECT p_partkey, 'p_name' AS matched_column, 'red' AS matched_term, 'Matched p_name: ' || p_name AS \"MATCH REASON\" FROM part "
       "WHERE contains(lower(p_name), 'red')")
def run_contains_any(spark, sf_dir):
    df = files.with_row_id(table(spark, sf_dir, "part"), key="p_partkey")
    return run(df, "contains_any", columns=["p_name"], terms=["red"], display_columns=["p_partkey"])
