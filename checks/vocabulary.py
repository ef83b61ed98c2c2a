"""Classification with a vocabulary that stays in a table: a few terms that occur, and one of every part, customer and order.

The oracles hold the terms against the distinct texts one by one, with the word and phrase rules spelt out in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.people_queries import _judged
from checks.registry import listed, query
from checks.sql import norm
from checks.views import people, people_sql, table
from rollbook.plans import classify as K
from rollbook.plans import people as H
from rollbook.plans.taxonomy import TermTable
from rollbook.sources.files import app_view

TERMS = (
    ("Science", "title", "data scientist"), ("Science", "title", "Nurse"), ("Science", "title", "r&d"), ("Science", "employer", "hospital"), ("Science", "employer", "labs"),
    ("Science", "company", "Northwind Software Inc"), ("Science", "exclusion", "clinical operations"), ("Science", "exclusion", "lead general"),
    ("Science", "ambiguous", "university"), ("Science", "ambiguous", "& cole"), ("Care", "title", "clinical"), ("Care", "employer", "general hosp"),
    ("Care", "retrieval", "hospital"), ("Care", "retrieval", "nurse"), ("Care", "company", "Springfield High School"), ("Tech", "company", "Google"),
    ("Tech", "company", "Orbit Cloud"), ("Tech", "retrieval", "cloud"), ("Tech", "retrieval", "product manager"), ("Tech", "retrieval", "Data"),
    ("Tech", "exclusion", "marketing manager orbit"), ("Tech", "ambiguous", "foods"), ("Banking", "employer", "bank"), ("Banking", "company", "capital one"),
)
#: Terms of the given tables: table, industry, kind, expression.
DERIVED = (
    ("part", "Tech", "company", "concat(p_name, ' ', p_partkey)"), ("part", "Science", "title", "concat(p_name, ' no ', p_partkey)"),
    ("customer", "Care", "employer", "c_name"), ("orders", "Science", "exclusion", "concat('order ', o_orderkey)"), ("orders", "Tech", "exclusion", "concat('order ', o_orderkey)"),
)


def vocabulary(spark, sf_dir):
    terms = spark.createDataFrame(list(TERMS), "industry string, kind string, term string")
    for name, industry, kind, expr in DERIVED:
        more = table(spark, sf_dir, name).select(F.lit(industry).alias("industry"), F.lit(kind).alias("kind"), F.expr(expr).alias("term"))
        terms = terms.unionByName(more)
    return TermTable(terms)


_VALUES = ", ".join("('{}', '{}', '{}')".format(i, k, t.replace("'", "''")) for i, k, t in TERMS)
_TERMS_SQL = f"voc AS (SELECT lower(i) AS i, k, term, {norm('term', 'a-z0-9&')} AS w, regexp_replace({norm('term')}, ' inc$', '') AS n FROM (VALUES {_VALUES}) v(i, k, term) " + " ".join(
    f"UNION ALL SELECT '{industry.lower()}', '{kind}', {expr}, {norm(expr, 'a-z0-9&')}, {norm(expr)} FROM {name}" for name, industry, kind, expr in DERIVED
) + ")"


def _in(text, term):
    return f"CASE WHEN contains({term}, ' ') THEN contains({text}, {term}) ELSE contains(' ' || regexp_replace({text}, '[^a-z0-9]', ' ', 'g') || ' ', ' ' || {term} || ' ') OR contains(' ' || {text} || ' ', ' ' || {term} || ' ') END"


def _texts_sql(*wanted):
    """f: people with a flag x<n> for each wanted (text, industry, kind)."""
    from checks.people_queries import FOLDED

    text = {"title": "t", "employer": "e", "descriptor": "d", "either": "trim(t || ' ' || e)", "anywhere": "trim(concat_ws(' ', nullif(t, ''), nullif(e, ''), nullif(d, '')))"}
    tests = ", ".join(
        f"bool_or(i = '{i}' AND k = '{k}' AND " + (f"contains(' ' || c || ' ', ' ' || n || ' ')" if p == "company" else _in(text[p], "w")) + f") AS x{j}"
        for j, (p, i, k) in enumerate(wanted)
    )
    return FOLDED, _TERMS_SQL, f"x AS (SELECT t, e, d, c, {tests} FROM (SELECT DISTINCT t, e, d, c FROM f), voc GROUP BY 1, 2, 3, 4)", "g AS (SELECT * FROM f JOIN x USING (t, e, d, c))"


_LAYERS = [("title", "title"), ("company", "company"), ("employer", "employer"), ("descriptor", "employer"), ("anywhere", "exclusion"), ("employer", "ambiguous")]


def _layered(at):
    title, company, employer, described, excluded, vague = (f"x{at + j}" for j in range(6))
    excluded = f"(NOT {title} AND {excluded})"
    return (
        f"CASE WHEN {title} THEN 'direct_match:1.0' WHEN {company} THEN 'direct_match:0.95' WHEN {employer} THEN 'direct_match:0.9' WHEN {described} AND NOT {excluded} THEN 'direct_match:0.82' "
        f"WHEN {excluded} THEN 'non_match:0.9' WHEN {vague} THEN 'uncertain:0.45' ELSE 'non_match:0.0' END"
    )


def _verdicts(verdict, *ctes):
    return people_sql(
        "SELECT person_id, split_part(v, ':', 1) AS classification, split_part(v, ':', 2)::DOUBLE AS confidence, v LIKE 'direct_match%' AND split_part(v, ':', 2)::DOUBLE >= 0.7 AS count_as_match FROM v",
        *ctes, f"v AS (SELECT person_id, {verdict} AS v FROM g)",
    )


def _shown(df):
    return df.select("person_id", "classification", "confidence", "count_as_match")


@query("classify_loaded", _verdicts(_layered(0), *_texts_sql(*((p, "science", k) for p, k in _LAYERS))))
def classify_loaded(spark, sf_dir):
    return _shown(K.classify(app_view(people(spark, sf_dir)), K.QuerySpec(("science",)), vocabulary(spark, sf_dir), details=False))


# A required industry shows by title, company or employer; the description of the employer does not count.
@query("classify_required_generic", _verdicts(
    f"CASE WHEN ({_layered(0)}) LIKE 'direct_match%' AND NOT (x6 OR x7 OR x8) THEN 'adjacent:0.6' ELSE ({_layered(0)}) END",
    *_texts_sql(*((p, "science", k) for p, k in _LAYERS), ("title", "care", "title"), ("company", "care", "company"), ("employer", "care", "employer")),
))
def classify_required_generic(spark, sf_dir):
    spec = K.QuerySpec(("science",), required=("care",))
    return _shown(K.classify(app_view(people(spark, sf_dir)), spec, vocabulary(spark, sf_dir), details=False))


@query("company_industries_loaded", people_sql(
    "SELECT person_id, array_to_string(list_filter([CASE WHEN x0 THEN 'banking' END, CASE WHEN x1 THEN 'tech' END, CASE WHEN x2 THEN 'care' END, CASE WHEN x3 THEN 'science' END], lambda x: x IS NOT NULL), '|') AS industries FROM g",
    *_texts_sql(*(("company", i, "company") for i in ("banking", "tech", "care", "science"))),
))
def company_industries_loaded(spark, sf_dir):
    return listed(K.company_industries(people(spark, sf_dir), taxonomies=vocabulary(spark, sf_dir)).select("person_id", "industries"), "industries")


_SEARCH = f"hits AS (SELECT t2, e2, count(DISTINCT trim(term)) AS h FROM (SELECT DISTINCT {norm(chr(99) + 'oalesce(occupation, chr(32))')} AS t2, {norm('coalesce(employer, chr(32))')} AS e2 FROM people_v), " \
    f"(SELECT term, {norm('term')} AS w FROM voc WHERE i = 'science' AND k IN ('company', 'retrieval') OR i = 'care' AND k IN ('company', 'retrieval')) WHERE {_in('t2', 'w')} OR {_in('e2', 'w')} GROUP BY 1, 2)"


# Without terms of its own: companies and retrieval terms of both industries of the question are the keywords.
@query("candidate_metrics_vocabulary", people_sql(
    "SELECT cast(coalesce(sum(h), 0) AS BIGINT) AS raw_match_count, count(*) FILTER (h > 0) AS candidate_count, count(*) FILTER (h > 0 AND NOT (counted OR (adjacent AND coalesce(person_id < pc, true)) "
    "OR (uncertain AND coalesce(person_id < least(pc, a0), true)))) AS non_match_count FROM "
    f"(SELECT j.*, p.c AS pc, p.a0, coalesce(h, 0) AS h FROM (SELECT *, {norm(chr(99) + 'oalesce(occupation, chr(32))')} AS t2, {norm('coalesce(employer, chr(32))')} AS e2 FROM j) j JOIN p USING (pk) LEFT JOIN hits USING (t2, e2))",
    *_texts_sql(*((p, i, k) for i in ("science", "care") for p, k in _LAYERS)),
    *(c.replace("FROM f)", "FROM (SELECT g.* FROM g))").replace("AS (SELECT *, CASE", "AS (SELECT * EXCLUDE (c), CASE") if c.startswith("j AS") else c
      for c in _judged("CASE WHEN rb > ra THEN b ELSE a END")[1:2]),
    *_judged("")[2:3], _SEARCH,
).replace("FROM (SELECT g.* FROM g)", "FROM (SELECT *, CASE split_part(a, ':', 1) WHEN 'direct_match' THEN 3 WHEN 'uncertain' THEN 1 ELSE 0 END * 10 + split_part(a, ':', 2)::DOUBLE AS ra, "
  "CASE split_part(b, ':', 1) WHEN 'direct_match' THEN 3 WHEN 'uncertain' THEN 1 ELSE 0 END * 10 + split_part(b, ':', 2)::DOUBLE AS rb "
  f"FROM (SELECT *, {_layered(0)} AS a, {_layered(6)} AS b FROM g))"))
def candidate_metrics_vocabulary(spark, sf_dir):
    spec = K.QuerySpec(("science", "care"))
    return H.candidate_metrics(app_view(people(spark, sf_dir)), spec, (), ["occupation", "employer"], vocabulary(spark, sf_dir), retrieval=True)
