"""Schema mapping, classification, people filter and evaluation queries.

The classification oracles spell the rules out again as SQL CASE chains over the same word lists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import ORACLES, listed, query, rounded
from checks.rows import group, predicate
from checks.sql import blank, emails, has, moment, norm
from checks.views import people, people_sql, table
from rollbook.operators.predicates import compile_group
from rollbook.operators.facade import run
from rollbook.plans import classify as K
from rollbook.plans import evaluate as X
from rollbook.plans import people as H
from rollbook.plans import phrases as V
from rollbook.plans import schema_map as M
from rollbook.plans.taxonomy import GENERIC_ROLES, SEED
from rollbook.functions.text import fold_company
from rollbook.session import saved
from rollbook.sources.files import app_view

# ---- schema mapping -------------------------------------------------------------------------------------------------

OPAQUE = {
    "F_NM": "first_name", "L_NM": "last_name", "BUS_NM": "employer", "BUS_POS": "occupation", "PREF_EML": "email",
    "ALT_EML": "alt_email", "CLASS_CD": "grad_year", "LINK": "linkedin_url", "Comments": "manager",
    "City": "city", "Home City": "state", "LT_GIFT_AMT": "giving", "LAST_CONTACT_DT": "last_contact", "DNC": "do_not_contact",
}


def opaque(spark, sf_dir):
    """People with cryptic headers and clean contact cells."""
    df = people(spark, sf_dir)
    cells = {new: F.col(old) for new, old in OPAQUE.items()}
    cells["PREF_EML"] = F.concat(F.lit("p"), F.col("person_id"), F.lit("@alpha.edu"))
    cells["ALT_EML"] = F.concat(F.lit("q"), F.col("person_id"), F.lit("@example.org"))
    cells["LINK"] = F.concat(F.lit("https://linkedin.com/in/p"), F.col("person_id"))
    return df.select(*(c.alias(n) for n, c in cells.items()), "_row_id")


@query("column_metadata", people_sql(
    "SELECT 'grad_year' AS \"column\", 'integer' AS type, count(*) - count(grad_year) AS missing_count, count(DISTINCT grad_year) AS unique_count, "
    "(SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT grad_year::VARCHAR AS v, min(person_id) AS k FROM people_v WHERE grad_year IS NOT NULL GROUP BY 1 ORDER BY k LIMIT 3)) AS sample_values FROM people_v "
    "UNION ALL SELECT 'alt_email', 'text', count(*) - count(alt_email), count(DISTINCT alt_email), 'm***@example.org|a***@alpha.edu' FROM people_v"
))
def column_metadata(spark, sf_dir):
    return listed(M.column_metadata(people(spark, sf_dir).select("grad_year", "alt_email", "_row_id")), "sample_values")


def _rate(cell, test):
    """Share of the present values, blanks left out, that pass a test on v."""
    return f"(SELECT avg(({test})::INT) FROM (SELECT {cell} AS v FROM people_v) WHERE trim(v) <> '')"


_P_MAIL, _Q_MAIL = "'p' || person_id || '@alpha.edu'", "'q' || person_id || '@example.org'"
_HAS_MAIL = f"len({emails('v')}) > 0"
_IS_NUMBER = "try_cast(regexp_replace(v, '[$,%\\s]', '', 'g') AS DOUBLE) IS NOT NULL"
# Source, position, field, confidence, and the condition under which the cells speak for the field.
_CELL_RULES = (
    ("PREF_EML", 4, "email", 0.88, f"{_rate(_P_MAIL, _HAS_MAIL)} >= 0.85"),
    ("ALT_EML", 5, "email", 0.88, f"{_rate(_Q_MAIL, _HAS_MAIL)} >= 0.85"),
    ("CLASS_CD", 6, "grad_year", 0.84, _rate("grad_year::VARCHAR", "v::INT BETWEEN 1900 AND 2035") + " >= 0.85"),
    ("LINK", 7, "linkedin_url", 0.82, _rate("'https://linkedin.com/in/p' || person_id", "contains(v, 'linkedin.com/')") + " >= 0.8"),
    ("LT_GIFT_AMT", 11, "lifetime_giving", 0.76, _rate("giving", _IS_NUMBER) + " >= 0.85"),
    ("LAST_CONTACT_DT", 12, "last_contact_date", 0.79, _rate("last_contact", f"{moment('v')} IS NOT NULL") + " >= 0.8"),
    ("DNC", 13, "do_not_contact", 0.82, _rate("do_not_contact", "lower(v) IN ('yes', 'no', 'y', 'n', '1', '0')") + " >= 0.9"),
)
_CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS source, {o} AS ordinal, '{f}' AS canonical_field, {c}::DOUBLE AS confidence, 'sample_inference' AS method, 'Most sampled values look like this field.' AS evidence WHERE {w}"
    for s, o, f, c, w in _CELL_RULES
)
_HEADERS_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS source, {o} AS ordinal, '{f}' AS canonical_field, {c}::DOUBLE AS confidence, '{m}' AS method, "
    + ("'The header is a known alias.'" if m == "exact_alias" else "'The header has the shape of this field.'") + " AS evidence"
    for s, o, f, c, m in (
        ("F_NM", 0, "first_name", 0.91, "header_heuristic"), ("L_NM", 1, "last_name", 0.91, "header_heuristic"),
        ("BUS_NM", 2, "employer", 0.86, "header_heuristic"), ("City", 9, "city", 0.99, "exact_alias"),
        ("CLASS_CD", 6, "grad_year", 0.82, "header_heuristic"),
        ("Home City", 10, "city", 0.99, "exact_alias"), ("LT_GIFT_AMT", 11, "lifetime_giving", 0.90, "header_heuristic"),
        ("LAST_CONTACT_DT", 12, "last_contact_date", 0.92, "header_heuristic"), ("DNC", 13, "do_not_contact", 0.99, "exact_alias"),
    )
)
_SCHEMA_CTES = (
    f"cand AS (SELECT source, ordinal, canonical_field, max(confidence) AS confidence, arg_max(method, confidence) AS method, arg_max(evidence, confidence) AS evidence FROM ({_HEADERS_SQL} UNION ALL {_CELLS_SQL}) GROUP BY 1, 2, 3)",
    "best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY source ORDER BY confidence DESC, canonical_field) = 1)",
    "prof AS (SELECT canonical_field, string_agg(source, '|' ORDER BY confidence DESC, ordinal) AS source_columns, min(confidence) AS confidence, "
    "CASE WHEN count(DISTINCT method) = 1 THEN min(method) ELSE 'combined_inference' END AS method, min(evidence) AS evidence, count(*) AS n FROM best GROUP BY 1 HAVING count(*) = 1 OR canonical_field IN ('email', 'phone'))",
    "labelled AS (SELECT canonical_field, source_columns, confidence, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS label, method, false AS user_confirmed, evidence, n FROM prof)",
)
_PROFILE_COLUMNS = "canonical_field, source_columns, confidence, label, method, user_confirmed, evidence"


@query("sample_candidates", people_sql(f"SELECT * EXCLUDE (evidence) FROM ({_CELLS_SQL})"))
def sample_candidates(spark, sf_dir):
    return M.sample_candidates(opaque(spark, sf_dir), this_year=2025).drop("evidence")


@query("sample_rates", people_sql(
    f"SELECT 'do_not_contact' AS \"column\", count(*) AS filled, 1.0::DOUBLE AS boolean_rate, 0.0::DOUBLE AS email_rate FROM people_v UNION ALL "
    f"SELECT 'email', count(*), 0.0::DOUBLE, round(avg((len({emails('email')}) > 0)::INT), 6) FROM people_v WHERE NOT {blank('email')}"
))
def sample_rates(spark, sf_dir):
    rates = M.sample_rates(people(spark, sf_dir).select("do_not_contact", "email", "_row_id"), this_year=2025)
    return rounded(rates.select("column", "filled", "boolean_rate", "email_rate"), 6, "email_rate")


@query("infer_schema", people_sql(f"SELECT {_PROFILE_COLUMNS} FROM labelled", *_SCHEMA_CTES))
def infer_schema(spark, sf_dir):
    return listed(M.infer_schema(opaque(spark, sf_dir), this_year=2025), "source_columns", "evidence")


@query("unmapped_columns", people_sql(
    "SELECT ordinal, source FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(OPAQUE)) + ") h(ordinal, source) "
    "WHERE source <> 'Comments' AND NOT EXISTS (SELECT 1 FROM labelled WHERE list_contains(string_split(source_columns, '|'), source))",
    *_SCHEMA_CTES,
))
def unmapped_columns(spark, sf_dir):
    df = opaque(spark, sf_dir)
    return M.unmapped_columns(M.infer_schema(df, this_year=2025), list(OPAQUE), ignored=("Comments",))


@query("schema_conflicts", people_sql(
    "SELECT 'single_field_multiple_sources' AS type, canonical_field AS canonical_fields, string_agg(source, '|' ORDER BY confidence DESC, ordinal) AS source_columns FROM best "
    "WHERE canonical_field NOT IN ('email', 'phone') GROUP BY canonical_field HAVING count(*) > 1",
    *_SCHEMA_CTES,
))
def schema_conflicts(spark, sf_dir):
    return listed(M.schema_conflicts(opaque(spark, sf_dir), this_year=2025), "canonical_fields", "source_columns")


@query("merge_profile", people_sql(
    f"SELECT {_PROFILE_COLUMNS} FROM labelled WHERE canonical_field NOT IN ('employer', 'occupation') UNION ALL "
    "SELECT 'employer', 'BUS_NM', 1.0::DOUBLE, 'high', 'user_confirmed', true, '' UNION ALL SELECT 'occupation', 'BUS_POS', 1.0::DOUBLE, 'high', 'user_confirmed', true, ''",
    *_SCHEMA_CTES,
))
def merge_profile(spark, sf_dir):
    df = opaque(spark, sf_dir)
    confirmed = M.validate_mapping({"employer": ["BUS_NM"], "occupation": ["BUS_POS"]}, df.columns)
    merged = M.merge_profile(M.infer_schema(df, this_year=2025), M.confirmed_profile(spark, confirmed))
    return listed(merged, "source_columns", "evidence")


# City and Home City rival for one field; the confirmed city settles that, and takes Home City out of the inferred rows.
@query("merge_profile_pruned", people_sql(
    "SELECT 'confirmed' AS status, coalesce((SELECT string_agg(source, '|' ORDER BY ordinal) FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(OPAQUE)) + ") h(ordinal, source) "
    "WHERE source NOT IN ('DNC', 'Home City') AND NOT EXISTS (SELECT 1 FROM labelled WHERE list_contains(string_split(source_columns, '|'), source))), '') AS unmapped_columns, 'DNC' AS ignored_columns, "
    "(SELECT count(*) FROM (SELECT canonical_field FROM best WHERE canonical_field NOT IN ('email', 'phone', 'city') GROUP BY 1 HAVING count(*) > 1)) AS conflicts",
    *(c.replace("FROM best GROUP BY 1", "FROM best WHERE source <> 'DNC' GROUP BY 1") for c in _SCHEMA_CTES),
))
def merge_profile_pruned(spark, sf_dir):
    df = opaque(spark, sf_dir)
    columns = list(OPAQUE)
    confirmed = M.confirmed_profile(spark, M.validate_mapping({"city": ["Home City"]}, columns, ignored=("DNC",)))
    inferred = M.infer_schema(df.drop("DNC"), this_year=2025)
    conflicts = M.schema_conflicts(df.drop("DNC"), this_year=2025)
    state = M.profile_state(inferred, confirmed, conflicts, columns, ignored=("DNC", "gone", "Home City"), status="confirmed")
    return listed(state, "unmapped_columns", "ignored_columns")


@query("apply_mapping", people_sql(
    "SELECT first_name, employer, 'p' || person_id || '@alpha.edu|q' || person_id || '@example.org' AS email, grad_year FROM people_v"
))
def apply_mapping(spark, sf_dir):
    df = opaque(spark, sf_dir)
    confirmed = M.confirmed_profile(spark, {"employer": ["BUS_NM"], "email": ["PREF_EML", "ALT_EML"], "grad_year": ["CLASS_CD"]})
    profile = M.merge_profile(M.infer_schema(df, this_year=2025), confirmed)
    mapped = M.apply_mapping(df, M.active_mapping(profile, df.columns))
    return listed(mapped.select("first_name", "employer", "email", "grad_year"), "email")


@query("semantic_columns", people_sql("SELECT person_id, email, alt_email FROM people_v"))
def semantic_columns(spark, sf_dir):
    df = people(spark, sf_dir).withColumn("email_status", F.lit("ok"))
    return df.select("person_id", *M.semantic_columns(df, "email"))


@query("schema_summary", people_sql(
    f"SELECT count(*) AS schema_mapped_count, cast(0 AS BIGINT) AS schema_confirmed_count, cast({len(OPAQUE)} - sum(n) AS BIGINT) AS schema_unmapped_count, "
    "(SELECT count(*) FROM (SELECT canonical_field FROM best WHERE canonical_field <> 'email' GROUP BY 1 HAVING count(*) > 1)) AS schema_conflict_count FROM labelled",
    *_SCHEMA_CTES,
))
def schema_summary(spark, sf_dir):
    df = opaque(spark, sf_dir)
    profile = M.infer_schema(df, this_year=2025)
    return M.schema_summary(profile, [c for c in df.columns if c != "_row_id"], M.schema_conflicts(df, this_year=2025))


# ---- classification -------------------------------------------------------------------------------------------------

SPELT = "trim(regexp_replace(replace(trim(regexp_replace(regexp_replace(lower(coalesce(employer, '')), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), 'capitol one', 'capital one'), '\\b(?:inc|llc|ltd|corp|co|company)\\b', '', 'g'))"
FOLDED = (
    "f AS (SELECT *, " + norm("coalesce(occupation, '')", "a-z0-9&") + " AS t, " + norm("coalesce(employer, '')", "a-z0-9&") + " AS e, "
    + norm("coalesce(employer_description, '')", "a-z0-9&") + " AS d, trim(regexp_replace(" + SPELT + ", ' +', ' ', 'g')) AS c FROM people_v)"
)


def _company(names):
    folded = [fold_company(n) for n in names]
    return f"regexp_matches(c, '\\b(?:{'|'.join(folded)})\\b')" if folded else "false"


def _t(*terms):
    return has("t", list(terms))


def _e(*terms):
    return has("e", list(terms))


def _of(industry):
    v = SEED.get(industry)
    return f"({_company(v.company)} OR {_e(*v.employer)})"


def _label(label):
    return "(" + " OR ".join(_of(i) for i, name in V.EMPLOYER_LABELS.items() if name == label) + ")"


_PS, _TECHNOLOGY, _GOV, _FIN = (_label(n) for n in ("consulting_professional_services", "technology", "government_legal", "financial_services"))
_ANY_LABEL = "(" + " OR ".join(_label(n) for n in dict.fromkeys(V.EMPLOYER_LABELS.values())) + ")"


def _case(rules, otherwise):
    whens = " ".join(f"WHEN {condition} THEN '{name}:{confidence}'" for condition, name, confidence in rules)
    return f"CASE {whens} ELSE '{otherwise}' END"


_D, _A, _U, _N = "direct_match", "adjacent", "uncertain", "non_match"
_ADVISERS = f"({_PS} AND {_e('consulting', 'advisory', 'professional services')})"
_KNOWN_TECH, _TECH_WORD, _WEAK = _company(SEED.get("tech").company), _e(*V.TECH_EMPLOYER_WORDS), _t(*V.TECH_ADJACENT_TITLES)
_OTHER_DOMAIN = has("(t || ' ' || e)", list(SEED.get("tech").exclusion))
_VAGUE = _e(*SEED.get("tech").ambiguous)
_TECHNICAL = _t(*V.TECHNICAL_TITLES)

TECH = _case(
    [
        (f"{_TECHNICAL} AND contains(t, 'clinical data analyst')", _A, 0.58), (_TECHNICAL, _D, 0.98),
        ("contains(t, 'marketplace operations')", _A, 0.52), (_ADVISERS, _A, 0.58), (_KNOWN_TECH, _D, 0.95),
        (f"{_TECH_WORD} AND NOT {_OTHER_DOMAIN}", _D, 0.88), (_WEAK, _A, 0.55), (_VAGUE, _U, 0.45),
    ],
    f"{_N}:0.2",
)
TECH_ROLE = _case(
    [(_TECHNICAL, _D, 0.98), (f"{_KNOWN_TECH} OR {_TECH_WORD}", _A, 0.58), (_WEAK, _A, 0.5), (_VAGUE, _U, 0.45)], f"{_N}:0.2"
)
TECH_COMPANY = _case(
    [
        (_ADVISERS, _A, 0.58), (_KNOWN_TECH, _D, 0.95), (f"{_TECH_WORD} AND NOT {_OTHER_DOMAIN}", _D, 0.88),
        (_TECHNICAL, _A, 0.62), (_WEAK, _A, 0.52), (_VAGUE, _U, 0.45),
    ],
    f"{_N}:0.2",
)
_BANK_IB = _company(SEED.get("investment_banking").company)
IB = _case(
    [
        (_t(*V.INVESTMENT_BANKING_TITLES), _D, 0.98),
        (_t("corporate banking", "commercial banking", "risk analyst", "wealth management", "asset management"), _N, 0.85),
        (f"{_BANK_IB} AND {_t('analyst', 'associate', 'vice president')}", _U, 0.45), (_BANK_IB, _N, 0.75),
    ],
    f"{_N}:0.2",
)
_BANK = _of("banking")
_BANK_RULES = [
    (_GOV, _N, 0.9), (_t(*V.BANKING_TITLES, *V.INVESTMENT_BANKING_TITLES), _D, 0.92),
    (f"{_BANK} AND {_t('software engineer', 'developer', 'product manager', 'marketing manager')}", _N, 0.8),
    (f"{_BANK} AND t = ''", _D, 0.78),
    (f"{_BANK} AND {_t('analyst', 'associate', 'vice president', 'risk', 'credit', 'finance')}", _D, 0.78), (_BANK, _U, 0.45),
]
BANKING = _case(_BANK_RULES, f"{_N}:0.2")
FINANCE = _case(
    [
        (_GOV, _N, 0.9), (f"({BANKING}) LIKE '{_D}%'", _N, 0.88),
        (_t(*V.FINANCE_TITLES, *V.INVESTMENT_BANKING_TITLES), _D, 0.9), (_of("finance"), _D, 0.82),
    ],
    f"{_N}:0.2",
)
MARKETING = _case(
    [
        (_t(*V.MARKETING_TITLES), _D, 0.95), (_t(*V.MARKETING_ADJACENT_TITLES), _A, 0.55),
        (f"{_of('marketing')} AND (t = '' OR {_t('manager', 'analyst', 'director', 'coordinator', 'strategist')})", _D, 0.78),
        (_of("marketing"), _U, 0.45),
    ],
    f"{_N}:0.2",
)
OPERATIONS = _case(
    [
        (f"{_t(*V.OPERATIONS_TITLES)} AND {_t('product operations', 'curriculum operations', 'clinical operations', 'revops')}", _N, 0.85),
        (_t(*V.OPERATIONS_TITLES), _D, 0.95), (_t(*V.OPERATIONS_ADJACENT_TITLES), _A, 0.55),
        (f"{_of('operations')} AND {_t('manager', 'analyst', 'associate', 'director')}", _D, 0.78), (_of("operations"), _U, 0.45),
    ],
    f"{_N}:0.2",
)
GOVERNMENT = _case(
    [
        (_t(*V.GOVERNMENT_LEGAL_TITLES), _D, 0.95),
        (f"{_of('government_legal')} AND contains(e, 'department of education') AND NOT {_t('policy', 'legal', 'attorney', 'law')}", _N, 0.85),
        (_of("government_legal"), _D, 0.88), (has("(t || ' ' || e)", list(SEED.get("government_legal").ambiguous)), _U, 0.4),
    ],
    f"{_N}:0.2",
)
_ADV, _FA = _t(*V.CLIENT_ADVISORY_TITLES), "contains(t, 'financial advisory')"
_FN = {n: _t(*terms) for n, terms in V.JOB_FUNCTIONS.items()}
_FN["internal_strategy"] = f"({_FN['internal_strategy']} AND NOT {_FN['consulting_advisory']})"
CONSULTING = _case(
    [
        ("t = '' AND e = ''", _U, 0.2), (_t("consultant", "consulting"), _D, 0.95), (f"{_ADV} AND {_PS}", _D, 0.9),
        (f"{_ADV} AND NOT {_ANY_LABEL}", _D, 0.75), (f"{_ADV} AND {_FIN}", _A, 0.6), (_ADV, _U, 0.55),
        (f"{_FA} AND {_PS}", _D, 0.85), (_FA, _A, 0.6), (_FN["legal"], _N, 0.9),
        (f"{_t(*V.FINANCE_NOT_CONSULTING_TITLES)} AND NOT {_PS}", _N, 0.85),
        (f"{_PS} AND ({_FN['engineering']} OR {_FN['finance_investing']} OR {_FN['education_teaching']})", _U, 0.55), (_PS, _D, 0.8),
        (_t("advisor", "adviser"), _U, 0.5),
        (f"{_FN['internal_strategy']} OR {_FN['product']} OR {_FN['operations']} OR {_t(*V.CONSULTING_ADJACENT_WORDS)}", _A, 0.6),
        (_e(*SEED.get("consulting").ambiguous), _U, 0.45),
    ],
    f"{_N}:0.2",
)


def _layers(industry):
    v = SEED.get(industry)
    excluded = f"(NOT {_t(*v.title)} AND {has(chr(40) + 't || chr(32) || e || chr(32) || d' + chr(41), list(v.exclusion))})"
    return _t(*v.title), _company(v.company), _e(*v.employer), f"({has('d', list(v.employer))} AND NOT {excluded})", excluded, _e(*v.ambiguous)


def _generic(industry):
    title, company, employer, described, excluded, vague = _layers(industry)
    return _case(
        [(title, _D, 1.0), (company, _D, 0.95), (employer, _D, 0.9), (described, _D, 0.82), (excluded, _N, 0.9), (vague, _U, 0.45)],
        f"{_N}:0.0",
    )


def _classified(verdict):
    return people_sql(
        "SELECT person_id, split_part(v, ':', 1) AS classification, split_part(v, ':', 2)::DOUBLE AS confidence, "
        "v LIKE 'direct_match%' AND split_part(v, ':', 2)::DOUBLE >= 0.7 AS count_as_match FROM v",
        FOLDED, f"v AS (SELECT person_id, {verdict} AS v FROM f)",
    )


def _shown(df):
    return df.select("person_id", "classification", "confidence", "count_as_match")


def _register(name, spec, verdict):
    @query(name, _classified(verdict))
    def run(spark, sf_dir):
        return _shown(K.classify(app_view(people(spark, sf_dir)), spec, details=False))


for _name, _spec, _verdict in (
    ("classify_tech", K.QuerySpec(("tech",)), TECH),
    ("classify_tech_role", K.QuerySpec(("technology",), scope="technical_role"), TECH_ROLE),
    ("classify_tech_company", K.QuerySpec(("tech",), scope="tech_company"), TECH_COMPANY),
    ("classify_ib", K.QuerySpec(("ib",)), IB),
    ("classify_banking", K.QuerySpec(("banking",)), BANKING),
    ("classify_finance", K.QuerySpec(("finance",)), FINANCE),
    ("classify_marketing", K.QuerySpec(("marketing",)), MARKETING),
    ("classify_operations", K.QuerySpec(("operations",)), OPERATIONS),
    ("classify_government", K.QuerySpec(("government",)), GOVERNMENT),
    ("classify_consulting", K.QuerySpec(("consulting",)), CONSULTING),
    ("classify_generic", K.QuerySpec(("healthcare",)), _generic("healthcare")),
):
    _register(_name, _spec, _verdict)

_RELATED_FINANCE = _t(*(term for name in V.RELATED_SPECIALTIES["finance"] for term in V.SPECIALTIES[name]))
_FINANCE_SIGN = f"({_FIN} OR {_RELATED_FINANCE} OR ({FINANCE}) LIKE '{_D}%')"


@query("classify_required", _classified(
    f"CASE WHEN ({CONSULTING}) LIKE '{_D}%' AND NOT {_FINANCE_SIGN} THEN '{_A}:0.6' ELSE ({CONSULTING}) END"
))
def classify_required(spark, sf_dir):
    spec = K.QuerySpec(("consulting",), required=("finance",))
    return _shown(K.classify(app_view(people(spark, sf_dir)), spec, details=False))


@query("classify_excluded", _classified(
    f"CASE WHEN ({TECH}) LIKE '{_D}%' AND (({_generic('healthcare')}) LIKE '{_D}%' OR {_FN['product']}) THEN '{_N}:0.9' ELSE ({TECH}) END"
))
def classify_excluded(spark, sf_dir):
    spec = K.QuerySpec(("tech",), excluded=("healthcare",), excluded_functions=("product",))
    return _shown(K.classify(app_view(people(spark, sf_dir)), spec, details=False))


@query("classify_functions", _classified(
    f"CASE WHEN ({CONSULTING}) NOT LIKE '{_D}%' AND {_FN['internal_strategy']} THEN '{_D}:' || greatest(0.85, split_part(({CONSULTING}), ':', 2)::DOUBLE) ELSE ({CONSULTING}) END"
))
def classify_functions(spark, sf_dir):
    spec = K.QuerySpec(("consulting",), functions=("internal_strategy",))
    return _shown(K.classify(app_view(people(spark, sf_dir)), spec, details=False))


@query("classify_adjacent", people_sql(
    "SELECT person_id, split_part(v, ':', 1) AS classification, v LIKE 'direct_match%' OR v LIKE 'adjacent%' AS count_as_match FROM v",
    FOLDED, f"v AS (SELECT person_id, {OPERATIONS} AS v FROM f)",
))
def classify_adjacent(spark, sf_dir):
    spec = K.QuerySpec(("operations",), include_adjacent=True)
    return K.classify(app_view(people(spark, sf_dir)), spec, details=False).select("person_id", "classification", "count_as_match")


def _rank(verdict):
    return f"(CASE split_part({verdict}, ':', 1) WHEN '{_D}' THEN 3 WHEN '{_A}' THEN 2 WHEN '{_U}' THEN 1 ELSE 0 END * 10 + split_part({verdict}, ':', 2)::DOUBLE)"


@query("classify_several", people_sql(
    f"SELECT person_id, split_part(v, ':', 1) AS classification, split_part(v, ':', 2)::DOUBLE AS confidence FROM "
    f"(SELECT person_id, CASE WHEN {_rank('b')} > {_rank('a')} THEN b ELSE a END AS v FROM v)",
    FOLDED, f"v AS (SELECT person_id, {BANKING} AS a, {IB} AS b FROM f)",
))
def classify_several(spark, sf_dir):
    spec = K.QuerySpec(("banking", "investment_banking"))
    return _shown(K.classify(app_view(people(spark, sf_dir)), spec, details=False)).drop("count_as_match")


_ROLE = "CASE WHEN t = '' THEN 'unknown' " + " ".join(f"WHEN {_t(*terms)} THEN '{n}'" for n, terms in V.ROLE_SIGNALS) + " ELSE 'unknown' END"
_EMP = (
    "CASE WHEN e = '' THEN 'unknown' " + " ".join(f"WHEN {_label(label)} THEN '{n}'" for label, n in V.EMPLOYER_SIGNALS)
    + f" WHEN {_e(*V.RESEARCH_EMPLOYER_WORDS)} THEN 'research' WHEN {_VAGUE} THEN 'ambiguous' ELSE 'unknown' END"
)
_CODE = (
    f"CASE WHEN v LIKE '{_D}%' THEN CASE WHEN {_TECHNICAL} AND {_FIN} THEN 'technical_role_in_finance' WHEN {_TECHNICAL} THEN 'role_is_technical' "
    f"WHEN {_KNOWN_TECH} AND r = 'product' THEN 'product_role_at_tech_company' WHEN {_KNOWN_TECH} AND r = 'business' THEN 'business_role_at_tech_company' "
    f"WHEN {_KNOWN_TECH} THEN 'employer_is_known_tech' WHEN {_TECH_WORD} THEN 'employer_has_strong_tech_keyword' ELSE 'direct_match' END "
    f"WHEN v LIKE '{_A}%' THEN CASE WHEN r = 'product' THEN 'product_at_nontech_or_ambiguous_employer' WHEN r = 'analytics' THEN 'analytics_adjacent' "
    f"WHEN s = 'ambiguous' THEN 'ambiguous_tech_company' ELSE 'tech_adjacent' END WHEN v LIKE '{_U}%' THEN 'uncertain_signal' ELSE 'excluded_no_meaningful_signal' END"
)


@query("classify_signals", people_sql(
    f"SELECT person_id, CASE split_part(v, ':', 1) WHEN '{_D}' THEN 'direct' WHEN '{_N}' THEN 'excluded' ELSE split_part(v, ':', 1) END AS match_category, "
    "CASE WHEN split_part(v, ':', 2)::DOUBLE >= 0.85 THEN 'high' WHEN split_part(v, ':', 2)::DOUBLE >= 0.6 THEN 'medium' ELSE 'low' END AS match_confidence, "
    f"r AS role_signal, s AS employer_signal, {_CODE} AS match_reason_code FROM v",
    FOLDED, f"v AS (SELECT *, {TECH} AS v, {_ROLE} AS r, {_EMP} AS s FROM f)",
))
def classify_signals(spark, sf_dir):
    return K.classify(app_view(people(spark, sf_dir)), K.QuerySpec(("tech",))).select(
        "person_id", "match_category", "match_confidence", "role_signal", "employer_signal", "match_reason_code"
    )


def _label_list(pairs, empty):
    items = ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in pairs)
    return f"coalesce(nullif(array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), '|'), ''), '{empty}')"


@query("profile_people", people_sql(
    f"SELECT person_id, {_label_list([(n, _label(n)) for n in dict.fromkeys(V.EMPLOYER_LABELS.values())], 'unknown')} AS employer_industry, "
    f"CASE WHEN t = '' THEN 'unknown' ELSE {_label_list(list(_FN.items()), 'other')} END AS job_function, "
    f"{_label_list([(n, _t(*terms)) for n, terms in V.SPECIALTIES.items()], 'unknown')} AS specialties FROM f", FOLDED,
))
def profile_people(spark, sf_dir):
    df = K.profile_people(people(spark, sf_dir)).select("person_id", "employer_industry", "job_function", "specialties")
    return listed(df, "employer_industry", "job_function", "specialties")


def _match_sql(industry):
    title, company, employer, described, excluded, vague = _layers(industry)
    roles = _t(*dict.fromkeys(r.replace("-", " ") for r in (*GENERIC_ROLES, *SEED.get(industry).generic)))
    ride = f"CASE WHEN {roles} THEN '|generic_business_role_with_matching_employer' ELSE '' END"
    return people_sql(
        f"SELECT person_id, CASE WHEN {title} OR {company} OR {employer} OR {described} THEN 'confirmed' WHEN {excluded} THEN 'excluded' WHEN {vague} THEN 'uncertain' ELSE 'excluded' END AS status, "
        f"CASE WHEN {title} THEN 'title_keyword' WHEN {company} THEN 'known_company' || {ride} WHEN {employer} OR {described} THEN 'employer_keyword' || {ride} "
        f"WHEN {excluded} THEN 'exclusion_keyword' WHEN {vague} THEN 'ambiguous_employer' ELSE '' END AS match_sources, "
        f"CASE WHEN {title} THEN 1.0 WHEN {company} THEN 0.95 WHEN {employer} THEN 0.9 WHEN {described} THEN 0.82 WHEN {excluded} THEN 0.9 WHEN {vague} THEN 0.45 ELSE 0.0 END::DOUBLE AS confidence FROM f",
        FOLDED,
    )


@query("match_industry", _match_sql("tech"))
def match_industry(spark, sf_dir):
    df = K.match_industry(app_view(people(spark, sf_dir)), "tech").select("person_id", "status", "match_sources", "confidence")
    return listed(df, "match_sources")


@query("people_by_employer", people_sql(f"SELECT person_id FROM f WHERE {_company(['Goldman Sachs', 'Capital One'])}", FOLDED))
def people_by_employer(spark, sf_dir):
    return K.people_by_employer(people(spark, sf_dir), ["Goldman Sachs", "Capital One"]).select("person_id")


@query("people_by_occupation", people_sql(f"SELECT person_id FROM f WHERE {_t('founder', 'data scientist')}", FOLDED))
def people_by_occupation(spark, sf_dir):
    return K.people_by_occupation(people(spark, sf_dir), ["founder", "data scientist"]).select("person_id")


@query("company_industries", people_sql(
    f"SELECT person_id, array_to_string(list_filter([CASE WHEN {_company(SEED.get('investment_banking').company)} THEN 'investment_banking' END, CASE WHEN {_company(SEED.get('banking').company)} THEN 'banking' END, "
    f"CASE WHEN {_company(SEED.get('consulting').company)} THEN 'consulting' END, CASE WHEN {_company(SEED.get('marketing').company)} THEN 'marketing' END, "
    f"CASE WHEN {_company(SEED.get('tech').company)} THEN 'tech' END], lambda x: x IS NOT NULL), '|') AS industries FROM f", FOLDED,
))
def company_industries(spark, sf_dir):
    return listed(K.company_industries(people(spark, sf_dir)).select("person_id", "industries"), "industries")


_MATCH_TECH = _match_sql("tech")


@query("explain_people", _MATCH_TECH.replace(
    "SELECT person_id, CASE WHEN", "SELECT trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) AS name, occupation, employer, 'tech' AS target_industry, CASE WHEN", 1,
) + " WHERE contains(lower(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), 'grace') AND contains(lower(coalesce(first_name, '') || ' ' || coalesce(last_name, '')), 'o')")
def explain_people(spark, sf_dir):
    return listed(K.explain_people(app_view(people(spark, sf_dir)), "Grace O", "technology"), "match_sources")


# ---- people filters -------------------------------------------------------------------------------------------------

_COMPACT = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
PERSON = (
    f"CASE WHEN NOT {blank('first_name')} AND NOT {blank('last_name')} THEN 'name|' || {_COMPACT.format('first_name')} || '|' || {_COMPACT.format('last_name')} "
    f"WHEN NOT {blank('first_name')} THEN 'person|' || {_COMPACT.format('first_name')} "
    f"WHEN NOT {blank('email')} THEN 'stable|' || {_COMPACT.format('email')} ELSE 'row|' || person_id END"
)


def _judged(verdict, include_adjacent=False):
    counted = f"(v LIKE '{_D}%' AND split_part(v, ':', 2)::DOUBLE >= 0.7)"
    if include_adjacent:
        counted = f"({counted} OR v LIKE '{_A}%')"
    return (
        FOLDED,
        f"j AS (SELECT *, {PERSON} AS pk, {counted} AS counted, {counted} AND v NOT LIKE '{_A}%' AS direct, NOT {counted} AND v LIKE '{_A}%' AS adjacent, "
        f"NOT {counted} AND v LIKE '{_U}%' AS uncertain FROM (SELECT *, {verdict} AS v FROM f))",
        "p AS (SELECT pk, min(person_id) FILTER (counted) AS c, max(person_id) FILTER (direct) AS d, min(person_id) FILTER (adjacent) AS a0, min(person_id) FILTER (uncertain) AS u0 FROM j GROUP BY 1)",
        "q AS (SELECT pk, c, d, CASE WHEN c IS NULL THEN a0 END AS a, CASE WHEN c IS NULL AND a0 IS NULL THEN u0 END AS u FROM p)",
        "s AS (SELECT 'counted' AS bucket, c AS id FROM q WHERE c IS NOT NULL UNION ALL SELECT 'direct', d FROM q WHERE d IS NOT NULL UNION ALL SELECT 'adjacent', a FROM q WHERE a IS NOT NULL UNION ALL SELECT 'uncertain', u FROM q WHERE u IS NOT NULL)",
    )


_DISPLAY = 'first_name AS "First Name", last_name AS "Last Name", occupation AS "Occupation", employer AS "Employer", linkedin_url AS "LinkedIn URL"'


@query("person_key", people_sql(f"SELECT person_id, {PERSON} AS person FROM people_v"))
def person_key(spark, sf_dir):
    df = people(spark, sf_dir)
    return df.select("person_id", H.person_key(df).alias("person"))


@query("dedupe_people", people_sql(f"SELECT min(person_id) AS person_id FROM people_v GROUP BY {PERSON}"))
def dedupe_people(spark, sf_dir):
    return H.dedupe_people(people(spark, sf_dir)).select("person_id")


TECH_SPEC = K.QuerySpec(("tech",))


@query("people_filter", people_sql(f"SELECT bucket, {_DISPLAY}, id AS _row_id FROM s JOIN people_v ON person_id = id", *_judged(TECH)))
def people_filter(spark, sf_dir):
    return H.people_filter(app_view(people(spark, sf_dir)), TECH_SPEC)


@query("people_filter_employer", people_sql(
    "SELECT 'counted' AS bucket, min(person_id) AS _row_id FROM h GROUP BY pk UNION ALL SELECT 'direct', max(person_id) FROM h GROUP BY pk",
    FOLDED, f"h AS (SELECT *, {PERSON} AS pk FROM f WHERE {_company(['Goldman Sachs', 'Capital One'])})",
))
def people_filter_employer(spark, sf_dir):
    spec = K.QuerySpec(employers=("Goldman Sachs", "Capital One"))
    return H.people_filter(app_view(people(spark, sf_dir)), spec).select("bucket", "_row_id")


@query("run_composite_sorted", people_sql(
    f"SELECT bucket, {_DISPLAY}, {{matching}}, id AS _row_id FROM s JOIN people_v ON person_id = id WHERE {{exact}}", *_judged(TECH),
).replace("{matching}", "_MATCHING_").replace("{exact}", "_EXACT_"))
def run_composite_sorted(spark, sf_dir):
    params = {
        "people_operation": {"type": "contains_any", "params": {"filter_mode": "people", "people_filter": {"industries": ["tech"]}}},
        "predicate_group": EXACT, "constraint_logic": "and", "sort": {"column": "event_count", "direction": "desc"},
    }
    return run(app_view(people(spark, sf_dir)), {"type": "composite_people_filter", "params": params}).rows


@query("people_metrics", people_sql(
    "SELECT (SELECT count(*) FROM people_v) AS total_rows, count(c) AS total_matches, count(d) AS direct_count, count(a) AS adjacent_count, count(u) AS uncertain_count, cast(0 AS BIGINT) AS adjacent_included_count FROM q",
    *_judged(TECH),
))
def people_metrics(spark, sf_dir):
    return H.people_metrics(app_view(people(spark, sf_dir)), TECH_SPEC)


_TERMS = ["software", "data", "product manager", "cloud"]
_HITS = " + ".join(f"({has('t2', [t])} OR {has('e2', [t])})::INT" for t in _TERMS)


@query("candidate_metrics", people_sql(
    f"SELECT cast(sum(h) AS BIGINT) AS raw_match_count, count(*) FILTER (h > 0) AS candidate_count, count(*) FILTER (h > 0 AND NOT (counted OR (adjacent AND coalesce(person_id < c, true)) "
    "OR (uncertain AND coalesce(person_id < least(c, a0), true)))) AS non_match_count FROM "
    f"(SELECT j.*, p.c, p.a0, {_HITS} AS h FROM (SELECT *, {norm(chr(99) + 'oalesce(occupation, chr(32))')} AS t2, {norm('coalesce(employer, chr(32))')} AS e2 FROM j) j JOIN p USING (pk))",
    *(c.replace("(SELECT *, " + "CASE", "(SELECT * EXCLUDE (c), CASE", 1) if c.startswith("j AS") else c for c in _judged(TECH)),
))
def candidate_metrics(spark, sf_dir):
    return H.candidate_metrics(app_view(people(spark, sf_dir)), TECH_SPEC, _TERMS, ["occupation", "employer"])


EXACT = group("and", predicate("greater_than", "event_count", 4), predicate("email_domain_in", "email", "alpha.edu", "example.org"))
_DOMAINS = "list_filter({0}, lambda e: e LIKE '%@alpha.edu' OR e LIKE '%.alpha.edu' OR e LIKE '%@example.org')"
_EXACT_SQL = f"coalesce(event_count > 4, false) AND len({_DOMAINS.format(emails('email'))}) > 0"
_MATCHING = f"array_to_string({_DOMAINS.format(emails('email'))}, '; ') AS \"Matching Email\""


@query("composite_and", people_sql(f"SELECT bucket, {_DISPLAY}, {_MATCHING}, id AS _row_id FROM s JOIN people_v ON person_id = id WHERE {_EXACT_SQL}", *_judged(TECH)))
def composite_and(spark, sf_dir):
    return H.composite_filter(app_view(people(spark, sf_dir)), TECH_SPEC, EXACT, "and")


ORACLES["run_composite_sorted"] = ORACLES["run_composite_sorted"].replace("_MATCHING_", _MATCHING).replace("_EXACT_", _EXACT_SQL)


@query("composite_or", people_sql(
    f"SELECT bucket, {_DISPLAY}, {_MATCHING}, id AS _row_id FROM "
    "(SELECT bucket, id FROM s WHERE bucket IN ('counted', 'direct') UNION SELECT b, id FROM x, (VALUES ('counted'), ('direct')) t(b) "
    "UNION SELECT bucket, id FROM s WHERE bucket IN ('adjacent', 'uncertain') AND id NOT IN (SELECT id FROM x)) JOIN people_v ON person_id = id",
    *_judged(TECH), f"x AS (SELECT min(person_id) AS id FROM people_v WHERE {_EXACT_SQL} GROUP BY {PERSON})",
))
def composite_or(spark, sf_dir):
    return H.composite_filter(app_view(people(spark, sf_dir)), TECH_SPEC, EXACT, "or")


# ---- evaluation -----------------------------------------------------------------------------------------------------


@query("precision_recall", "WITH r AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), e AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0) "
       "SELECT (SELECT count(*) FROM r) AS returned, (SELECT count(*) FROM e) AS expected, count(*) AS \"both\", round(count(*) / (SELECT count(*) FROM r), 8) AS precision, round(count(*) / (SELECT count(*) FROM e), 8) AS recall FROM r JOIN e USING (doc_id)")
def precision_recall(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("name", F.concat(F.lit("Doc "), F.col("doc_id")))
    scored = X.precision_recall(labels.filter("quality = 1"), labels.filter("toxic = 0"), "name")
    return rounded(scored, 8, "precision", "recall")


_NAME = f"CASE WHEN NOT {blank('first_name')} AND NOT {blank('last_name')} THEN {norm('first_name || chr(32) || last_name')} END"


@query("result_diff", people_sql(
    "SELECT 'false_positive' AS kind, name FROM (SELECT name FROM r EXCEPT SELECT name FROM e) UNION ALL SELECT 'false_negative', name FROM (SELECT name FROM e EXCEPT SELECT name FROM r) "
    "UNION ALL SELECT 'unknown', name FROM (SELECT name FROM r EXCEPT SELECT name FROM k)",
    f"n AS (SELECT *, {_NAME} AS name FROM people_v)", "r AS (SELECT name FROM n WHERE event_count > 6 AND name IS NOT NULL)",
    "e AS (SELECT name FROM n WHERE event_count BETWEEN 5 AND 9 AND name IS NOT NULL)", "k AS (SELECT name FROM n WHERE grad_year < 2020 AND name IS NOT NULL)",
))
def result_diff(spark, sf_dir):
    df = people(spark, sf_dir)
    return X.result_diff(df.filter("event_count > 6"), df.filter("event_count between 5 and 9"), df.filter("grad_year < 2020"))


def _results_and_gold(spark, sf_dir):
    """Result rows with some employers and titles changed, so that every narrowing step is met."""
    df = people(spark, sf_dir)
    changed = df.withColumns(
        {
            "employer": F.when(F.col("person_id") % 5 == 0, "Elsewhere").otherwise(F.col("employer")),
            "occupation": F.when(F.col("person_id") % 7 == 0, "Other Role").otherwise(F.col("occupation")),
            "Matching Email": F.when(F.col("person_id") % 2 == 0, F.col("email")),
        }
    ).filter("event_count > 8")
    return changed.drop("email", "alt_email"), df


_GOLD_CTES = (
    f"g AS (SELECT person_id, {_NAME} AS name, {norm('coalesce(employer, chr(32))')} AS e, {norm('coalesce(occupation, chr(32))')} AS t, "
    f"list_transform(list_concat({emails('email')}, {emails('alt_email')}), lambda a: lower(a)) AS a FROM people_v)",
    "r0 AS (SELECT person_id, first_name, last_name, event_count, email, CASE WHEN person_id % 5 = 0 THEN 'Elsewhere' ELSE employer END AS employer, "
    "CASE WHEN person_id % 7 = 0 THEN 'Other Role' ELSE occupation END AS occupation FROM people_v WHERE event_count > 8)",
    f"r AS (SELECT DISTINCT name, e, t, a FROM (SELECT {_NAME} AS name, {norm('coalesce(employer, chr(32))')} AS e, {norm('coalesce(occupation, chr(32))')} AS t, "
    f"CASE WHEN person_id % 2 = 0 THEN list_sort(list_distinct(list_transform({emails('email')}, lambda a: lower(a)))) ELSE []::VARCHAR[] END AS a FROM r0) WHERE name IS NOT NULL)",
    "m1 AS (SELECT r.name, r.e, r.t, r.a, g.person_id, g.t AS gt, g.a AS ga, g.e = r.e AND r.e <> '' AS by_e FROM r JOIN g USING (name))",
    "m2 AS (SELECT *, gt = t AND t <> '' AS by_t FROM m1 QUALIFY by_e = max(by_e) OVER (PARTITION BY name, e, t, a))",
    "m3 AS (SELECT *, len(list_intersect(a, ga)) > 0 AS by_a FROM m2 QUALIFY by_t = max(by_t) OVER (PARTITION BY name, e, t, a))",
)


@query("match_gold", people_sql(
    "SELECT name, CASE WHEN bool_or(by_e) THEN e END AS match_employer, CASE WHEN bool_or(by_t) THEN t END AS match_title, bool_or(by_a) AS by_email, count(*) AS gold_rows FROM m3 GROUP BY name, e, t, a",
    *_GOLD_CTES,
))
def match_gold(spark, sf_dir):
    matched = X.match_gold(*_results_and_gold(spark, sf_dir))
    return matched.select(F.col("_name").alias("name"), "match_employer", "match_title", "by_email", "gold_rows")


@query("matched_gold", people_sql(
    "SELECT DISTINCT person_id FROM (SELECT person_id FROM m3 QUALIFY by_a = max(by_a) OVER (PARTITION BY name, e, t, a))", *_GOLD_CTES,
))
def matched_gold(spark, sf_dir):
    return X.matched_gold(*_results_and_gold(spark, sf_dir)).select("person_id")


# "and" leaves no problem; "or" adds only the first exact row of a person, so the others are missing, and takes rows out of buckets.
@query("check_composition", people_sql(
    "SELECT 'or' AS logic, bucket, id AS _row_id, 'missing' AS problem FROM (SELECT * FROM w EXCEPT SELECT * FROM seen) "
    "UNION ALL SELECT 'or', bucket, id, 'surplus' FROM (SELECT * FROM seen EXCEPT SELECT * FROM w)",
    *_judged(TECH), f"ex AS (SELECT person_id AS id FROM people_v WHERE {_EXACT_SQL})", f"x AS (SELECT min(person_id) AS id FROM people_v WHERE {_EXACT_SQL} GROUP BY {PERSON})",
    "w AS (SELECT bucket, id FROM s WHERE bucket <> 'counted' UNION SELECT b, id FROM ex, (VALUES ('direct'), ('adjacent'), ('uncertain')) t(b))",
    "seen AS (SELECT bucket, id FROM s WHERE bucket = 'direct' UNION SELECT 'direct', id FROM x UNION SELECT bucket, id FROM s WHERE bucket IN ('adjacent', 'uncertain') AND id NOT IN (SELECT id FROM x))",
))
def check_composition(spark, sf_dir):
    df = app_view(people(spark, sf_dir))
    # Results are compared as they were once written, each computed once.
    exact = saved(df.filter(compile_group(df, EXACT)).select("_row_id"), "exact")
    fuzzy = saved(H.people_filter(df, TECH_SPEC), "fuzzy")
    found = [
        X.check_composition(saved(H.composite_filter(df, TECH_SPEC, EXACT, logic), logic), fuzzy, exact, logic=logic).select(F.lit(logic).alias("logic"), "*")
        for logic in ("and", "or")
    ]
    return found[0].unionByName(found[1])


@query("bucket_overlap", people_sql(
    "SELECT name, count(DISTINCT state) AS bucket_count FROM (SELECT *, " + _NAME + " AS name FROM people_v) WHERE name IS NOT NULL AND state IN ('NY', 'CA', 'IL') GROUP BY 1 HAVING count(DISTINCT state) > 1"
))
def bucket_overlap(spark, sf_dir):
    df = people(spark, sf_dir).withColumn("bucket", F.col("state"))
    return X.bucket_overlap(df, buckets=("NY", "CA", "IL"))


def _cases(df):
    """One case per graduation year: how well "many events" finds the people with a manager."""
    hit, wanted = F.col("event_count") > 6, F.col("manager").isNotNull()
    counts = df.groupBy("grad_year").agg(
        F.count(F.when(hit & wanted, 1)).alias("b"), F.count(F.when(hit, 1)).alias("r"), F.count(F.when(wanted, 1)).alias("e"),
    )
    return counts.select(
        "grad_year", F.try_divide("b", "r").alias("precision"), F.try_divide("b", "e").alias("recall"),
        (F.col("b") * 2 >= F.col("e")).alias("passed"), (F.col("r") - F.col("b")).alias("unknown_names"),
        (F.col("grad_year") % 3).alias("total_model_calls"), F.when(F.col("grad_year") % 4 > 0, F.concat(F.lit("source "), F.col("grad_year") % 4)).alias("answer_source"),
    )


_CASES = (
    "k AS (SELECT grad_year, count(*) FILTER (event_count > 6 AND manager IS NOT NULL) AS b, count(*) FILTER (event_count > 6) AS r, count(*) FILTER (manager IS NOT NULL) AS e FROM people_v GROUP BY 1)"
)


@query("eval_report", people_sql(
    "SELECT count(*) AS total_cases, count(*) FILTER (b * 2 >= e) AS passed, count(*) FILTER (NOT b * 2 >= e) AS failed, round(count(*) FILTER (b * 2 >= e) / count(*), 4) AS pass_rate, "
    "round(avg(CASE WHEN r > 0 THEN b / r END), 4) AS average_precision, round(avg(CASE WHEN e > 0 THEN b / e END), 4) AS average_recall, cast(sum(r - b) AS BIGINT) AS total_unknown_names, "
    "cast(sum(coalesce(grad_year % 3, 0)) AS BIGINT) AS total_model_calls, count(*) FILTER (grad_year % 3 > 0) AS cases_with_model_calls, count(*) - count(*) FILTER (grad_year % 3 > 0) AS cases_without_model_calls FROM k",
    _CASES,
))
def eval_report(spark, sf_dir):
    return X.eval_report(_cases(people(spark, sf_dir)))


@query("report_breakdown", people_sql(
    "SELECT coalesce(CASE WHEN grad_year % 4 > 0 THEN 'source ' || (grad_year % 4) END, 'unknown') AS answer_source, count(*) AS cases FROM k GROUP BY 1", _CASES,
))
def report_breakdown(spark, sf_dir):
    return X.report_breakdown(_cases(people(spark, sf_dir)))


@query("expected_rows", people_sql("SELECT person_id FROM people_v WHERE expected_industry IN ('tech', 'banking')"))
def expected_rows(spark, sf_dir):
    return X.expected_rows(people(spark, sf_dir), industries=["Tech", "banking"]).select("person_id")
