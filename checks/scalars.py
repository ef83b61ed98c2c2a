"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import listed, query, rounded
from checks.sql import compact, day, emails, has, lenient, member, moment, norm, strict
from checks.views import events, events_sql, people, people_sql, table
from rollbook.functions import dates, display, free_dates, numbers, text
from rollbook.functions import emails as E
from rollbook.functions.missing import type_of
from rollbook.operators.sampling import col


def _applied(df, key, functions):
    """key and one output column per (alias, column, function)."""
    return df.select(key, *(f(col(c), type_of(df, c)).alias(a) for a, c, f in functions))


@query("lenient_number", people_sql(f"SELECT person_id, {lenient('giving')} AS n, event_count::DOUBLE AS e FROM people_v"))
def lenient_number(spark, sf_dir):
    return _applied(people(spark, sf_dir), "person_id", [("n", "giving", numbers.lenient_number), ("e", "event_count", numbers.lenient_number)])


@query("lenient_number_events", events_sql("SELECT event_id, CASE WHEN value_text <> 'n/a' THEN replace(value_text, '$', '')::DOUBLE END AS t, CASE WHEN NOT isnan(value) THEN value END AS v FROM events_v"))
def lenient_number_events(spark, sf_dir):
    return _applied(events(spark, sf_dir), "event_id", [("t", "value_text", numbers.lenient_number), ("v", "value", numbers.lenient_number)])


@query("strict_number", people_sql(f"SELECT person_id, {strict('giving')} AS n FROM people_v"))
def strict_number(spark, sf_dir):
    return _applied(people(spark, sf_dir), "person_id", [("n", "giving", numbers.strict_number)])


@query("lenient_date", events_sql(f"SELECT event_id, strftime({moment('ts_text')}, '%Y-%m-%d %H:%M:%S') AS d FROM events_v"))
def lenient_date(spark, sf_dir):
    parsed = _applied(events(spark, sf_dir), "event_id", [("d", "ts_text", dates.lenient_moment)])
    return parsed.withColumn("d", F.date_format("d", "yyyy-MM-dd HH:mm:ss"))


@query("strict_date", people_sql(
    f"SELECT person_id, {day('last_contact')}::VARCHAR AS contact, {day('updated_at')}::VARCHAR AS updated, make_date(grad_year, 1, 1)::VARCHAR AS year, "
    "(DATE '1899-12-30' + cast(45000 + person_id AS INT))::VARCHAR AS serial FROM people_v"
))
def strict_date(spark, sf_dir):
    df = people(spark, sf_dir).withColumn("serial", F.expr("45000 + person_id"))
    sources = [("contact", "last_contact"), ("updated", "updated_at"), ("year", "grad_year"), ("serial", "serial")]
    parsed = _applied(df, "person_id", [(a, c, dates.strict_date) for a, c in sources])
    return parsed.withColumns({a: F.date_format(a, "yyyy-MM-dd") for a, _ in sources})


#: Texts in free form and the dates they say; texts that say none.
FREE_DATES = (
    ("2nd January 2025", "2025-01-02"), ("Thu, Jan 2 2025 10:30 PM", "2025-01-02"), ("2025.01.02", "2025-01-02"), ("02-Jan-2025", "2025-01-02"),
    ("Jan-02-2025", "2025-01-02"), ("the 3rd of March, 1999", "1999-03-03"), ("25/12/2024", "2024-12-25"), ("12.25.2024", "2024-12-25"),
    ("Sept. 9 '98", "1998-09-09"), ("2 Feb 07", "2007-02-02"), ("2024-02-29T23:59:59+02:00", "2024-02-29"), ("February 2024", "2024-02-01"),
    ("Monday 30 December 2024 at 9am", "2024-12-30"), ("10:30 2025-01-02", "2025-01-02"), ("March 5, 2024", "2024-03-05"), ("29 Feb 2023", None),
    ("2025-13-40", None), ("soon", None), ("Jan 2", None), ("12 monkeys 1995", None), ("", None), (None, None), ("Feb Mar 2024", None), ("1 2 3 4", None),
)
_FREE_LIST = ", ".join("NULL" if t is None else "'" + t.replace("'", "''") + "'" for t, _ in FREE_DATES)
_SAID_LIST = ", ".join("NULL" if d is None else f"'{d}'" for _, d in FREE_DATES)


@query("strict_date_free", f"SELECT o_orderkey, list_extract([{_FREE_LIST}], o_orderkey % {len(FREE_DATES)} + 1) AS said, list_extract([{_SAID_LIST}], o_orderkey % {len(FREE_DATES)} + 1) AS day FROM orders")
def strict_date_free(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(t).cast("string") for t, _ in FREE_DATES)), (F.col("o_orderkey") % len(FREE_DATES)).cast("int") + 1)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    return rows.withColumn("day", F.date_format(free_dates.strict_date_free(F.col("said"), rows.schema["said"].dataType), "yyyy-MM-dd"))


@query("norm_text", people_sql(f"SELECT person_id, {norm('employer')} AS n FROM people_v"))
def norm_text(spark, sf_dir):
    return people(spark, sf_dir).select("person_id", text.norm_text(F.col("employer")).alias("n"))


@query("norm_compact", people_sql(f"SELECT person_id, {compact('last_name')} AS n FROM people_v"))
def norm_compact(spark, sf_dir):
    return people(spark, sf_dir).select("person_id", text.norm_compact(F.col("last_name")).alias("n"))


@query("norm_title", people_sql(f"SELECT person_id, {norm('occupation', 'a-z0-9&')} AS n, {norm('employer', 'a-z0-9&')} AS e FROM people_v"))
def norm_title(spark, sf_dir):
    return people(spark, sf_dir).select("person_id", text.norm_title(F.col("occupation")).alias("n"), text.norm_title(F.col("employer")).alias("e"))


_COMPANY = "trim(regexp_replace(regexp_replace(replace(trim(regexp_replace(regexp_replace(lower({0}), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), 'capitol one', 'capital one'), '\\b(?:inc|llc|ltd|corp|co|company)\\b', ' ', 'g'), ' +', ' ', 'g'))"


@query("norm_company", people_sql(f"SELECT person_id, {_COMPANY.format('employer')} AS n FROM people_v"))
def norm_company(spark, sf_dir):
    return people(spark, sf_dir).select("person_id", text.norm_company(F.col("employer")).alias("n"))


@query("norm_member", people_sql(f"SELECT person_id, CASE WHEN {member('city')} NOT IN ('nan', 'none') THEN {member('city')} END AS c, CASE WHEN {member('manager')} NOT IN ('nan', 'none') THEN {member('manager')} END AS m FROM people_v"))
def norm_member(spark, sf_dir):
    return people(spark, sf_dir).select("person_id", text.norm_member(F.col("city")).alias("c"), text.norm_member(F.col("manager")).alias("m"))


_ROLES = ["data scientist", "analyst", "software engineer", "manager"]


@query("has_term", people_sql(
    f"SELECT person_id, {has('t', _ROLES)} AS found, CASE WHEN {has('t', ['data scientist'])} THEN 'data scientist' WHEN {has('t', ['analyst'])} THEN 'analyst' "
    f"WHEN {has('t', ['software engineer'])} THEN 'software engineer' WHEN {has('t', ['manager'])} THEN 'manager' END AS term FROM t",
    f"t AS (SELECT person_id, {norm('occupation', 'a-z0-9&')} AS t FROM people_v)",
))
def has_term(spark, sf_dir):
    folded = people(spark, sf_dir).select("person_id", text.norm_title(F.col("occupation")).alias("t"))
    return folded.select("person_id", text.has_term(F.col("t"), _ROLES).alias("found"), text.first_term(F.col("t"), _ROLES).alias("term"))


@query("company_match", people_sql(f"SELECT person_id, employer FROM people_v WHERE regexp_matches({_COMPANY.format('employer')}, '\\b(?:capital one|google|mckinsey)\\b')"))
def company_match(spark, sf_dir):
    df = people(spark, sf_dir)
    return df.filter(text.company_match(text.norm_company(F.col("employer")), ["Capital One Inc.", "Google LLC", "McKinsey & Company"])).select("person_id", "employer")


@query("extract_emails", people_sql(f"SELECT person_id, array_to_string({emails('email')}, '|') AS found FROM people_v"))
def extract_emails(spark, sf_dir):
    return listed(people(spark, sf_dir).select("person_id", E.extract_emails(F.col("email")).alias("found")), "found")


@query("domain_matches", people_sql(
    "SELECT person_id, d = 'alpha.edu' OR d LIKE '%.alpha.edu' AS sub, d = 'alpha.edu' AS exact FROM d",
    f"d AS (SELECT person_id, coalesce(split_part({emails('email')}[1], '@', 2), '') AS d FROM people_v)",
))
def domain_matches(spark, sf_dir):
    df = people(spark, sf_dir).select("person_id", F.get(E.email_tokens(F.col("email")), F.lit(0))["domain"].alias("d"))
    return df.select(
        "person_id", E.domain_matches(F.col("d"), ["@Alpha.edu."]).alias("sub"),
        E.domain_matches(F.col("d"), ["alpha.edu"], include_subdomains=False).alias("exact"),
    )


@query("matching_emails", people_sql(
    f"SELECT person_id, array_to_string(list_filter({emails('email')}, lambda e: e LIKE '%@example.org'), '; ') AS inside, "
    f"array_to_string(list_filter({emails('email')}, lambda e: e NOT LIKE '%@example.org'), '; ') AS outside FROM people_v"
))
def matching_emails(spark, sf_dir):
    df = people(spark, sf_dir).withColumn("t", E.email_tokens(F.col("email")))
    return df.select(
        "person_id", F.array_join(E.matching_emails(F.col("t"), ["example.org"]), "; ").alias("inside"),
        F.array_join(E.matching_emails(F.col("t"), ["example.org"], quantifier="none"), "; ").alias("outside"),
    )


@query("mask_emails", people_sql(
    "SELECT person_id, CASE WHEN email LIKE '.%' THEN email ELSE regexp_replace(replace(replace(email, 'ALPHA', 'alpha'), 'Mail', 'mail'), '([A-Za-z])[A-Za-z]*@', '\\1***@', 'g') END AS masked "
    "FROM people_v"
))
def mask_emails(spark, sf_dir):
    return people(spark, sf_dir).select("person_id", E.mask_emails(F.col("email")).alias("masked"))


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>\\n]*>', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"


@query("clean_text", f"SELECT page_id, md5({_CLEAN}) AS digest, length({_CLEAN}) AS n FROM pages")
def clean_text(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html"), max_length=None).alias("t"))
    return df.select("page_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


@query("clean_text_capped", f"SELECT page_id, CASE WHEN length({_CLEAN}) > 200 THEN rtrim(substr({_CLEAN}, 1, 199)) || '...' ELSE {_CLEAN} END AS t FROM pages")
def clean_text_capped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html"), max_length=200).alias("t"))


# A third of the amounts is whole.
_AMOUNTS = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN round(c_acctbal) ELSE c_acctbal END AS c_acctbal FROM customer"


@query("format_value", "SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN format('{:,}', c_acctbal::BIGINT) ELSE format('{:,.2f}', c_acctbal) END AS amount, format('{:,}', c_custkey * 1000) AS big, "
       "CASE WHEN abs(c_acctbal * 1000) >= 1e6 THEN '$' || format('{:.1f}', c_acctbal * 1000 / 1e6) || 'M' WHEN abs(c_acctbal * 1000) >= 1e5 THEN '$' || format('{:.1f}', c_acctbal * 1000 / 1e3) || 'K' "
       "ELSE '$' || format('{:,}', round(c_acctbal * 1000)::BIGINT) END AS short FROM c".replace("SELECT", f"WITH c AS ({_AMOUNTS}) SELECT", 1))
def format_value(spark, sf_dir):
    df = table(spark, sf_dir, "customer").selectExpr("c_custkey", "if(c_custkey % 3 = 0, round(c_acctbal), c_acctbal) as c_acctbal")
    return df.select(
        "c_custkey", display.format_value(F.col("c_acctbal")).alias("amount"),
        display.format_value(F.col("c_custkey") * 1000).alias("big"),
        display.format_compact(F.col("c_acctbal") * 1000, currency=True).alias("short"),
    )


@query("full_name", people_sql("SELECT person_id, CASE WHEN trim(first_name) <> '' AND last_name IS NOT NULL THEN trim(first_name) || ' ' || trim(last_name) ELSE coalesce(manager_name, '') END AS name FROM p",
       "p AS (SELECT *, CASE WHEN lower(trim(manager)) NOT IN ('', 'nan', 'none', 'null') THEN trim(manager) END AS manager_name FROM people_v)"))
def full_name(spark, sf_dir):
    return people(spark, sf_dir).select("person_id", text.full_name(F.col("first_name"), F.col("last_name"), F.col("manager")).alias("name"))


# ---- the same functions over real texts -------------------------------------------------------------------------------

@query("norm_text_documents", f"SELECT doc_id, md5({norm('text')}) AS n, md5({compact('text')}) AS c FROM documents")
def norm_text_documents(spark, sf_dir):
    folded = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.norm_text(folded)).alias("n"), F.md5(text.norm_compact(folded)).alias("c"))


@query("has_term_documents", "SELECT doc_id, " + has("t", ["license", "that the"]) + " AS found FROM (SELECT doc_id, " + norm("text", "a-z0-9&") + " AS t FROM documents)")
def has_term_documents(spark, sf_dir):
    folded = table(spark, sf_dir, "documents").select("doc_id", text.norm_title(F.col("text")).alias("t"))
    return folded.select("doc_id", text.has_term(F.col("t"), ["license", "that the"]).alias("found"))


@query("extract_emails_documents", 
       f"SELECT doc_id, array_to_string(list_filter(m, lambda v, i: list_position(m, v) = i), '|') AS found FROM (SELECT doc_id, {emails('text')} AS m FROM documents)")
def extract_emails_documents(spark, sf_dir):
    return listed(table(spark, sf_dir, "documents").select("doc_id", E.extract_emails(F.col("text")).alias("found")), "found")


@query("clean_text_conversations", "SELECT conv_id, turn, md5(" + _CLEAN.replace("html", "text") + ") AS digest FROM conversations")
def clean_text_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.clean_text(F.col("text"))).alias("digest"))
