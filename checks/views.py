"""Two views with gaps and malformed cells, defined once for both engines.

The given tables have no nulls, so each view picks its cells from short literal arrays by the table's key. One text gives
the Spark select list and the SQL of the same view; only the array syntax differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollbook.sources.files import with_row_id

FIRST = ["Ada", "Ben", "Chidi", "Dana", "Eve", "Femi", "Grace", "Hugo", "Ines", "José", "Kai", "Lena", "  "]
LAST = [
    "Abbott", "Baker", "Cho", "Diaz", "Ekwueme", "Fox", "Gupta", "Haas", "Ito", "Jones", "Khan", "Lopez", "Mori",
    "Nwosu", "O-Brien", "Park", None,
]

# Occupation, employer, employer description and gold label of one job.
JOBS = [
    ("Software Engineer", "Northwind Software", None, "tech"),
    ("Senior Data Scientist", "General Hospital", "hospital", "tech"),
    ("Product Manager", "Orbit Cloud Inc", None, "tech"),
    ("Marketing Manager", "Orbit Cloud Inc", None, "marketing"),
    ("Investment Banking Analyst", "Goldman Sachs", None, "investment_banking"),
    ("Analyst", "Goldman Sachs", None, "investment_banking"),
    ("Wealth Management Associate", "First Harbor Bank", "bank", "banking"),
    ("Credit Analyst", "First Harbor Bank", None, "banking"),
    ("", "First Harbor Bank", None, "banking"),
    ("Portfolio Manager", "Tall Pine Capital", None, "finance"),
    ("Risk Analyst", "Summit Insurance", None, "finance"),
    ("Management Consultant", "McKinsey & Company", None, "consulting"),
    ("Senior Associate", "Deloitte Consulting LLP", None, "consulting"),
    ("Transaction Advisory Manager", "Ernst & Young", None, "consulting"),
    ("Financial Advisory Analyst", "Tall Pine Capital", None, None),
    ("Chief of Staff", "Blue Door Foods", None, None),
    ("Attorney", "Smith & Cole Law Firm", None, "law"),
    ("Law Clerk", "Department of Justice", None, "government_legal"),
    ("Policy Analyst", "City of Springfield", None, "government_legal"),
    ("Teacher", "Springfield High School", None, "education"),
    ("Professor", "State University", None, "education"),
    ("Registered Nurse", "General Hospital", None, "healthcare"),
    ("Operations Manager", "Swift Logistics", None, "operations"),
    ("Supply Chain Analyst", "Blue Door Foods", None, "operations"),
    ("Clinical Operations Lead", "General Hospital", None, None),
    ("Head of Growth", "Northwind Software", None, None),
    ("Brand Strategist", "Ogilvy", None, "marketing"),
    ("Editor", "Daily Planet News", "publishing house", "media"),
    ("Founder", "Pepper Labs", "stealth startup", "startups"),
    ("Partner", "Redwood Ventures", None, "venture_capital"),
    ("Director", "Open Hands Foundation", None, "nonprofit"),
    ("Advisor", "Blue Door Foods", None, None),
    ("Clinical Data Analyst", "General Hospital", None, None),
    ("Database Administrator", "Capitol One", None, "tech"),
    ("Marketplace Operations Analyst", "Uber", None, None),
    ("Product Operations Manager", "Google (YouTube)", None, None),
    ("Consultant", None, None, "consulting"),
    (None, "Accenture", None, "consulting"),
    (None, None, None, None),
    ("  ", "Pepper Labs", "software platform", None),
    ("Strategy Consultant / Advisor", "Acme Partners", None, "consulting"),
]

EMAIL = [
    "ada@alpha.edu", "Ben@Mail.ALPHA.edu; ben@example.org", "Dana Fox <dana@example.org>, dana@beta.com", "", None,
    "not an address", "eve@notalpha.edu", "x@alpha.edu.evil.com", "ines@beta.com|ines@sub.beta.com", ".bad@alpha.edu", "n/a",
]
ALT_EMAIL = ["me@example.org", None, "ada@alpha.edu", " ", "team@sub.alpha.edu", "none", "who@gamma.net"]
GIVING = ["$5,000", "5,001", "(250)", "12.5%", "N/A", " ", None, "$10,000.50", "1e3", "0", "-75", "about 12", "7500", "$ 42", "100000"]
LAST_CONTACT = [
    "2024-05-17", "2025-01-02", "3/9/2023", "March 5, 2024", "Jan 2 2025", "7/4/22", "", "bad date", None, "2021/11/30",
    "12-31-2024", "Feb 2023", "2020",
]
UPDATED_AT = ["2024-01-05", "2024-02-29", "2023-12-31", "2024-06-01", "2024-07-15", None, "2022-10-10", "2025-03-03"]
CITY = ["New  York", "boston", " Boston ", "San Francisco", None, "Los Angeles", "BOSTON", "Chicago", "nan"]
STATE = ["NY", "ma", "MA ", "CA", None, "IL", "ny"]
MANAGER = ["J. Rivera", None, "", "Sam  Lee", "none", "sam lee", "P. Okafor", "J. Rivera", None, "Q. Zhang", "  "]
LINK = ["https://linkedin.com/in/p", "http://www.linkedin.com/in/q", "", "https://LinkedIn.com/in/r", "https://linkedin.com/in/s"]
CONTACT_FLAG = ["yes", "no", "y", "n", "1", "0"]


def _literal(value):
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _picker(spark):
    def pick(index, values):
        cells = ", ".join(map(_literal, values))
        if spark:
            return f"element_at(array({cells}), cast(({index}) % {len(values)} as int) + 1)"
        return f"list_extract([{cells}], ({index}) % {len(values)} + 1)"

    return pick


def _people_columns(spark):
    pick = _picker(spark)
    k = "c_custkey"
    div, text = ("div", "STRING") if spark else ("//", "VARCHAR")
    # Every fourth row repeats the name before it under another job; a third of all rows belong to one person.
    named = f"({k} - CASE WHEN {k} % 4 = 3 THEN 1 ELSE 0 END)"
    hot = f"{k} % 3 = 0"
    job = f"CASE WHEN {k} % 2 = 0 THEN {k} % {len(JOBS)} ELSE ({k} % 37) END"
    titles, employers, descriptors, labels = ([job_row[i] for job_row in JOBS] for i in range(4))
    return {
        "person_id": k,
        "first_name": f"CASE WHEN {hot} THEN 'Robin' ELSE {pick(named, FIRST)} END",
        "last_name": f"CASE WHEN {hot} THEN 'Hale' ELSE {pick(named, LAST)} || ' ' || cast({named} {div} 221 AS {text}) END",
        "occupation": pick(k, titles),
        "employer": pick(job, employers),
        "employer_description": pick(job, descriptors),
        "email": pick(k, EMAIL),
        "alt_email": pick(k, ALT_EMAIL),
        "giving": pick(k, GIVING),
        "event_count": f"CASE WHEN {k} % 19 = 18 THEN NULL ELSE {k} % 13 END",
        "grad_year": f"CASE WHEN {k} % 23 = 22 THEN NULL ELSE 1990 + {k} % 37 END",
        "last_contact": pick(k, LAST_CONTACT),
        "updated_at": pick(k, UPDATED_AT),
        "city": pick(k, CITY),
        "state": pick(k, STATE),
        "manager": pick(k, MANAGER),
        "linkedin_url": pick(k, LINK),
        "do_not_contact": pick(k, CONTACT_FLAG),
        "expected_industry": f"CASE WHEN {k} % 2 = 0 THEN {pick(k, labels)} ELSE 'other' END",
    }


def _events_columns(spark):
    pick = _picker(spark)
    k = "event_id"
    if spark:
        stamp = {"iso": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "day": "date_format(ts, 'yyyy-MM-dd')", "us": "date_format(ts, 'MM/dd/yyyy')"}
        nan, inf = "double('NaN')", "double('Infinity')"
        # DuckDB rounds the product with 100; Spark's own cast rounds the shortest decimal text, which differs near ties (644.675).
        price = "cast(cast(cast(round(value * 100) AS DECIMAL(12,0)) / 100 AS DECIMAL(12,2)) AS STRING)"
    else:
        stamp = {"iso": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "day": "strftime(ts, '%Y-%m-%d')", "us": "strftime(ts, '%m/%d/%Y')"}
        nan, inf, price = "'NaN'::DOUBLE", "'Infinity'::DOUBLE", "cast(cast(value AS DECIMAL(12,2)) AS VARCHAR)"
    return {
        "event_id": k,
        "ts": "ts",
        "ts_text": f"CASE {k} % 5 WHEN 0 THEN {stamp['iso']} WHEN 1 THEN {stamp['day']} WHEN 2 THEN {stamp['us']} "
        f"WHEN 3 THEN {stamp['day']} ELSE {pick(k, ['', 'soon', None])} END",
        "user_id": "user_id",
        "event_type": f"CASE WHEN {k} % 17 = 16 THEN ' ' ELSE event_type END",
        "value": f"CASE WHEN {k} % 29 = 28 THEN NULL WHEN {k} % 31 = 30 THEN {nan} WHEN {k} % 37 = 36 THEN {inf} ELSE value END",
        "value_text": f"CASE WHEN {k} % 13 = 12 THEN 'n/a' ELSE '$' || {price} END",
    }


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark, sf_dir, name, columns):
    return table(spark, sf_dir, name).select(*(F.expr(e).alias(c) for c, e in columns.items()))


# The keys of the given tables are unique; row_id and the tests have the check.
def people(spark, sf_dir, row_id=True):
    df = _view(spark, sf_dir, "customer", _people_columns(True))
    return with_row_id(df, key="person_id", check=False) if row_id else df


def events(spark, sf_dir, row_id=True):
    df = _view(spark, sf_dir, "events", _events_columns(True))
    return with_row_id(df, key="event_id", check=False) if row_id else df


def _cte(name, source, columns):
    listed = ", ".join(f"{expr} AS {column}" for column, expr in columns.items())
    return f"{name} AS (SELECT {listed} FROM {source})"


PEOPLE_CTE = _cte("people_v", "customer", _people_columns(False))
EVENTS_CTE = _cte("events_v", "events", _events_columns(False))


def people_sql(body, *ctes):
    return "WITH " + ", ".join((PEOPLE_CTE, *ctes)) + " " + body


def events_sql(body, *ctes):
    return "WITH " + ", ".join((EVENTS_CTE, *ctes)) + " " + body
