"""Aggregation, profile, order and set queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from checks.registry import listed, query, rounded
from checks.sql import blank, lenient, moment
from checks.views import people, people_sql, table
from rollbook.operators import aggregate as A
from rollbook.operators import order as O
from rollbook.operators import profile as R
from rollbook.operators import sets
from rollbook.session import saved
from rollbook.sources.files import with_row_id


def keyed(spark, sf_dir, name, key):
    return with_row_id(table(spark, sf_dir, name), key=key, check=False)


@query("group_by_count", 'SELECT c_mktsegment, count(*) AS "Count" FROM customer GROUP BY 1')
def group_by_count(spark, sf_dir):
    return A.group_by_count(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("group_by_count_missing", people_sql(
    f"SELECT CASE WHEN {blank('manager')} THEN 'Missing' ELSE manager END AS manager, count(*) AS \"Count\" FROM people_v GROUP BY 1"
))
def group_by_count_missing(spark, sf_dir):
    return A.group_by_count(people(spark, sf_dir), "manager")


@query("group_by_sum", 'SELECT o_orderpriority, round(sum(o_totalprice), 2) AS "Sum o_totalprice" FROM orders GROUP BY 1')
def group_by_sum(spark, sf_dir):
    return rounded(A.group_by_sum(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), 2, "Sum o_totalprice")


@query("group_by_average", 'SELECT o_orderstatus, round(avg(o_totalprice), 4) AS "Average o_totalprice" FROM orders GROUP BY 1')
def group_by_average(spark, sf_dir):
    return rounded(A.group_by_average(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice"), 4, "Average o_totalprice")


@query("group_by_text_sum", people_sql(
    f"SELECT CASE WHEN {blank('state')} THEN 'Missing' ELSE state END AS state, round(sum({lenient('giving')}), 4) AS \"Sum giving\" FROM people_v WHERE {lenient('giving')} IS NOT NULL GROUP BY 1"
))
def group_by_text_sum(spark, sf_dir):
    return rounded(A.group_by_sum(people(spark, sf_dir), "state", "giving"), 4, "Sum giving")


for _op in ("min", "max"):

    @query(f"group_by_{_op}", f"SELECT l_returnflag, {_op}(l_extendedprice) AS value FROM lineitem GROUP BY 1")
    def group_by_extreme(spark, sf_dir, op=_op):
        return A.group_by_agg(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", op)


for _agg, _sql in (("count", "count(*)"), ("sum", "round(sum(o_totalprice), 2)"), ("average", "round(avg(o_totalprice), 4)")):
    _label = "Count" if _agg == "count" else f"{_agg.title()} o_totalprice"

    @query(
        f"group_by_month_{_agg}",
        f"SELECT strftime(o_orderdate, '%Y-%m') AS \"Month\", {_sql} AS \"{_label}\" FROM orders GROUP BY 1",
    )
    def group_by_month(spark, sf_dir, agg=_agg, label=_label):
        value = None if agg == "count" else "o_totalprice"
        return rounded(A.group_by_month(table(spark, sf_dir, "orders"), "o_orderdate", value, agg), 2 if agg == "sum" else 4, label)


@query("value_counts", 'SELECT l_shipdate::DATE::VARCHAR AS l_shipdate, count(*) AS "Count" FROM lineitem GROUP BY 1')
def value_counts(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))
    return A.value_counts(df, "l_shipdate")


@query("unique_values", 'SELECT p_brand, count(*) AS "Count", (SELECT count(DISTINCT p_brand) FROM part) AS unique_count FROM part GROUP BY 1')
def unique_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    distinct = A.unique_metrics(part, "p_brand").select("unique_count").scalar()
    return A.unique_values(part, "p_brand").withColumn("unique_count", distinct)


def _per_column(columns, select):
    return " UNION ALL ".join(select(c) for c in columns)


_GAPPY = ["first_name", "last_name", "email", "giving", "city", "manager", "linkedin_url"]


@query("missing_values", people_sql(_per_column(
    _GAPPY,
    lambda c: f"SELECT '{c}' AS \"Column\", count(*) FILTER ({blank(c)}) AS \"Missing Count\", round(count(*) FILTER ({blank(c)}) * 100.0 / count(*), 2) AS \"Missing %\" FROM people_v",
)))
def missing_values(spark, sf_dir):
    return R.missing_values(people(spark, sf_dir), _GAPPY)


def _sample(column, n, cast=""):
    return f"(SELECT string_agg(v, ', ' ORDER BY person_id) FROM (SELECT {column}{cast} AS v, person_id FROM people_v WHERE NOT {blank(column + '::VARCHAR')} ORDER BY person_id LIMIT {n}))"


def _summary_sql(column, kind, cast="", rest=""):
    absent = blank(column + "::VARCHAR")
    return (
        f"SELECT '{column}' AS \"Column\", '{kind}' AS \"Type\", count(*) FILTER (NOT {absent}) AS \"Non-null Count\", "
        f"count(*) FILTER ({absent}) AS \"Missing Count\", count(DISTINCT CASE WHEN NOT {absent} THEN {column} END) AS \"Unique Count\", "
        f"{_sample(column, 3, cast)} AS \"Sample Values\" FROM people_v"
    )


@query("column_summary", people_sql(" UNION ALL ".join([
    _summary_sql("city", "text"), _summary_sql("updated_at", "date"), _summary_sql("event_count", "number", "::VARCHAR"), _summary_sql("state", "text"),
])))
def column_summary(spark, sf_dir):
    return R.column_summary(people(spark, sf_dir), ["city", "updated_at", "event_count", "state"])


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("numeric_summary", _per_column(_MEASURES, lambda c:
    f"SELECT '{c}' AS \"Column\", count({c}) AS \"Count\", count(*) - count({c}) AS \"Missing\", round(sum({c}), 2) AS \"Sum\", round(avg({c}), 6) AS \"Mean\", "
    f"round(quantile_cont({c}, 0.5), 6) AS \"Median\", min({c}) AS \"Min\", max({c}) AS \"Max\", round(stddev_samp({c}), 6) AS \"Standard Deviation\" FROM lineitem"))
def numeric_summary(spark, sf_dir):
    df = R.numeric_summary(table(spark, sf_dir, "lineitem"), _MEASURES)
    return rounded(rounded(df, 2, "Sum"), 6, "Mean", "Median", "Standard Deviation")


@query("numeric_summary_text", people_sql(
    f"SELECT 'giving' AS \"Column\", count(v) AS \"Count\", count(*) - count(v) AS \"Missing\", round(sum(v), 4) AS \"Sum\", round(avg(v), 6) AS \"Mean\", "
    f"quantile_cont(v, 0.5) AS \"Median\", min(v) AS \"Min\", max(v) AS \"Max\", round(stddev_samp(v), 6) AS \"Standard Deviation\" FROM (SELECT {lenient('giving')} AS v FROM people_v)"
))
def numeric_summary_text(spark, sf_dir):
    return rounded(rounded(R.numeric_summary(people(spark, sf_dir), ["giving"]), 4, "Sum"), 6, "Mean", "Standard Deviation")


_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]]


@query("correlation", _per_column(_PAIRS, lambda p:
    f"SELECT '{p[0]}' AS \"Column 1\", '{p[1]}' AS \"Column 2\", round(corr({p[0]}, {p[1]}), 8) AS \"Correlation\", round(abs(corr({p[0]}, {p[1]})), 8) AS \"Absolute Correlation\" FROM lineitem"))
def correlation(spark, sf_dir):
    return rounded(A.correlation(table(spark, sf_dir, "lineitem"), _MEASURES), 8, "Correlation", "Absolute Correlation")


def _wide(j):
    """A column of 200: a third of them have gaps, and they lie at different heights."""
    value = f"cast((p_partkey * ({j} + 3)) % ({j} + 11) + p_size * ({j} % 5) + p_retailprice / ({j} + 1) + 1000 * ({j} % 3) as double)"
    return f"CASE WHEN {j} % 3 = 0 AND (p_partkey + {j}) % 7 = 0 THEN NULL ELSE {value} END"


@query("correlation_wide", f"WITH v AS (SELECT p_partkey AS k, j::INT AS j, {_wide('j')} AS v FROM part, range(200) t(j)) "
       "SELECT 'v' || a.j AS \"Column 1\", 'v' || b.j AS \"Column 2\", round(corr(a.v, b.v), 6) AS \"Correlation\", round(abs(corr(a.v, b.v)), 6) AS \"Absolute Correlation\" "
       "FROM v a JOIN v b ON a.k = b.k AND a.j < b.j WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.j, b.j")
def correlation_wide(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(*(F.expr(_wide(j)).alias(f"v{j}") for j in range(200)))
    return rounded(A.correlation(df), 6, "Correlation", "Absolute Correlation")


@query("correlation_pair", "SELECT round(corr(l_quantity, l_extendedprice), 8) AS r, count(*) AS n FROM lineitem")
def correlation_pair(spark, sf_dir):
    return rounded(A.correlation_pair(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), 8, "r")


def _dates_as_text(df, *columns):
    return df.withColumns({c: F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd") for c in columns})


@query("date_summary", "SELECT 'o_orderdate' AS \"Column\", strftime(min(o_orderdate), '%Y-%m-%d') AS \"Min Date\", strftime(max(o_orderdate), '%Y-%m-%d') AS \"Max Date\", "
       "cast(0 AS BIGINT) AS \"Missing Count\", count(o_orderdate) AS \"Parsed Count\" FROM orders")
def date_summary(spark, sf_dir):
    return _dates_as_text(R.date_summary(keyed(spark, sf_dir, "orders", "o_orderkey")), "Min Date", "Max Date")


@query("date_summary_text", people_sql(_per_column(["last_contact", "updated_at"], lambda c:
    f"SELECT '{c}' AS \"Column\", strftime(min({moment(c)}), '%Y-%m-%d') AS \"Min Date\", strftime(max({moment(c)}), '%Y-%m-%d') AS \"Max Date\", "
    f"count(*) FILTER ({blank(c)}) AS \"Missing Count\", count({moment(c)}) AS \"Parsed Count\" FROM people_v")))
def date_summary_text(spark, sf_dir):
    df = R.date_summary(people(spark, sf_dir), ["last_contact", "updated_at", "city"])
    return _dates_as_text(df, "Min Date", "Max Date")


@query("date_summary_late", "SELECT 'note' AS \"Column\", strftime(min(o_orderdate), '%Y-%m-%d') AS \"Min Date\", strftime(max(o_orderdate), '%Y-%m-%d') AS \"Max Date\", "
       "cast(0 AS BIGINT) AS \"Missing Count\", count(*) AS \"Parsed Count\" FROM orders WHERE o_orderkey > (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 1 OFFSET 15)")
def date_summary_late(spark, sf_dir):
    """Text whose first sixteen values are no dates."""
    df = keyed(spark, sf_dir, "orders", "o_orderkey")
    edge = df.orderBy("o_orderkey").limit(16).agg(F.max("o_orderkey")).scalar()
    late = df.select("_row_id", F.when(F.col("o_orderkey") <= edge, F.lit("none yet")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("note"))
    return _dates_as_text(R.date_summary(late), "Min Date", "Max Date")


@query("duplicate_count", "SELECT cast(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_linenumber, l_returnflag FROM lineitem)) AS BIGINT) AS duplicate_row_count FROM lineitem")
def duplicate_count(spark, sf_dir):
    return R.duplicate_count(table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_returnflag"))


_NUMERIC = ["l_quantity", "l_extendedprice", "l_linenumber"]


@query("describe_numeric", _per_column(_NUMERIC, lambda c:
    f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS \"min\", "
    f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS \"25%\", round(quantile_cont({c}::DOUBLE, 0.5), 6) AS \"50%\", round(quantile_cont({c}::DOUBLE, 0.75), 6) AS \"75%\", max({c})::DOUBLE AS \"max\" FROM lineitem"))
def describe_numeric(spark, sf_dir):
    df = R.describe_numeric(table(spark, sf_dir, "lineitem").select(*_NUMERIC))
    return rounded(df, 6, "mean", "std", "25%", "50%", "75%")


def _top_values(column):
    return (
        f"SELECT '{column}' AS \"column\", (SELECT count(DISTINCT {column}) FROM customer) AS unique_count, cast(0 AS BIGINT) AS missing_count, "
        f"row_number() OVER (ORDER BY n DESC, {column}) AS rank, {column} AS value, n AS \"count\" FROM "
        f"(SELECT {column}, count(*) AS n FROM customer GROUP BY 1)"
    )


@query("categorical_summary", " UNION ALL ".join(_top_values(c) for c in ("c_name", "c_mktsegment")))
def categorical_summary(spark, sf_dir):
    return R.categorical_summary(table(spark, sf_dir, "customer"))


@query("datetime_summary", "SELECT 'o_orderdate' AS \"column\", strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, "
       "cast(0 AS BIGINT) AS missing_count FROM orders")
def datetime_summary(spark, sf_dir):
    return _dates_as_text(R.datetime_summary(table(spark, sf_dir, "orders")), "earliest", "latest")


@query("table_summary", people_sql(_per_column([("person_id", "bigint"), ("email", "string"), ("manager", "string")], lambda c:
    f"SELECT '{c[0]}' AS \"column\", '{c[1]}' AS type, count(*) - count({c[0]}) AS missing_count, count(*) AS row_count, 3 AS column_count, "
    "cast(2 * count(*) - count(email) - count(manager) AS BIGINT) AS total_missing FROM people_v")))
def table_summary(spark, sf_dir):
    return R.table_summary(people(spark, sf_dir, row_id=False).select("person_id", "email", "manager"))


def _context(column, kind, low=True):
    present = f"{column}::VARCHAR IS NOT NULL AND trim({column}::VARCHAR) <> ''"
    values = (
        f"(SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT {column}::VARCHAR AS v, min(c_custkey) AS k FROM customer GROUP BY 1))"
        if low else "NULL"
    )
    return (
        f"SELECT '{column}' AS \"column\", '{kind}' AS type, count(*) FILTER (NOT ({present})) AS missing_count, count(DISTINCT {column}) AS unique_count, "
        f"(SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT {column}::VARCHAR AS v, c_custkey AS k FROM customer ORDER BY k LIMIT 5)) AS sample_values, {values} AS low_cardinality_values FROM customer"
    )


@query("dataset_context", " UNION ALL ".join([_context("c_custkey", "number", False), _context("c_name", "text", False), _context("c_mktsegment", "text"), _context("c_nationkey", "number", False)]))
def dataset_context(spark, sf_dir):
    df = keyed(spark, sf_dir, "customer", "c_custkey").drop("c_acctbal")
    return listed(R.dataset_context(df), "sample_values", "low_cardinality_values")


@query("column_profile_num", "SELECT count(l_tax) AS \"count\", round(avg(l_tax), 8) AS mean, round(quantile_cont(l_tax, 0.5), 8) AS median, min(l_tax) AS \"min\", max(l_tax) AS \"max\", "
       "round(sum(l_tax), 4) AS sum, round(stddev_pop(l_tax), 8) AS sd FROM lineitem")
def column_profile_num(spark, sf_dir):
    df = R.column_profile(table(spark, sf_dir, "lineitem"), "l_tax")
    return rounded(rounded(df, 4, "sum"), 8, "mean", "median", "sd")


@query("column_profile_cat", "SELECT l_returnflag AS value, count(*) AS \"count\", (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS \"unique\" FROM lineitem GROUP BY 1")
def column_profile_cat(spark, sf_dir):
    return R.column_profile(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("dataset_overview", people_sql(
    "SELECT count(*) AS row_count, 4 AS column_count, (SELECT string_agg(row, '|' ORDER BY person_id) FROM (SELECT person_id, json_object('person_id', person_id, 'first_name', first_name, 'email', email, 'grad_year', grad_year)::VARCHAR AS row "
    "FROM people_v ORDER BY person_id LIMIT 5)) AS sample_rows, 'confirmed' AS mapping_status, '{\"first_name\":[\"first_name\"],\"email\":[\"email\"]}' AS mapping FROM people_v"
))
def dataset_overview(spark, sf_dir):
    df = people(spark, sf_dir).select("person_id", "first_name", "email", "grad_year", "_row_id")
    found = R.dataset_overview(df, mapping={"first_name": ["first_name"], "email": ["email"]}, status="confirmed")
    return found.withColumns({"sample_rows": F.array_join("sample_rows", "|"), "mapping": F.to_json("mapping")})


@query("column_profile_date", "SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, count(*) AS \"count\" FROM orders")
def column_profile_date(spark, sf_dir):
    return _dates_as_text(R.column_profile(table(spark, sf_dir, "orders"), "o_orderdate"), "earliest", "latest")


def _flags(column, type_sql, currency="false", year="false"):
    return (
        f"SELECT '{column}' AS \"column\", {type_sql} AS type, {currency} AS currency, {year} AS year, count(*) FILTER ({blank(column + '::VARCHAR')}) AS missing, "
        f"count(*) FILTER (NOT {blank(column + '::VARCHAR')}) AS non_empty, (SELECT cast(count(*) FILTER ({blank('giving')}) + count(*) FILTER ({blank('city')}) + "
        f"count(*) FILTER ({blank('updated_at')}) + count(*) - count(grad_year) AS BIGINT) FROM people_v) AS total_missing FROM people_v"
    )


@query("profile_flags", people_sql(" UNION ALL ".join([
    _flags("giving", f"CASE WHEN count(*) FILTER (regexp_matches(trim(giving), '^-?\\$?\\s*-?[\\d,]*\\.?\\d+%?$')) >= 0.85 * count(*) FILTER (NOT {blank('giving')}) THEN 'num' ELSE 'text' END"),
    _flags("city", "'text'"), _flags("updated_at", "'date'"), _flags("grad_year", "'num'", year="true"),
])))
def profile_flags(spark, sf_dir):
    return R.profile_flags(people(spark, sf_dir, row_id=False).select("giving", "city", "updated_at", "grad_year"))


def _placed(df):
    """The place of each row in a sorted table: rows in earlier partitions, and before it in its own."""
    at = df.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    at = saved(at, "sorted")  # the sort runs once
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # one row a partition
    return at.join(F.broadcast(before), "_part").withColumn("place", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


@query("sort_rows", "SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS place FROM customer")
def sort_rows(spark, sf_dir):
    return O.sort_rows(keyed(spark, sf_dir, "customer", "c_custkey"), "c_acctbal").drop("_row_id").transform(_placed)


@query("sort_rows_text", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name) DESC, p_partkey) - 1 AS place FROM part")
def sort_rows_text(spark, sf_dir):
    return O.sort_rows(keyed(spark, sf_dir, "part", "p_partkey"), "p_name", ascending=False).select("p_partkey", "p_name").transform(_placed)


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark, sf_dir):
    return O.top_n(keyed(spark, sf_dir, "orders", "o_orderkey"), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("bottom_n", people_sql(f"SELECT person_id, giving FROM people_v ORDER BY {lenient('giving')} ASC NULLS LAST, person_id LIMIT 10"))
def bottom_n(spark, sf_dir):
    return O.bottom_n(people(spark, sf_dir), "giving").select("person_id", "giving")


@query("top_rows", "SELECT p_partkey, p_name FROM part ORDER BY lower(p_name) DESC, p_partkey LIMIT 10")
def top_rows(spark, sf_dir):
    return O.top_rows(keyed(spark, sf_dir, "part", "p_partkey"), "p_name").select("p_partkey", "p_name")


@query("duplicate_rows", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderstatus) > 1")
def duplicate_rows(spark, sf_dir):
    rows = O.duplicate_rows(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], limit=None)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("duplicate_rows_dotted", "SELECT o_orderkey, o_custkey AS \"No. of customer\" FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def duplicate_rows_dotted(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("No. of customer"))
    return O.duplicate_rows(df, ["No. of customer"])


@query("duplicate_metrics", "SELECT cast(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_row_count, cast(sum(n) AS BIGINT) AS total_rows FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)")
def duplicate_metrics(spark, sf_dir):
    return O.duplicate_metrics(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


_EVENTFUL = "coalesce(event_count > 6, false)"


def _two_results(spark, sf_dir):
    df = people(spark, sf_dir)
    return df.filter("event_count > 6"), df.filter("state in ('NY', 'CA')")


@query("intersect_rows", people_sql(f"SELECT person_id FROM people_v WHERE {_EVENTFUL} AND state IN ('NY', 'CA')"))
def intersect_rows(spark, sf_dir):
    return sets.intersect_rows(*_two_results(spark, sf_dir)).select("person_id")


@query("except_rows", people_sql(f"SELECT person_id FROM people_v WHERE {_EVENTFUL} AND coalesce(state NOT IN ('NY', 'CA'), true)"))
def except_rows(spark, sf_dir):
    return sets.except_rows(*_two_results(spark, sf_dir)).select("person_id")


@query("union_rows", people_sql(f"SELECT person_id, CASE WHEN {_EVENTFUL} THEN 'first' ELSE 'second' END AS part FROM people_v WHERE {_EVENTFUL} OR coalesce(state IN ('NY', 'CA'), false)"))
def union_rows(spark, sf_dir):
    a, b = _two_results(spark, sf_dir)
    return sets.union_rows(a.withColumn("part", F.lit("first")), b.withColumn("part", F.lit("second"))).select("person_id", "part")
