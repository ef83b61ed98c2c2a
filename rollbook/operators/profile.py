"""Profiles of tables and columns: one wide aggregation, then one output row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from rollbook.functions.dates import is_moment_type, lenient_moment
from rollbook.functions.missing import as_text, is_blank, is_null, is_text, strip, type_of
from rollbook.functions.numbers import lenient_number
from rollbook.operators.aggregate import numeric_candidates, number_of, value_counts
from rollbook.operators.columns import resolve_column, resolve_columns
from rollbook.operators.ranks import ranked
from rollbook.operators.quantiles import FEW_ROWS, quantile_columns
from rollbook.operators.sampling import col, data_columns, distinct_values, first_values, leading
from rollbook.sources.files import ROW_ID
from rollbook.sources.inference import PARSE_SHARE, decided_type, type_counters

LOW_CARDINALITY = 20


def _chosen(df, columns):
    return resolve_columns(df.columns, columns) or data_columns(df)


def _missing(df, name, test=is_blank):
    return F.count(F.when(test(col(name), type_of(df, name)), 1))


def _per_column(summary, columns, fields):
    """One row per column out of a one-row summary; fields(i, name) gives the struct members."""
    rows = F.array(*(F.struct(*fields(i, name)) for i, name in enumerate(columns)))
    return summary.select(F.inline(rows))


def missing_values(df, columns=None):
    """Blank cells and their percentage per column, most first."""
    names = _chosen(df, columns)
    summary = df.agg(F.count(F.lit(1)).alias("total"), *(_missing(df, n).alias(f"m{i}") for i, n in enumerate(names)))

    def fields(i, name):
        share = F.coalesce(F.round(F.try_divide(F.col(f"m{i}") * 100.0, F.col("total")), 2), F.lit(0.0))
        return F.lit(name).alias("Column"), F.col(f"m{i}").alias("Missing Count"), share.alias("Missing %")

    return _per_column(summary, names, fields).orderBy(F.desc("Missing Count"))


def _in_order(rows):
    """Per column the values in row order, as one array; the rows are few per column."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "value")))
    return rows.groupBy("column").agg(F.transform(ordered, lambda item: item["value"]).alias("samples"))


def _typed_summary(df, names):
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *type_counters(df, names),
        *(_missing(df, n).alias(f"m{i}") for i, n in enumerate(names)),
    )


def _distinct_counts(values):
    """Rows (column, unique): how many different values each column has, from its distinct values."""
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("unique"))


def column_summary(df, columns=None, row_id=ROW_ID):
    """Type, present, missing and distinct counts and three sample values per column."""
    names = _chosen(df, columns)

    def fields(i, name):
        return (
            F.lit(name).alias("Column"),
            decided_type(df, i, name).alias("Type"),
            (F.col("total") - F.col(f"m{i}")).alias("Non-null Count"),
            F.col(f"m{i}").alias("Missing Count"),
        )

    rows = _per_column(_typed_summary(df, names), names, fields)
    unique = _distinct_counts(distinct_values(df, names, row_id=row_id)).withColumnRenamed("column", "Column")
    samples = _in_order(first_values(df, names, 3, row_id=row_id)).withColumnRenamed("column", "Column")
    return rows.join(unique, "Column", "left").join(samples, "Column", "left").select(
        "Column", "Type", "Non-null Count", "Missing Count", F.coalesce("unique", F.lit(0)).cast("long").alias("Unique Count"),
        F.coalesce(F.array_join("samples", ", "), F.lit("")).alias("Sample Values"),
    )


def numeric_summary(df, columns=None, few_rows=FEW_ROWS):
    """Count, missing, sum, mean, exact median, extremes and sample deviation; columns without numbers are left out."""
    names = numeric_candidates(df, columns)
    numbers = df.select(*(number_of(df, name).alias(f"v{i}") for i, name in enumerate(names)))
    values = {name: F.col(f"v{i}") for i, name in enumerate(names)}
    medians = quantile_columns(numbers, values, (0.5,), few_rows)
    aggregates = [F.count(F.lit(1)).alias("total")]
    for i, name in enumerate(names):
        v = values[name]
        aggregates += [
            F.count(v).alias(f"n{i}"), F.sum(v).alias(f"sum{i}"), F.avg(v).alias(f"avg{i}"), F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"), F.stddev_samp(v).alias(f"std{i}"), medians[name].alias(f"med{i}"),
        ]

    def fields(i, name):
        return (
            F.lit(name).alias("Column"),
            F.col(f"n{i}").alias("Count"),
            (F.col("total") - F.col(f"n{i}")).alias("Missing"),
            F.col(f"sum{i}").alias("Sum"),
            F.col(f"avg{i}").alias("Mean"),
            F.col(f"med{i}")[0].alias("Median"),
            F.col(f"min{i}").alias("Min"),
            F.col(f"max{i}").alias("Max"),
            F.col(f"std{i}").alias("Standard Deviation"),
        )

    return _per_column(numbers.agg(*aggregates), names, fields).filter(F.col("Count") > 0)


def describe_numeric(df, few_rows=FEW_ROWS):
    """Count, mean, sample deviation, extremes and exact quartiles of the columns of a numeric type."""
    names = [n for n in data_columns(df) if isinstance(type_of(df, n), T.NumericType)]
    numbers = df.select(*(number_of(df, name).alias(f"v{i}") for i, name in enumerate(names)))
    values = {name: F.col(f"v{i}") for i, name in enumerate(names)}
    quartiles = quantile_columns(numbers, values, (0.25, 0.5, 0.75), few_rows)
    aggregates = []
    for i, name in enumerate(names):
        v = values[name]
        aggregates += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"avg{i}"), F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"), quartiles[name].alias(f"q{i}"),
        ]

    def fields(i, name):
        return (
            F.lit(name).alias("column"),
            F.col(f"n{i}").alias("count"),
            F.col(f"avg{i}").alias("mean"),
            F.col(f"std{i}").alias("std"),
            F.col(f"min{i}").alias("min"),
            *(F.col(f"q{i}")[k].alias(label) for k, label in enumerate(("25%", "50%", "75%"))),
            F.col(f"max{i}").alias("max"),
        )

    return _per_column(numbers.agg(*aggregates), names, fields)


def date_summary(df, columns=None):
    """Earliest and latest date, missing and parsed counts of columns with dates.

    Of the columns asked for, those with any date; otherwise those of a date type and text of which four fifths are dates.
    """
    asked = resolve_columns(df.columns, columns)
    names = [n for n in asked or data_columns(df) if is_moment_type(type_of(df, n)) or is_text(type_of(df, n))]
    if not names:
        raise ValueError("No date-like column was found.")
    aggregates = []
    for i, name in enumerate(names):
        moment = lenient_moment(col(name), type_of(df, name))
        aggregates += [
            F.min(moment).alias(f"min{i}"), F.max(moment).alias(f"max{i}"), F.count(moment).alias(f"n{i}"),
            _missing(df, name).alias(f"m{i}"),
        ]

    def fields(i, name):
        whole = bool(asked) or is_moment_type(type_of(df, name))
        enough = F.lit(True) if whole else F.col(f"n{i}") >= PARSE_SHARE * (F.col("total") - F.col(f"m{i}"))
        return (
            F.lit(name).alias("Column"), F.col(f"min{i}").alias("Min Date"), F.col(f"max{i}").alias("Max Date"),
            F.col(f"m{i}").alias("Missing Count"), F.col(f"n{i}").alias("Parsed Count"), enough.alias("_enough"),
        )

    found = _per_column(df.agg(F.count(F.lit(1)).alias("total"), *aggregates), names, fields)
    return found.filter("_enough and `Parsed Count` > 0").drop("_enough")


def datetime_summary(df):
    """Earliest, latest and null count of the columns of a date or timestamp type."""
    names = [n for n in data_columns(df) if is_moment_type(type_of(df, n))]
    aggregates = []
    for i, name in enumerate(names):
        moment = lenient_moment(col(name), type_of(df, name))
        aggregates += [F.min(moment).alias(f"min{i}"), F.max(moment).alias(f"max{i}"), _missing(df, name, is_null).alias(f"m{i}")]

    def fields(i, name):
        return (
            F.lit(name).alias("column"), F.col(f"min{i}").alias("earliest"), F.col(f"max{i}").alias("latest"),
            F.col(f"m{i}").alias("missing_count"),
        )

    return _per_column(df.agg(*aggregates), names, fields)


def duplicate_count(df):
    """One row: how many rows repeat an earlier one."""
    names = data_columns(df)
    groups = df.groupBy(*(col(n) for n in names)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_row_count"))


def _unpivot(df, names):
    """Rows (column, value) of text; one pass for all columns."""
    pairs = (F.struct(F.lit(n).alias("column"), as_text(col(n), type_of(df, n)).alias("value")) for n in names)
    return df.select(F.inline(F.array(*pairs)))


def categorical_summary(df, limit=None):
    """Rows (column, unique_count, missing_count, rank, value, count): values of text and Boolean columns by frequency.

    With a limit only the most frequent ones. Without one, ranks come from a sort by ranges and the sizes of its partitions, so
    the distinct values of a column, however many, are spread over tasks; they are written once, to the shared folder.
    """
    names = [f.name for f in df.schema if is_text(f.dataType) or isinstance(f.dataType, T.BooleanType)]
    counts = _unpivot(df, names).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("column").agg(
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing_count"),
    )
    top = ranked(counts.filter("value is not null"), ["column"], [F.desc("count"), F.col("value")], limit)
    return totals.join(top, "column", "left").select("column", "unique_count", "missing_count", "rank", "value", "count")


def table_summary(df):
    """Per column: type, null count, table rows and columns, and nulls in the whole table."""
    names = data_columns(df)
    summary = df.agg(F.count(F.lit(1)).alias("n"), *(_missing(df, n, is_null).alias(f"m{i}") for i, n in enumerate(names)))
    total = reduce(lambda a, b: a + b, (F.col(f"m{i}") for i in range(len(names))))

    def fields(i, name):
        return (
            F.lit(name).alias("column"), F.lit(type_of(df, name).simpleString()).alias("type"),
            F.col(f"m{i}").alias("missing_count"), F.col("n").alias("row_count"),
            F.lit(len(names)).alias("column_count"), total.alias("total_missing"),
        )

    return _per_column(summary, names, fields)


def dataset_context(df, sample_limit=5, low_cardinality=LOW_CARDINALITY, row_id=ROW_ID):
    """Per column: type, missing and distinct counts, first values, and all values of columns with few different ones."""
    names = data_columns(df)

    def fields(i, name):
        return (
            F.lit(name).alias("column"), decided_type(df, i, name).alias("type"),
            F.col(f"m{i}").alias("missing_count"),
        )

    summary = _per_column(_typed_summary(df, names), names, fields)
    values = distinct_values(df, names, row_id=row_id)
    unique = _distinct_counts(values)
    few = _in_order(leading(values, low_cardinality)).withColumnRenamed("samples", "_few")
    samples = _in_order(first_values(df, names, sample_limit, row_id=row_id)).withColumnRenamed("samples", "sample_values")
    joined = summary.join(unique, "column", "left").join(samples, "column", "left").join(few, "column", "left")
    return joined.select(
        "column", "type", "missing_count", F.coalesce("unique", F.lit(0)).cast("long").alias("unique_count"), "sample_values",
        F.when(F.col("unique") <= low_cardinality, F.col("_few")).alias("low_cardinality_values"),
    )


def dataset_overview(df, sample_limit=5, mapping=None, status=None, row_id=ROW_ID):
    """One row: row and column counts, the first rows as JSON in row order, and the mapping in use with its status.

    mapping: {field: [sources]}, as active_mapping() gives it; without one both are null. Only the first rows meet in one place.
    """
    names = data_columns(df)
    cells = F.to_json(F.struct(*(col(n) for n in names)), {"ignoreNullFields": "false"})
    place = col(row_id) if row_id in df.columns else F.monotonically_increasing_id()
    first = df.select(place.alias("place"), cells.alias("row")).orderBy("place").limit(sample_limit)
    rows = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda r: r["row"]).alias("rows")).scalar()
    used = F.lit(None).cast("map<string,array<string>>")
    if mapping is not None:
        pairs = [x for field, sources in mapping.items() for x in (F.lit(field), F.array(*map(F.lit, sources)))]
        used = F.create_map(*pairs).cast("map<string,array<string>>")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(names)).alias("column_count"), rows.alias("sample_rows"),
        F.lit((status or "unreviewed") if mapping is not None else None).cast("string").alias("mapping_status"), used.alias("mapping"),
    )


# The shape of a number cell, and the shares from which a column is numeric or dated.
NUMBER_CELL = r"^-?\$?\s*-?[\d,]*\.?\d+%?$"
NUMBER_SHARE, DATE_SHARE = 0.85, 0.8
YEAR_RANGE = (1900, 2100)


def profile_flags(df):
    """Per column: num, date or text, currency and year flags, missing and present counts, and missing cells in all."""
    names = data_columns(df)
    aggregates = []
    for i, name in enumerate(names):
        data_type = type_of(df, name)
        value, blank = col(name), is_blank(col(name), data_type)
        number = lenient_number(value, data_type)
        cell = strip(as_text(value, data_type))
        numeric = cell.rlike(NUMBER_CELL) if is_text(data_type) else number.isNotNull()
        dated = is_moment_type(data_type) and value.isNotNull()
        if is_text(data_type):
            dated = lenient_moment(value, data_type).isNotNull() & cell.rlike(r"[-/:]")
        aggregates += [
            F.count(F.when(blank, 1)).alias(f"m{i}"),
            F.count(F.when(~blank, 1)).alias(f"p{i}"),
            F.count(F.when(~blank & numeric, 1)).alias(f"num{i}"),
            F.count(F.when(~blank & dated, 1) if dated is not False else F.lit(None)).alias(f"dat{i}"),
            F.count(F.when(~blank & cell.contains("$"), 1)).alias(f"cur{i}"),
            F.count(F.when(~blank & number.between(*YEAR_RANGE), 1)).alias(f"yr{i}"),
        ]
    total = reduce(lambda a, b: a + b, (F.col(f"m{i}") for i in range(len(names))))

    def fields(i, name):
        present = F.col(f"p{i}")
        numeric = (present > 0) & (F.col(f"num{i}") >= NUMBER_SHARE * present)
        header_dated = F.lit("date" in name.lower() or "time" in name.lower())
        dated = header_dated | ((present > 0) & (F.col(f"dat{i}") >= DATE_SHARE * present))
        year = F.lit("year" in name.lower()) & (F.col(f"yr{i}") == present)
        return (
            F.lit(name).alias("column"),
            F.when(numeric, F.lit("num")).when(dated, F.lit("date")).otherwise(F.lit("text")).alias("type"),
            (numeric & (F.col(f"cur{i}") > 0)).alias("currency"), (numeric & year).alias("year"),
            F.col(f"m{i}").alias("missing"), present.alias("non_empty"), total.alias("total_missing"),
        )

    return _per_column(df.agg(*aggregates), names, fields)


def column_profile(df, column, kind=None, few_rows=FEW_ROWS, limit=None):
    """Summary by kind: num (with population deviation), date (span) or text (values by frequency and the distinct count)."""
    name = resolve_column(df.columns, column)
    kind = kind or profile_flags(df.select(col(name))).first()["type"]
    if kind == "num":
        number = df.select(number_of(df, name).alias("v"))
        median = quantile_columns(number, {"v": F.col("v")}, (0.5,), few_rows)["v"]
        v = F.col("v")
        return number.agg(
            F.count(v).alias("count"), F.avg(v).alias("mean"), median.alias("median"), F.min(v).alias("min"),
            F.max(v).alias("max"), F.sum(v).alias("sum"), F.stddev_pop(v).alias("sd"),
        ).withColumn("median", F.col("median")[0])
    if kind == "date":
        moment = lenient_moment(col(name), type_of(df, name))
        return df.agg(F.min(moment).alias("earliest"), F.max(moment).alias("latest"), F.count(moment).alias("count"))
    counts = value_counts(df, name)
    unique = counts.agg(F.count(F.lit(1)).alias("unique"))  # one row
    top = counts if limit is None else counts.limit(limit)
    return top.select(as_text(col(name), type_of(df, name)).alias("value"), F.col("Count").alias("count"), unique.scalar().alias("unique"))
