"""Types of text columns, from the share of values that parse."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.dates import is_moment_type, lenient_moment
from rollbook.functions.missing import is_blank, is_null, is_text, type_of
from rollbook.functions.numbers import lenient_number
from rollbook.operators.sampling import col, data_columns

PARSE_SHARE = 0.8


def type_label(data_type):
    """The type word of a typed column, None for text."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_moment_type(data_type):
        return "date"
    if isinstance(data_type, T.NumericType):
        return "number"
    return None


def type_counters(df, columns):
    """Aggregates that decide each text column's type: present, numeric and dated value counts."""
    counters = []
    for i, name in enumerate(columns):
        data_type = type_of(df, name)
        if type_label(data_type):
            continue
        value = col(name)
        counters.append(F.count(F.when(~is_blank(value, data_type), 1)).alias(f"present_{i}"))
        counters.append(F.count(lenient_number(value, data_type)).alias(f"numeric_{i}"))
        counters.append(F.count(lenient_moment(value, data_type)).alias(f"dated_{i}"))
    return counters


def decided_type(df, i, name):
    """Type of column i as an expression over the counters."""
    fixed = type_label(type_of(df, name))
    if fixed:
        return F.lit(fixed)
    present = F.col(f"present_{i}")
    return (
        F.when((present > 0) & (F.col(f"numeric_{i}") >= PARSE_SHARE * present), F.lit("number"))
        .when((present > 0) & (F.col(f"dated_{i}") >= PARSE_SHARE * present), F.lit("date"))
        .otherwise(F.lit("text"))
    )


def infer_types(df, columns=None):
    """One row (column, type) per column; boolean, date, number or text. All columns share one aggregation."""
    columns = list(columns or data_columns(df))
    counters = type_counters(df, columns)
    summary = df.agg(*counters) if counters else df.sparkSession.range(1)
    rows = F.array(*(F.struct(F.lit(n).alias("column"), decided_type(df, i, n).alias("type")) for i, n in enumerate(columns)))
    return summary.select(F.inline(rows))


def infer_datetimes(df):
    """Turn text columns named after a date or time into timestamps when at least 80 % of their values parse."""
    named = [
        f.name for f in df.schema
        if is_text(f.dataType) and ("date" in f.name.lower() or "time" in f.name.lower())
    ]
    if not named:
        return df
    counters = []
    for i, name in enumerate(named):
        data_type = type_of(df, name)
        counters.append(F.count(F.when(~is_null(col(name), data_type), 1)).alias(f"present_{i}"))
        counters.append(F.count(lenient_moment(col(name), data_type)).alias(f"parsed_{i}"))
    rates = df.agg(*counters).first()
    chosen = {
        name for i, name in enumerate(named)
        if rates[f"present_{i}"] and rates[f"parsed_{i}"] >= PARSE_SHARE * rates[f"present_{i}"]
    }
    return df.select(
        *(
            lenient_moment(col(n), type_of(df, n)).alias(n) if n in chosen else col(n)
            for n in df.columns
        )
    )
