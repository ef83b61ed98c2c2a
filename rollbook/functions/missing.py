"""The three notions of a missing value. They differ on purpose; see README."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\x0b\x0c"

# Texts that count as absent in predicates and e-mail cells.
NULLISH_TEXTS = ("", "nan", "none", "null", "nat")

FLOATING = (T.FloatType, T.DoubleType)


def strip(column):
    return F.btrim(column, F.lit(WHITESPACE))


def collapse_blanks(column):
    return F.regexp_replace(strip(column), r"\s+", " ")


def is_text(data_type):
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


def type_of(df, name):
    return df.schema[name].dataType


def is_null(column, data_type):
    """Null as the loader sees it: SQL null, or NaN in a floating column."""
    if isinstance(data_type, FLOATING):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def is_blank(column, data_type):
    """Null, NaN or text of whitespace only."""
    if is_text(data_type):
        return column.isNull() | (strip(column) == "")
    return is_null(column, data_type)


def is_nullish(column, data_type):
    """Blank, or one of the texts people type for "nothing"."""
    if is_text(data_type):
        return column.isNull() | F.lower(strip(column)).isin(*NULLISH_TEXTS)
    return is_null(column, data_type)


def as_text(column, data_type):
    return column if is_text(data_type) else column.cast("string")
