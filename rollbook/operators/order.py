"""Sorting, top rows and duplicate groups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.missing import as_text, is_text, type_of
from rollbook.operators.aggregate import number_of
from rollbook.operators.columns import resolve_column, resolve_columns
from rollbook.operators.sampling import any_row, col, data_columns
from rollbook.operators.skew import attach_groups
from rollbook.sources.files import ROW_ID


def _direction(key, ascending):
    return key.asc_nulls_last() if ascending else key.desc_nulls_last()


def sort_key(df, name):
    """Numeric order when any value is a number, folded text otherwise. Only text columns need to be looked at."""
    data_type = type_of(df, name)
    number = number_of(df, name)
    if isinstance(data_type, (T.NumericType, T.BooleanType)) or (is_text(data_type) and any_row(df, number.isNotNull())):
        return number
    return F.lower(as_text(col(name), data_type)) if is_text(data_type) else col(name)


def _sorted(df, key, ascending, limit, row_id):
    order = [_direction(key, ascending)] + ([col(row_id)] if row_id in df.columns else [])
    rows = df.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def sort_rows(df, column, ascending=True, limit=None, row_id=ROW_ID):
    """Rows in column order, absent values last, ties in row order."""
    return _sorted(df, sort_key(df, resolve_column(df.columns, column)), ascending, limit, row_id)


def _extreme(df, column, n, ascending, row_id):
    name = resolve_column(df.columns, column)
    number = number_of(df, name)
    if not any_row(df, number.isNotNull()):
        raise ValueError(f"Column '{name}' does not contain numeric values.")
    return _sorted(df, number, ascending, n, row_id)


def top_n(df, column, n=10, row_id=ROW_ID):
    return _extreme(df, column, n, False, row_id)


def bottom_n(df, column, n=10, row_id=ROW_ID):
    return _extreme(df, column, n, True, row_id)


def top_rows(df, column, ascending=False, limit=10, numeric=None, row_id=ROW_ID):
    """Leading rows by number, or by folded text. Cells without a number rank lowest, blank texts sort as empty."""
    name = resolve_column(df.columns, column)
    if numeric is None:
        numeric = isinstance(type_of(df, name), T.NumericType)
    key = number_of(df, name) if numeric else F.lower(F.coalesce(as_text(col(name), type_of(df, name)), F.lit("")))
    order = key.asc_nulls_first() if ascending else key.desc_nulls_last()
    ties = [col(row_id)] if row_id in df.columns else []
    return df.orderBy(order, *ties).limit(limit)


def duplicate_rows(df, subset=None, limit=None, row_id=ROW_ID):
    """Every member of a group of equal rows, nulls being equal; equality may be limited to some columns.

    A limit takes the first rows by row id, or by the compared columns where there is none.
    """
    keys = resolve_columns(df.columns, subset) or data_columns(df)
    groups = df.groupBy(*(col(k) for k in keys)).agg(F.count(F.lit(1)).alias("_copies"))
    repeated = groups.filter(F.col("_copies") > 1)
    rows = attach_groups(df, repeated, keys, how="inner").drop("_copies")
    if limit is None:
        return rows
    order = [row_id] if row_id in rows.columns else keys
    return rows.orderBy(*(col(c) for c in order)).limit(limit)


def duplicate_metrics(df, subset=None):
    """One row: members of duplicate groups, and rows."""
    keys = resolve_columns(df.columns, subset) or data_columns(df)
    groups = df.groupBy(*(col(k) for k in keys)).agg(F.count(F.lit(1)).alias("_copies"))
    copies = F.col("_copies")
    return groups.agg(
        F.coalesce(F.sum(F.when(copies > 1, copies)), F.lit(0)).alias("duplicate_row_count"),
        F.coalesce(F.sum(copies), F.lit(0)).alias("total_rows"),
    )
