"""Columns of a table, and the first values of each column."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from rollbook.functions.missing import as_text, is_blank, type_of
from rollbook.sources.files import ROW_ID

POSITION = "_position"


def col(name):
    return F.col(f"`{name}`")


def data_columns(df):
    """All columns but the row identity."""
    return [name for name in df.columns if not (name.startswith("_") and name.endswith(ROW_ID))]


def cells(df, columns, missing=is_blank, row_id=ROW_ID):
    """Rows (ordinal, column, position, value) of all present cells as text: one narrow pass over the table."""
    position = col(row_id) if row_id in df.columns else F.monotonically_increasing_id()
    each = F.array(
        *(
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(name).alias("column"),
                F.when(~missing(col(name), type_of(df, name)), as_text(col(name), type_of(df, name))).alias("value"),
            )
            for i, name in enumerate(columns)
        )
    )
    rows = df.select(position.alias("position"), each.alias("_cells")).select("position", F.inline("_cells"))
    return rows.filter("value is not null").select("ordinal", "column", "position", "value")


def distinct_values(df, columns, missing=is_blank, row_id=ROW_ID):
    """Rows (ordinal, column, value, position, count): every present value once, with the place where it stands first."""
    found = cells(df, columns, missing, row_id).groupBy("ordinal", "column", "value")
    return found.agg(F.min("position").alias("position"), F.count(F.lit(1)).alias("count"))


def leading(rows, n):
    """The first n rows of each column. The rank filter lets tasks drop all but their own first n before the shuffle."""
    order = Window.partitionBy("ordinal").orderBy("position")
    ranked = rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n)
    return ranked.select("ordinal", "column", "position", "value")


def first_values(df, columns, n, missing=is_blank, row_id=ROW_ID, distinct=False):
    """Rows (ordinal, column, position, value): the first n present values of each column in row order.

    With distinct=True repeated values count once, at their first appearance.
    """
    columns = list(columns)
    rows = distinct_values(df, columns, missing, row_id) if distinct else cells(df, columns, missing, row_id)
    return leading(rows, n)


def any_row(df, condition):
    """Whether some row satisfies the condition; stops at the first one."""
    return not df.filter(condition).limit(1).isEmpty()
