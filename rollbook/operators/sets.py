"""Set algebra between results of one table, on row identity. Ids are unique, so no join here can be skewed."""

from __future__ import annotations

from rollbook.sources.files import ROW_ID


def intersect_rows(a, b, row_id=ROW_ID):
    return a.join(b.select(row_id), row_id, "left_semi")


def except_rows(a, b, row_id=ROW_ID):
    return a.join(b.select(row_id), row_id, "left_anti")


def union_rows(a, b, row_id=ROW_ID):
    """Rows of either; where both have a row, the first one's version stays."""
    return a.unionByName(except_rows(b, a, row_id), allowMissingColumns=True)
