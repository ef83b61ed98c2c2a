"""Collects queries under their names."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function of (spark, sf_dir); sql is the equivalent for DuckDB."""

    def keep(function):
        if name in QUERIES:
            raise ValueError(f"Query '{name}' is registered twice.")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def rounded(df, places, *columns):
    """Round sums and means, whose last digits depend on the order of addition."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), places) for c in columns})


def listed(df, *columns):
    """Arrays as text, so that both engines print them alike."""
    return df.withColumns({c: F.array_join(F.col(c), "|", "~") for c in columns})
