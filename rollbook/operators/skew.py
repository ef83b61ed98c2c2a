"""Dealing rows evenly over tasks, and bringing per-group results back to rows when one group may hold a large share of them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F


def spread(rows):
    """The rows dealt evenly over the tasks of a shuffle.

    A compressed file of a few MB can hold a million rows and still be one split, so work that is heavy for each row would run in
    one task. The rows are dealt by their number, which needs no sort and no memory, and no value of theirs can crowd a task.
    """
    return rows.withColumn("_deal", F.monotonically_increasing_id()).repartition("_deal").drop("_deal")


def attach_groups(rows, groups, keys, how="left"):
    """Join rows with groups (unique on keys, nulls equal); group columns other than keys are added.

    The groups come from an aggregation and the rows are joined as they are, so this is an ordinary shuffled join with one row
    per key on one side. Adaptive execution splits the row side of a large key into as many tasks as its size asks for, however
    many such keys there are; nothing is salted or broadcast here.
    """
    named = groups.select(
        *(F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`") for c in groups.columns if c not in keys)
    )
    on = reduce(and_, (rows[f"`{k}`"].eqNullSafe(named[f"_key_{i}"]) for i, k in enumerate(keys)))
    return rows.join(named, on, how).drop(*(f"_key_{i}" for i in range(len(keys))))
