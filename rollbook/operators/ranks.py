"""Ranks within groups of any size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Window, functions as F

from rollbook.session import saved

PART, PLACE = "_part", "_place"


def ranked(rows, keys, order, limit=None, name="rank", parts=None):
    """Add the rank of each row within its group, from 1 in the given order, which must leave no ties.

    With a limit, tasks drop all but their own leading rows before the shuffle. Without one, all rows are sorted by (keys, order)
    over range partitions and written with their places; a row's rank is its place among the rows of its group in its partition
    plus the sizes of the group in the partitions before. Only those sizes, one row for each group and partition, meet in one place.
    """
    if limit is not None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= limit)
    by = [*map(F.col, keys), *order]
    dealt = (rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).sortWithinPartitions(*by)
    # Partition and place are columns of the written table, so they stay what they were however files are read.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = saved(dealt.withColumns({PART: F.spark_partition_id(), PLACE: place}), "ranks")
    sizes = written.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("_n"), F.min(PLACE).alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(PART).alias("_at"), *(F.col(k).alias(f"_of_{k}") for k in keys), (before - F.col("_first") + 1).alias("_shift"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys), F.col(PART) == F.col("_at"))
    return written.join(offsets, same).select(*rows.columns, (F.col(PLACE) + F.col("_shift")).alias(name))
