"""Grouped counts and sums, value frequencies, months and correlations."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.dates import lenient_moment, month_key
from rollbook.functions.missing import as_text, is_blank, is_text, type_of
from rollbook.functions.numbers import lenient_number
from rollbook.operators.columns import resolve_column, resolve_columns
from rollbook.operators.sampling import col, data_columns

MISSING_KEY = "Missing"
MONTH_AGGREGATES = {"count": None, "sum": F.sum, "average": F.avg}


def group_key(df, name):
    """Group key as text; blank cells share one key."""
    data_type = type_of(df, name)
    return F.when(is_blank(col(name), data_type), F.lit(MISSING_KEY)).otherwise(as_text(col(name), data_type))


def number_of(df, name):
    return lenient_number(col(name), type_of(df, name))


def _ranked(grouped, value, key, limit, ascending=False):
    """Order by value, ties by key; all groups unless there is a limit."""
    order = col(value).asc_nulls_last() if ascending else col(value).desc_nulls_last()
    ordered = grouped.orderBy(order, col(key).asc())
    return ordered if limit is None else ordered.limit(limit)


def group_by_count(df, by, limit=None):
    name = resolve_column(df.columns, by)
    counted = df.groupBy(group_key(df, name).alias(name)).agg(F.count(F.lit(1)).alias("Count"))
    return _ranked(counted, "Count", name, limit)


def _group_by_number(df, by, value, label, aggregate, limit):
    name, source = resolve_column(df.columns, by), resolve_column(df.columns, value)
    valid = df.select(group_key(df, name).alias(name), number_of(df, source).alias("_value")).filter("_value is not null")
    out = f"{label} {source}"
    return _ranked(valid.groupBy(name).agg(aggregate("_value").alias(out)), out, name, limit)


def group_by_sum(df, by, value, limit=None):
    """Sums per group. Rows without a number are dropped first, so groups without any number vanish."""
    return _group_by_number(df, by, value, "Sum", F.sum, limit)


def group_by_average(df, by, value, limit=None):
    return _group_by_number(df, by, value, "Average", F.avg, limit)


def group_by_metrics(df, value):
    """One row: rows with a usable number, all rows, and rows without one."""
    number = number_of(df, resolve_column(df.columns, value))
    return df.agg(
        F.count(number).alias("rows_matched"),
        F.count(F.lit(1)).alias("total_rows"),
        (F.count(F.lit(1)) - F.count(number)).alias("invalid_or_missing_numeric_values"),
    )


def group_by_agg(df, by, value=None, op="count", limit=None):
    """count, sum, mean, min or max per group; minima sort upwards, everything else downwards."""
    name = resolve_column(df.columns, by)
    key = group_key(df, name).alias(name)
    if op == "count":
        out = df.groupBy(key).agg(F.count(F.lit(1)).alias("value"))
    else:
        number = number_of(df, resolve_column(df.columns, value))
        found = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[op](number)
        if op in ("sum", "mean"):
            found = F.coalesce(found, F.lit(0.0))
        out = df.groupBy(key).agg(found.alias("value")).filter("value is not null")
    return _ranked(out, "value", name, limit, ascending=op == "min")


def group_by_month(df, date_column, value=None, aggregation="count", limit=None):
    """Per month yyyy-MM in time order; with a limit the last months. Every cell of a text column is parsed. Months without rows are not filled in."""
    if aggregation not in MONTH_AGGREGATES:
        raise ValueError("Aggregation must be count, sum or average.")
    if aggregation != "count" and not value:
        raise ValueError("A value column is required for sum and average.")
    name = resolve_column(df.columns, date_column)
    data_type = type_of(df, name)
    picked = [month_key(lenient_moment(col(name), data_type)).alias("Month")]
    if aggregation == "count":
        label, aggregate = "Count", F.count(F.lit(1))
    else:
        source = resolve_column(df.columns, value)
        picked.append(number_of(df, source).alias("_value"))
        label, aggregate = f"{aggregation.title()} {source}", MONTH_AGGREGATES[aggregation]("_value")
    rows = df.select(*picked).dropna()
    grouped = rows.groupBy("Month").agg(aggregate.alias(label))
    if limit is not None:
        grouped = grouped.orderBy(F.desc("Month")).limit(limit)
    return grouped.orderBy("Month")


def value_counts(df, column, limit=None):
    """Present values by frequency."""
    name = resolve_column(df.columns, column)
    counted = df.filter(~is_blank(col(name), type_of(df, name))).groupBy(col(name)).agg(F.count(F.lit(1)).alias("Count"))
    return _ranked(counted, "Count", name, limit)


def unique_values(df, column, limit=None):
    return value_counts(df, column, limit)


def unique_metrics(df, column):
    """One row: the exact number of distinct present values, and rows."""
    name = resolve_column(df.columns, column)
    present = F.when(~is_blank(col(name), type_of(df, name)), col(name))
    return df.agg(F.countDistinct(present).alias("unique_count"), F.count(F.lit(1)).alias("total_rows"))


def numeric_candidates(df, columns, minimum=1):
    """Columns with at least this many numbers. Typed columns are taken as they are; text columns share one pass."""
    names = resolve_columns(df.columns, columns) or data_columns(df)
    if columns:
        return names
    texts = [name for name in names if is_text(type_of(df, name))]
    counts = df.agg(*(F.count(number_of(df, name)).alias(f"n{i}") for i, name in enumerate(texts))).first() if texts else ()
    enough = {name for name, n in zip(texts, counts) if n >= minimum}
    return [n for n in names if n in enough or isinstance(type_of(df, n), (T.NumericType, T.BooleanType))]


def _pearson(a, b):
    """Pearson correlation of the pairs where both are present; null when a side does not vary."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


#: Up to so many columns, pairs are aggregates of one plan; more go through the matrix of products, in blocks of so many.
FEW_COLUMNS, BLOCK = 12, 1000


def _products(numbers, a, b, centres):
    """Rows (a, b, n, sa, sb, saa, sbb, sab, odd) of the pairs of columns a x b, summed over each task's rows.

    n counts the rows where both are present, odd those of them with a value that is not finite. Values are taken from the mean of
    their column, which keeps the sums exact where columns lie far from 0. A task holds 7 numbers for each pair, whatever it reads.
    """
    names = ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab", "odd"]
    same = a == b

    def run(batches):
        total = np.zeros((7, len(a), len(b)))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
            there = [(~c.is_null().to_numpy(zero_copy_only=False)) for c in batch.columns]
            half = [slice(0, len(a)), slice(0, len(a)) if same else slice(len(a), None)]
            (x, mx, ox), (y, my, oy) = (
                (np.where(finite & m, v - np.array(c), 0.0), m.astype(float), (m & ~finite).astype(float))
                for v, m, c in ((np.column_stack(columns[h]), np.column_stack(there[h]), centres[k]) for k, h in enumerate(half))
                for finite in [np.isfinite(v)]
            )
            for k, (p, q) in enumerate(((mx, my), (x, my), (mx, y), (x * x, my), (mx, y * y), (x, y))):
                total[k] += p.T @ q
            total[6] += ox.T @ my + mx.T @ oy
        i, j = np.triu_indices(len(a), 1) if same else map(np.ravel, np.indices((len(a), len(b))))
        arrays = [pa.array(np.asarray(a)[i]), pa.array(np.asarray(b)[j]), *(pa.array(t[i, j]) for t in total)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "a long, b long, " + ", ".join(f"{n} double" for n in names[2:])
    return numbers.select(*(f"v{k}" for k in (a if same else [*a, *b]))).mapInArrow(run, schema)


def gram_matrix(df, names, block=BLOCK):
    """Rows (a, b, n, sa, sb, saa, sbb, sab, odd) of all pairs of columns by number, and the means they are taken from.

    There is one scan for each pair of blocks of columns.
    """
    numbers = df.select(*(number_of(df, name).cast("double").alias(f"v{i}") for i, name in enumerate(names)))
    finite = (F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in numbers.columns)
    means = [m or 0.0 for m in numbers.agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(finite))).first()]
    parts = [list(range(i, min(i + block, len(names)))) for i in range(0, len(names), block)]
    found = [
        _products(numbers, a, b, [[means[k] for k in part] for part in (a, b)]) for i, a in enumerate(parts) for b in parts[i:]
    ]
    sums = [F.sum(n).alias(n) for n in ("n", "sa", "sb", "saa", "sbb", "sab", "odd")]
    return reduce(lambda x, y: x.unionByName(y), found).groupBy("a", "b").agg(*sums), means


def _correlations(df, names, block):
    """Rows (Column 1, Column 2, Correlation) from the matrix of products."""
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    va, vb = (F.col(q) - s * s / n for q, s in (("saa", sa), ("sbb", sb)))
    matrix, means = gram_matrix(df, names, block)
    # A side whose spread is no more than the rounding of its sums and of its mean does not vary.
    rounding = F.array(*(F.lit((1e-14 * m) ** 2) for m in means))
    varies = reduce(and_, (v > F.greatest(1e-12 * F.col(q), n * F.get(rounding, F.col(k).cast("int"))) for v, q, k in ((va, "saa", "a"), (vb, "sbb", "b"))))
    varies = varies & (F.col("odd") == 0)
    r = F.when(varies, (F.col("sab") - sa * sb / n) / F.sqrt(va * vb))
    at = F.array(*map(F.lit, names))
    return matrix.where("n > 0").select(
        F.get(at, F.col("a").cast("int")).alias("Column 1"), F.get(at, F.col("b").cast("int")).alias("Column 2"),
        F.when(F.abs(r) > 1, F.signum(r)).otherwise(r).alias("Correlation"),
    )


def correlation(df, columns=None, limit=None, few=FEW_COLUMNS, block=BLOCK):
    """All pairs of numeric columns by strength; a pair uses the rows where both are present."""
    names = numeric_candidates(df, columns, minimum=2)
    pairs = list(combinations(names, 2))
    if not pairs:
        raise ValueError("Correlation needs two numeric columns.")
    if len(names) > few:
        rows = _correlations(df, names, block)
    else:
        numbers = df.select(*(number_of(df, name).alias(f"v{i}") for i, name in enumerate(names)))
        at = {name: F.col(f"v{i}") for i, name in enumerate(names)}
        row = numbers.agg(*(_pearson(at[a], at[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
        found = F.array(
            *(F.struct(F.lit(a).alias("Column 1"), F.lit(b).alias("Column 2"), F.col(f"r{i}").alias("Correlation"))
              for i, (a, b) in enumerate(pairs))
        )
        rows = row.select(F.inline(found))
    rows = rows.filter("Correlation is not null and not isnan(Correlation)")
    rows = rows.withColumn("Absolute Correlation", F.abs("Correlation"))
    ordered = rows.orderBy(F.desc("Absolute Correlation"), "Column 1", "Column 2")
    return ordered if limit is None else ordered.limit(limit)


def correlation_pair(df, a, b):
    """One row: correlation of two columns and the number of complete pairs; null below two pairs."""
    x, y = (number_of(df, resolve_column(df.columns, name)) for name in (a, b))
    return df.agg(_pearson(x, y).alias("r"), F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias("n"))
