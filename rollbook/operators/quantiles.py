"""Exact quantiles of whole columns without collecting a column in one task.

The values of every column are counted in equal-width bins; each wanted rank picks its bin, and the bin is divided again until
it holds few rows; only these are ranked. Every pass is one scan and one job for all columns and ranks, whose counts are
combined before they are shuffled, and the driver sees at most BINS counts per open bracket. All tables take this way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Window, functions as F

FEW_ROWS = 10_000
BINS = 4096


@dataclass(frozen=True)
class _Bracket:
    """Values of one column between two of its values, and how many lie below and inside."""

    name: str
    low: float
    high: float
    below: int
    inside: int

    def open(self, few_rows):
        return self.low < self.high and self.inside > few_rows

    def member(self, value):
        return (value >= F.lit(self.low)) & (value <= F.lit(self.high))

    def bin(self, value):
        """Number of the bin, rising with the value. Halves keep the width finite; where it is 0, the bracket has two values."""
        width = self.high / 2 - self.low / 2
        if width == 0:
            return (value > F.lit(self.low)).cast("int")
        return F.least(F.floor((value / 2 - self.low / 2) / width * BINS), F.lit(BINS - 1)).cast("int")


def _members(df, values, brackets):
    """Rows (id, bin, value) of all values in a bracket, from one scan. The brackets of a column do not overlap."""
    cells = []
    for name, value in values.items():
        own = [(i, b) for i, b in enumerate(brackets) if b.name == name]
        if own:
            number, place = F, F
            for i, b in own:
                number, place = number.when(b.member(value), i), place.when(b.member(value), b.bin(value))
            cells.append(F.struct(number.alias("id"), place.alias("bin"), value.alias("value")))
    return df.select(F.inline(F.array(*cells))).filter("id is not null")


def _divide(df, values, brackets):
    """The non-empty bins of each bracket, in order, as brackets of their own."""
    found = _members(df, values, brackets).groupBy("id", "bin").agg(
        F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    parts = {b: [] for b in brackets}
    below = [b.below for b in brackets]
    for row in sorted(found.collect(), key=lambda r: (r["id"], r["bin"])):
        bracket = brackets[row["id"]]
        parts[bracket].append(_Bracket(bracket.name, row["lo"], row["hi"], below[row["id"]], row["n"]))
        below[row["id"]] += row["n"]
    return parts


def _ranked(df, values, wanted):
    """{(name, rank): value} for ranks in brackets with few rows."""
    brackets = sorted({b for b in wanted.values()}, key=lambda b: (b.name, b.below))
    rows = _members(df, values, brackets).groupBy("id", "value").count()
    running = Window.partitionBy("id").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = {i: sorted({rank - b.below for (n, rank), w in wanted.items() if w == b}) for i, b in enumerate(brackets)}
    asked = F.array(*(F.array(*map(F.lit, ranks[i])) for i in range(len(brackets))))
    upto = F.col("upto")
    counted = rows.withColumn("upto", F.sum("count").over(running)).select(
        "id", "value", "upto", "count", F.explode(asked[F.col("id")]).alias("rank")
    )
    found = counted.filter((F.col("rank") < upto) & (F.col("rank") >= upto - F.col("count"))).collect()
    at = {(row["id"], row["rank"]): row["value"] for row in found}
    return {key: at[brackets.index(b), key[1] - b.below] for key, b in wanted.items()}


def _infinite(name, rank, row, i):
    """Infinities have no place in bins: ranks among them are known at once."""
    if rank < row[f"neg{i}"]:
        return -math.inf
    if rank >= row[f"neg{i}"] + row[f"fin{i}"]:
        return math.inf
    return None


def exact_quantiles(df, values, probabilities, few_rows=FEW_ROWS):
    """{name: [quantile, ...]} with linear interpolation; None for a column without values."""
    extent = []
    for i, value in enumerate(values.values()):
        finite = F.when(F.abs(value) < math.inf, value)
        extent += [
            F.count(value).alias(f"n{i}"), F.count(F.when(value == -math.inf, 1)).alias(f"neg{i}"),
            F.count(finite).alias(f"fin{i}"), F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}"),
        ]
    row = df.agg(*extent).first() if extent else None
    sizes = {name: row[f"n{i}"] for i, name in enumerate(values)}
    at, wanted = {}, {}
    for i, name in enumerate(values):
        for p in probabilities if sizes[name] else ():
            position = (sizes[name] - 1) * p
            for rank in {math.floor(position), math.ceil(position)}:
                known = _infinite(name, rank, row, i)
                if known is not None:
                    at[name, rank] = known
                else:
                    wanted[name, rank] = _Bracket(name, row[f"lo{i}"], row[f"hi{i}"], row[f"neg{i}"], row[f"fin{i}"])
    while brackets := sorted({b for b in wanted.values() if b.open(few_rows)}, key=lambda b: (b.name, b.below)):
        parts = _divide(df, values, brackets)
        for (name, rank), b in wanted.items():
            if b in parts:
                wanted[name, rank] = next(p for p in parts[b] if p.below <= rank < p.below + p.inside)
                if wanted[name, rank] == b:
                    raise ArithmeticError(f"Values of '{name}' between {b.low} and {b.high} are too close to be told apart.")
    at |= {key: b.low for key, b in wanted.items() if b.low == b.high}
    rest = {key: b for key, b in wanted.items() if b.low != b.high}
    at |= _ranked(df, values, rest) if rest else {}

    def quantile(name, p):
        position = (sizes[name] - 1) * p
        low, high = at[name, math.floor(position)], at[name, math.ceil(position)]
        return low if low == high else low + (high - low) * (position - math.floor(position))

    return {name: [quantile(name, p) if sizes[name] else None for p in probabilities] for name in values}


def quantile_columns(df, values, probabilities, few_rows=FEW_ROWS):
    """{name: array-of-quantiles column} to use beside other aggregates of the same table."""
    exact = exact_quantiles(df, values, probabilities, few_rows)
    return {name: F.array(*(F.lit(q).cast("double") for q in found)) for name, found in exact.items()}
