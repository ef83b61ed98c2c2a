"""Two number parsers: a lenient one for aggregation and a strict one for predicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.missing import FLOATING, is_text, strip

MAX_TYPED_LENGTH = 120
LENIENT_SHAPE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
STRICT_SHAPE = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"


def _finite(column):
    usable = ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))
    return F.when(usable, column)


def lenient_number(column, data_type):
    """Numeric columns pass through; text loses currency, grouping and percent signs. Unparsable text is null."""
    if isinstance(data_type, FLOATING):
        return F.when(~F.isnan(column), column.cast("double"))
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    if not is_text(data_type):
        return F.lit(None).cast("double")
    bare = strip(F.translate(column, "$,%", ""))
    return F.when(bare.rlike(LENIENT_SHAPE), bare.try_cast("double"))


def strict_number(column, data_type):
    """A finite number; "(x)" is negative, "$" and "," are dropped, exponents, percents and booleans are refused."""
    if isinstance(data_type, FLOATING):
        return _finite(column.cast("double"))
    if isinstance(data_type, T.NumericType):
        return column.cast("double")
    if not is_text(data_type):
        return F.lit(None).cast("double")
    raw = strip(column)
    bracketed = raw.startswith("(") & raw.endswith(")")
    inner = F.when(bracketed, F.regexp_replace(raw, r"^\(|\)$", "")).otherwise(raw)
    bare = strip(F.translate(inner, "$,", ""))
    value = _finite(bare.try_cast("double"))
    signed = F.when(bracketed, -value).otherwise(value)
    return F.when((F.length(raw) <= MAX_TYPED_LENGTH) & bare.rlike(STRICT_SHAPE), signed)
