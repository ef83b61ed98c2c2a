"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import functions as F


def format_value(column):
    """Thousands separators; two decimals unless the number is whole; "Not available" for null."""
    number = column.cast("double")
    whole = number == F.floor(number)
    text = F.when(whole, F.format_number(number.cast("long"), 0)).otherwise(F.format_number(number, 2))
    return F.coalesce(text, F.lit("Not available"))


def format_compact(column, currency=False, year=False):
    """Short form for charts: $1.2M and $120.5K for currency, bare years, at most two decimals otherwise."""
    number = column.cast("double")

    def short(value, unit):
        # format_number rounds the exact binary value; format_string would round its decimal rendering.
        return F.concat(F.lit("$"), F.translate(F.format_number(value, 1), ",", ""), F.lit(unit))

    if year:
        text = F.round(number).cast("long").cast("string")
    elif currency:
        text = (
            F.when(F.abs(number) >= 1e6, short(number / 1e6, "M"))
            .when(F.abs(number) >= 1e5, short(number / 1e3, "K"))
            .otherwise(F.concat(F.lit("$"), F.format_number(F.round(number).cast("long"), 0)))
        )
    else:
        trimmed = F.regexp_replace(F.format_number(F.round(number, 2), 2), r"\.?0+$", "")
        text = F.when(number == F.floor(number), F.format_number(number.cast("long"), 0)).otherwise(trimmed)
    return F.when(number.isNull() | F.isnan(number), F.lit("—")).otherwise(text)
