"""Date parsing by shape.

Trying a list of datetime patterns raises and catches one exception per miss and row. Here each shape is told apart by a
regular expression, rewritten to ISO text, and cast once with try_cast, which neither raises nor depends on the zone.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.missing import FLOATING, is_text, strip
from rollbook.functions.numbers import MAX_TYPED_LENGTH

# Full and abbreviated month names, accepted in any case.
MONTH_NAMES = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
    "|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
)
MONTH_STEMS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Serial day 0, the largest serial day, and the whole numbers read as years.
SERIAL_ORIGIN = "1899-12-30"
MAX_SERIAL = 2_958_465
FIRST_YEAR, LAST_YEAR = 1900, 2200

# A column of text counts as date-like when its first values show one of these.
DATE_LIKE = (
    r"(\d{4}[-/]\d{1,2})|(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
    r"|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)"
)

ISO_MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"
ZONED_MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)? ?(Z|z|UTC|[+-]\d{2}:?\d{2})$"


def _iso_text(raw):
    """ISO date text for the known calendar-date shapes, null for any other text."""
    low = F.lower(raw)

    def part(pattern, group):
        return F.regexp_extract(low, pattern, group)

    def month(pattern, group):
        stem = F.substring(part(pattern, group), 1, 3)
        number = (F.instr(F.lit(MONTH_STEMS), stem) + 2) / 3
        return number.cast("int").cast("string")

    year_first = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    year_first_slash = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
    us_slash = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    us_dash = r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    us_short = r"^(\d{1,2})/(\d{1,2})/(\d{2})$"
    named_day = rf"^({MONTH_NAMES})\s+(\d{{1,2}})(?:,\s*|\s+)(\d{{4}})$"
    day_named = rf"^(\d{{1,2}})\s+({MONTH_NAMES})\s+(\d{{4}})$"
    named_month = rf"^({MONTH_NAMES})\s+(\d{{4}})$"
    compact = r"^(\d{4})(\d{2})(\d{2})$"
    century = F.when(part(us_short, 3).try_cast("int") >= 69, F.lit("19")).otherwise(F.lit("20"))

    def joined(*pieces):
        return F.concat_ws("-", *pieces)

    return (
        F.when(low.rlike(year_first), low)
        .when(low.rlike(year_first_slash), F.translate(low, "/", "-"))
        .when(low.rlike(us_slash), joined(part(us_slash, 3), part(us_slash, 1), part(us_slash, 2)))
        .when(low.rlike(us_short), joined(F.concat(century, part(us_short, 3)), part(us_short, 1), part(us_short, 2)))
        .when(low.rlike(us_dash), joined(part(us_dash, 3), part(us_dash, 1), part(us_dash, 2)))
        .when(low.rlike(named_day), joined(part(named_day, 3), month(named_day, 1), part(named_day, 2)))
        .when(low.rlike(named_month), joined(part(named_month, 2), month(named_month, 1), F.lit("1")))
        .when(low.rlike(r"^\d{4}$"), joined(low, F.lit("1"), F.lit("1")))
        .when(low.rlike(day_named), joined(part(day_named, 3), month(day_named, 2), part(day_named, 1)))
        .when(low.rlike(compact), joined(part(compact, 1), part(compact, 2), part(compact, 3)))
    )


def _utc_moment(text):
    """UTC wall time of zoned text, whatever the session zone is."""
    return F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def _moment(raw):
    return F.when(raw.rlike(ISO_MOMENT), raw.try_cast("timestamp_ntz")).when(raw.rlike(ZONED_MOMENT), _utc_moment(raw))


def strict_date(column, data_type):
    """Calendar date in UTC. Whole numbers from 1900 to 2200 are years, other positive numbers are serial days."""
    if isinstance(data_type, T.DateType):
        return column
    if isinstance(data_type, T.TimestampNTZType):
        return column.cast("date")
    if isinstance(data_type, T.TimestampType):
        return F.to_utc_timestamp(column, F.current_timezone()).cast("timestamp_ntz").cast("date")
    if isinstance(data_type, T.NumericType):
        number = column.cast("double")
        usable = number.isNotNull()
        if isinstance(data_type, FLOATING):
            usable = usable & ~F.isnan(number)
        whole_year = (number == F.floor(number)) & number.between(FIRST_YEAR, LAST_YEAR)
        year = F.concat(F.when(whole_year, number.cast("int")).cast("string"), F.lit("-01-01")).try_cast("date")
        days = F.when(number.between(1, MAX_SERIAL), F.floor(number).cast("int"))
        serial = F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), days)
        return F.when(usable, F.coalesce(year, serial))
    if not is_text(data_type):
        return F.lit(None).cast("date")
    raw = strip(column)
    parsed = F.coalesce(_iso_text(raw).try_cast("date"), _moment(raw).cast("date"))
    return F.when(F.length(raw) <= MAX_TYPED_LENGTH, parsed)


def lenient_moment(column, data_type):
    """Wall-clock timestamp for aggregation. Numbers are never dates here; text that is no date gives null."""
    if isinstance(data_type, (T.DateType, T.TimestampNTZType)):
        return column.cast("timestamp_ntz")
    if isinstance(data_type, T.TimestampType):
        return F.to_utc_timestamp(column, F.current_timezone()).cast("timestamp_ntz")
    if not is_text(data_type):
        return F.lit(None).cast("timestamp_ntz")
    raw = strip(column)
    return F.coalesce(_moment(raw), _iso_text(raw).try_cast("date").cast("timestamp_ntz"))


def is_moment_type(data_type):
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def month_key(moment):
    return F.date_format(moment, "yyyy-MM")
