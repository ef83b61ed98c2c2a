"""Dates in free form: a grammar over the tokens of a text, for what the fixed shapes of dates.py leave over.

A text is a date if every token has one meaning and day, month and year come together: a month by name or number, a year of four
digits or behind an apostrophe or at the end, a day, and at will a weekday, a time and a zone. Texts of numbers alone are read
month first, or day first where the first number is no month. The parser sees each distinct text of a batch once.
"""

from __future__ import annotations

import datetime
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.dates import strict_date
from rollbook.functions.missing import is_text, strip
from rollbook.functions.numbers import MAX_TYPED_LENGTH

MONTHS = {name[:3]: k + 1 for k, name in enumerate("january february march april may june july august september october november december".split())}
_FULL_MONTHS = "january february march april may june july august september october november december sept".split()
_WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_WEEKDAY_SHORT = {name[:k] for name in _WEEKDAYS for k in (3, 4, 5)}
_FILLERS = {"of", "the", "on", "at", "and"}

_TOKEN = re.compile(
    r"(?P<time>\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[ap]\.?m\.?)?(?:\s*(?:z|utc|gmt|[+-]\d{2}:?\d{2})(?![\w:]))?|\d{1,2}\s*[ap]\.?m\.?(?![a-z]))"
    r"|(?P<ordinal>\d{1,2}(?:st|nd|rd|th)(?![a-z]))"
    r"|(?P<short>'\d{2}(?!\d))"
    r"|(?P<number>\d+)"
    r"|(?P<word>[a-z]+)\.?"
    r"|(?P<gap>[\s,./-]+|t(?=\d))",
)


def _meaning(kind, token):
    """The kinds of a word or number: month, day, year, or None where it has none."""
    if kind == "word":
        if token in _FULL_MONTHS or token in MONTHS:
            return "month", MONTHS[token[:3]]
        if token in _WEEKDAYS or token in _WEEKDAY_SHORT:
            return "weekday", None
        return ("filler", None) if token in _FILLERS else None
    if kind == "ordinal":
        return "day", int(token[:-2])
    if kind == "short":
        return "year", _century(int(token[1:]))
    if kind == "number":
        if len(token) == 8:
            return "whole", (int(token[:4]), int(token[4:6]), int(token[6:]))
        if len(token) == 4:
            return "year", int(token)
        return ("number", int(token)) if len(token) <= 2 else None
    return None


def _century(year):
    return 1900 + year if year >= 69 else 2000 + year


def parse_free_date(text):
    """The date a text says, or None. A month and a year alone mean the first day of the month."""
    low, at, found = text.strip().lower(), 0, {}
    numbers, first_year = [], False
    times = weekdays = 0
    while at < len(low):
        m = _TOKEN.match(low, at)
        if not m:
            return None
        kind, at = m.lastgroup, m.end()
        if kind == "gap":
            continue
        if kind == "time":
            times += 1
            if times > 1 or not _is_time(m.group()):
                return None
            continue
        meaning = _meaning(kind, m.group().rstrip("."))
        if meaning is None:
            return None
        what, value = meaning
        if what == "weekday":
            weekdays += 1
        elif what == "number":
            numbers.append(value)
        elif what == "whole":
            found |= dict(zip(("year", "month", "day"), value)) if not found else {"clash": 1}
        elif what != "filler":
            if what in found:
                return None
            first_year |= what == "year" and not numbers and "month" not in found and "day" not in found
            found[what] = value
    if weekdays > 1 or "clash" in found:
        return None
    missing = [k for k in ("month", "day", "year") if k not in found]
    if first_year and missing == ["month", "day"] and len(numbers) == 2:
        order = ["month", "day"]
    elif "month" not in missing:
        order = missing
    else:
        order = ["day", "month", *missing[2:]] if missing[:2] == ["month", "day"] and numbers and numbers[0] > 12 else missing
    if len(numbers) == len(order):
        for k, value in zip(order, numbers):
            found[k] = _century(value) if k == "year" else value
    elif not (not numbers and order == ["day"]):
        return None
    try:
        return datetime.date(found["year"], found["month"], found.get("day", 1))
    except (KeyError, ValueError):
        return None


def _is_time(text):
    hour, *rest = map(int, re.findall(r"\d+", text)[:3])
    half = re.search(r"[ap]\.?m\.?", text) is not None
    return (1 <= hour <= 12 if half else hour < 24) and all(x < 60 for x in rest)


def _parsed(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.dictionary_encode()
    found = pa.array([parse_free_date(t) if t else None for t in texts.dictionary.to_pylist()], pa.date32())
    return found.take(texts.indices)


def strict_date_free(column, data_type):
    """strict_date(), and for texts that have none of its shapes the date they say in free form. Only those reach the parser."""
    known = strict_date(column, data_type)
    if not is_text(data_type):
        return known
    raw = strip(column)
    left = F.when(known.isNull() & (F.length(raw).between(4, MAX_TYPED_LENGTH)) & raw.rlike(r"\d"), raw)
    return F.coalesce(known, F.arrow_udf(_parsed, T.DateType())(left))
