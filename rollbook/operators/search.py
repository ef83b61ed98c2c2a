"""Row filters by value, blank, date range and substring; substring search reports what matched where."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from rollbook.functions.dates import lenient_moment
from rollbook.functions.missing import as_text, is_blank, is_text, type_of
from rollbook.operators.columns import resolve_column, searchable_columns
from rollbook.operators.predicates import date_value
from rollbook.operators.sampling import col

REASON = "MATCH REASON"
HIT_TYPE = "array<struct<column:string,term:string,value:string>>"


def filter_equals(df, column, value, case_sensitive=False):
    """Text compares as text, ignoring case unless told otherwise, with null as empty text; other types compare typed."""
    name = resolve_column(df.columns, column)
    if not is_text(type_of(df, name)):
        return df.filter(col(name) == F.lit(value))
    wanted = "" if value is None else str(value)
    cell = F.coalesce(col(name), F.lit("")) if wanted == "" else col(name)
    return df.filter(cell == wanted if case_sensitive else F.lower(cell) == wanted.lower())


def filter_missing(df, column):
    name = resolve_column(df.columns, column)
    return df.filter(is_blank(col(name), type_of(df, name)))


def date_range_filter(df, column, start=None, end=None):
    """Rows dated from start to end, both included; either may be left out. Every cell of a text column is parsed."""
    if start is None and end is None:
        raise ValueError("Give a start or an end date.")
    name = resolve_column(df.columns, column)
    data_type = type_of(df, name)
    # A date or timestamp column is compared as it is, so that the filter reaches the scan.
    moment = lenient_moment(col(name), data_type) if is_text(data_type) else col(name)
    kind = "timestamp_ntz" if is_text(data_type) else data_type.simpleString()

    def bound(value):
        return F.lit(str(value) if " " in str(value) or "T" in str(value) else str(date_value(value))).cast(kind)

    rows = df
    if start is not None:
        rows = rows.filter(moment >= bound(start))
    if end is not None:
        rows = rows.filter(moment <= bound(end))
    return rows


@dataclass(frozen=True)
class SearchGroup:
    """Terms looked for in some columns; the first column that contains a term is its hit."""

    columns: tuple
    terms: tuple


def search_groups(df, columns=None, terms=(), groups=None):
    """Column and term groups of a search; without groups one group of all columns and terms."""

    def clean(values):
        texts = [values] if isinstance(values, str) else list(values or [])
        return tuple(str(term).strip() for term in texts if str(term).strip())

    raw = groups if groups else [{"columns": columns, "terms": terms}]
    found = [
        SearchGroup(tuple(searchable_columns(df, group.get("columns"))), clean(group.get("terms")))
        for group in raw if clean(group.get("terms"))
    ]
    if not found:
        raise ValueError("At least one search term is required.")
    return found


def _haystacks(df, groups, case_sensitive):
    """Searched text per column; blank cells have none."""
    cells = {}
    for name in dict.fromkeys(name for group in groups for name in group.columns):
        data_type = type_of(df, name)
        text = as_text(col(name), data_type)
        cells[name] = (text if case_sensitive else F.lower(text), F.when(~is_blank(col(name), data_type), text))
    return cells


def _needle(term, case_sensitive):
    return term if case_sensitive else term.lower()


def match_condition(df, groups, case_sensitive=False, require_all=False):
    """Whether a row matches, without collecting evidence."""
    cells = _haystacks(df, groups, case_sensitive)
    by_term = {}
    for group in groups:
        for term in group.terms:
            tests = [F.coalesce(cells[name][0].contains(_needle(term, case_sensitive)), F.lit(False)) for name in group.columns]
            by_term.setdefault(term, []).extend(tests)
    hits = [reduce(or_, tests) for tests in by_term.values()]
    return reduce(lambda a, b: a & b if require_all else a | b, hits)


def match_hits(df, groups, case_sensitive=False):
    """Array of (column, term, value): per group and term the first column that contains it."""
    cells = _haystacks(df, groups, case_sensitive)

    def hit(name, term):
        evidence = F.struct(F.lit(name).alias("column"), F.lit(term).alias("term"), cells[name][1].alias("value"))
        return F.when(cells[name][0].contains(_needle(term, case_sensitive)), evidence)

    found = [
        F.coalesce(*(hit(name, term) for name in group.columns)) for group in groups for term in group.terms
    ]
    return F.array_compact(F.array(*found))


def search(df, columns=None, terms=(), groups=None, case_sensitive=False, require_all=False, evidence=True):
    """Rows containing any (or all) terms as substrings, with matched_column, matched_term and all reasons.

    With require_all every distinct term must occur somewhere in its groups.
    """
    plan = search_groups(df, columns, terms, groups)
    rows = df.filter(match_condition(df, plan, case_sensitive, require_all))
    if not evidence:
        return rows
    kept = df.columns
    rows = rows.withColumn("_hits", match_hits(df, plan, case_sensitive))

    def joined(field):
        return F.array_join(F.array_distinct(F.col("_hits")[field]), ", ")

    reasons = F.array_distinct(
        F.transform("_hits", lambda h: F.concat(F.lit("Matched "), h["column"], F.lit(": "), h["value"]))
    )
    return rows.select(
        *(col(name) for name in kept),
        joined("column").alias("matched_column"),
        joined("term").alias("matched_term"),
        F.array_join(reasons, "; ").alias(REASON),
    )


def filter_contains(df, columns=None, terms=(), case_sensitive=False):
    return search(df, columns, terms, case_sensitive=case_sensitive)


def search_text(df, columns=None, terms=(), require_all=False, case_sensitive=False):
    return search(df, columns, terms, case_sensitive=case_sensitive, require_all=require_all)


def contains_any(df, columns=None, terms=(), groups=None, case_sensitive=False):
    return search(df, columns, terms, groups, case_sensitive)


def contains_all(df, columns=None, terms=(), groups=None, case_sensitive=False):
    return search(df, columns, terms, groups, case_sensitive, require_all=True)


def search_metrics(df, columns=None, terms=(), groups=None, case_sensitive=False, require_all=False, limit=None):
    """One row: rows searched, raw hits and rows matched, rows returned under the limit, and whether hits collapsed."""
    plan = search_groups(df, columns, terms, groups)
    matched = match_condition(df, plan, case_sensitive, require_all)
    hits = F.size(match_hits(df, plan, case_sensitive))
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.sum(F.when(matched, hits)), F.lit(0)).alias("raw_match_count"),
        F.count(F.when(matched, 1)).alias("matched_row_count"),
    )
    returned = F.col("matched_row_count")
    if limit is not None:
        returned = F.least(returned, F.lit(limit).cast("long"))
    return counted.select(
        "*",
        returned.alias("returned_row_count"),
        (F.col("raw_match_count") != F.col("matched_row_count")).alias("deduplicated"),
    )
