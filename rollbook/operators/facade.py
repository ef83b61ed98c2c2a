"""The closed set of named operations, run from a plain {"type", "params"} description."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from rollbook.operators import aggregate, columns, order, predicates, profile, search
from rollbook.operators.columns import resolve_columns
from rollbook.operators.sampling import col
from rollbook.plans import people
from rollbook.plans.classify import QuerySpec
from rollbook.sources.files import ROW_ID


@dataclass(frozen=True)
class OpResult:
    """Result rows and a one-row table of counts; neither is computed before it is asked for."""

    rows: DataFrame
    metrics: DataFrame | None = None


def _limited(rows, limit):
    """The first rows by row id, or by all cells where there is none."""
    if limit is None:
        return rows
    order = [ROW_ID] if ROW_ID in rows.columns else rows.columns
    return rows.orderBy(*(col(c) for c in order)).limit(limit)


def _search(df, p, require_all=False):
    options = {
        "columns": p.get("columns") or p.get("column"),
        "terms": p.get("terms") or [p[k] for k in ("term", "query", "text") if p.get(k)],
        "groups": p.get("column_term_groups"),
        "case_sensitive": bool(p.get("case_sensitive", False)),
        "require_all": require_all,
    }
    return OpResult(_limited(search.search(df, **options), p.get("limit")), search.search_metrics(df, **options, limit=p.get("limit")))


def _spec(p):
    wanted = p.get("people_filter") or {}
    kind = wanted.get("filter_type") or "industry"
    if kind == "employer":
        return QuerySpec(employers=tuple(wanted["employer_terms"]))
    if kind == "occupation":
        return QuerySpec(titles=tuple(wanted["occupation_terms"]))
    industries = wanted.get("industries") or [wanted.get("industry") or "tech"]
    return QuerySpec(
        industries=tuple(industries),
        required=tuple(wanted.get("required_industries") or ()),
        excluded=tuple(wanted.get("excluded_industries") or ()),
        functions=tuple(wanted.get("include_functions") or ()),
        excluded_functions=tuple(wanted.get("excluded_functions") or ()),
        include_adjacent=bool(wanted.get("include_adjacent")),
        scope=wanted.get("query_scope") or "industry",
    )


def _named(p):
    return p.get("return_columns") or p.get("display_columns")


def _contains_any(df, p):
    if p.get("filter_mode") in ("people", "tech_people"):
        rows = _limited(people.people_filter(df, _spec(p), columns=_named(p)), p.get("limit"))
        return OpResult(rows, people.people_metrics(df, _spec(p)))
    return _search(df, p)


def _group(p):
    if isinstance(p.get("predicate_group"), dict):
        return p["predicate_group"]
    return {k: p[k] for k in ("logic", "clauses", "predicates") if k in p}


def _predicates(df, p):
    base = p.get("base_filter")
    narrow = (lambda rows: run(rows, base).rows) if base else None
    rows = predicates.filter_predicates(df, _group(p), narrow)
    sort = p.get("sort")
    if sort:
        ascending = str(sort.get("direction") or "desc").lower().startswith("asc")
        rows = order.sort_rows(rows, sort["column"], ascending, p.get("limit"))
    else:
        rows = _limited(rows, p.get("limit"))
    return OpResult(rows, predicates.predicate_metrics(df, _group(p)))


def _composite(df, p):
    inner = p["people_operation"]["params"]
    args = (df, _spec(inner), _group(p), p.get("constraint_logic") or "and")
    shown = {"columns": _named(p), "sort": p.get("sort"), "limit": p.get("limit")}
    return OpResult(people.composite_filter(*args, **shown), people.composite_metrics(*args))


OPERATIONS = {
    "preview": lambda df, p: OpResult(columns.preview(df, p.get("limit") or 20)),
    "select_columns": lambda df, p: OpResult(columns.select_columns(df, p.get("columns"), p.get("limit"))),
    "filter_equals": lambda df, p: OpResult(
        _limited(search.filter_equals(df, p["column"], p.get("value"), bool(p.get("case_sensitive", False))), p.get("limit"))
    ),
    "filter_missing": lambda df, p: OpResult(_limited(search.filter_missing(df, p["column"]), p.get("limit"))),
    "filter_contains": _search,
    "filter_predicates": _predicates,
    "composite_people_filter": _composite,
    "search_text": lambda df, p: _search(df, p, bool(p.get("require_all", False))),
    "contains_any": _contains_any,
    "contains_all": lambda df, p: _search(df, p, True),
    "sort_rows": lambda df, p: OpResult(order.sort_rows(df, p["column"], bool(p.get("ascending", True)), p.get("limit"))),
    "top_n": lambda df, p: OpResult(order.top_n(df, p["column"], p.get("n", 10))),
    "bottom_n": lambda df, p: OpResult(order.bottom_n(df, p["column"], p.get("n", 10))),
    "group_by_count": lambda df, p: OpResult(aggregate.group_by_count(df, p["group_by"], p.get("limit"))),
    "group_by_sum": lambda df, p: OpResult(
        aggregate.group_by_sum(df, p["group_by"], p["value_column"], p.get("limit")),
        aggregate.group_by_metrics(df, p["value_column"]),
    ),
    "group_by_average": lambda df, p: OpResult(
        aggregate.group_by_average(df, p["group_by"], p["value_column"], p.get("limit")),
        aggregate.group_by_metrics(df, p["value_column"]),
    ),
    "value_counts": lambda df, p: OpResult(aggregate.value_counts(df, p["column"], p.get("limit"))),
    "missing_values": lambda df, p: OpResult(profile.missing_values(df, p.get("columns"))),
    "column_summary": lambda df, p: OpResult(profile.column_summary(df, p.get("columns"))),
    "numeric_summary": lambda df, p: OpResult(profile.numeric_summary(df, p.get("columns"))),
    "correlation": lambda df, p: OpResult(aggregate.correlation(df, p.get("columns"), p.get("limit"))),
    "unique_values": lambda df, p: OpResult(
        aggregate.unique_values(df, p["column"], p.get("limit")), aggregate.unique_metrics(df, p["column"])
    ),
    "duplicate_rows": lambda df, p: OpResult(
        order.duplicate_rows(df, p.get("subset"), p.get("limit")), order.duplicate_metrics(df, p.get("subset"))
    ),
    "date_summary": lambda df, p: OpResult(profile.date_summary(df, p.get("columns"))),
    "date_range_filter": lambda df, p: OpResult(
        _limited(search.date_range_filter(df, p["column"], p.get("start"), p.get("end")), p.get("limit"))
    ),
    "group_by_month": lambda df, p: OpResult(
        aggregate.group_by_month(
            df, p["date_column"], p.get("value_column"), str(p.get("aggregation") or "count").lower(), p.get("limit")
        )
    ),
}


#: Parameters of each operation; an unknown one raises.
_SEARCH = "columns column terms term query text column_term_groups case_sensitive limit return_columns display_columns"
_PREDICATES = "predicate_group logic clauses predicates sort limit return_columns display_columns"
PARAMETERS = {
    "preview": "limit", "select_columns": "columns limit",
    "filter_equals": "column value case_sensitive limit return_columns display_columns",
    "filter_missing": "column limit return_columns display_columns",
    "filter_contains": _SEARCH, "search_text": f"{_SEARCH} require_all", "contains_all": _SEARCH,
    "contains_any": f"{_SEARCH} filter_mode people_filter",
    "filter_predicates": f"{_PREDICATES} base_filter",
    "composite_people_filter": f"{_PREDICATES} people_operation constraint_logic",
    "sort_rows": "column ascending limit return_columns display_columns",
    "top_n": "column n return_columns display_columns", "bottom_n": "column n return_columns display_columns",
    "group_by_count": "group_by limit", "group_by_sum": "group_by value_column limit", "group_by_average": "group_by value_column limit",
    "value_counts": "column limit", "unique_values": "column limit", "missing_values": "columns", "column_summary": "columns",
    "numeric_summary": "columns", "correlation": "columns limit", "date_summary": "columns",
    "duplicate_rows": "subset limit return_columns display_columns",
    "date_range_filter": "column start end limit return_columns display_columns",
    "group_by_month": "date_column value_column aggregation limit",
}


def _projected(rows, p):
    """The named columns of a row result, with what the operation itself adds (evidence, matching addresses)."""
    wanted = resolve_columns(rows.columns, _named(p))
    if not wanted:
        return rows
    added = [c for c in rows.columns if c in ADDED and c not in wanted]
    return rows.select(*(col(c) for c in [*wanted, *added]))


ADDED = ("matched_column", "matched_term", search.REASON, "Matching Email")


def run(df, operation):
    """Run one named operation. Unknown names, parameters and columns raise ValueError before anything is computed."""
    kind = operation.get("type")
    if kind not in OPERATIONS:
        raise ValueError(f"Unknown operation type '{kind}'.")
    params = operation.get("params") or {}
    if not isinstance(params, dict):
        raise ValueError("Operation params must be a dict.")
    unknown = sorted(set(params) - set(PARAMETERS[kind].split()))
    if unknown:
        raise ValueError(f"Operation '{kind}' has no parameter {', '.join(map(repr, unknown))}.")
    try:
        result = OPERATIONS[kind](df, params)
    except KeyError as missing:
        raise ValueError(f"Operation '{kind}' needs the parameter {missing}.") from None
    people_rows = kind == "composite_people_filter" or params.get("filter_mode") in ("people", "tech_people")
    if _named(params) and not people_rows:  # people filters choose their columns themselves
        return OpResult(_projected(result.rows, params), result.metrics)
    return result
