"""Typed row predicates: nested and/or groups compiled to one Boolean column.

A group is {"logic": "and"|"or", "clauses": [...]}; a clause is {"type": "predicate", "predicate": {...}} or
{"type": "group", ...}. A flat {"logic", "predicates": [...]} is accepted as well. A predicate names its columns, an
operator, its values, a quantifier over the columns (any, all, none) and whether a valid value is required.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import reduce
from operator import and_, or_

from pyspark.sql import functions as F

from rollbook.functions.emails import domain_matches, fold_domain, matching_emails, row_email_tokens
from rollbook.functions.dates import strict_date
from rollbook.functions.missing import NULLISH_TEXTS, as_text, collapse_blanks, is_blank, is_nullish, type_of
from rollbook.functions.numbers import MAX_TYPED_LENGTH, STRICT_SHAPE, strict_number
from rollbook.operators.columns import resolve_column
from rollbook.operators.sampling import col

NO_VALUE = frozenset(("exists", "missing"))
NUMERIC = frozenset(("greater_than", "greater_than_or_equal", "less_than", "less_than_or_equal", "between"))
DATED = frozenset(("date_before", "date_after", "date_between"))
MEMBERSHIP = frozenset(("in", "not_in"))
BOUNDARY = frozenset(("starts_with", "ends_with"))
DOMAIN = frozenset(("email_domain_in", "email_domain_not_in"))
TEXTUAL = frozenset(("equals", "not_equals", "contains", "not_contains")) | MEMBERSHIP | BOUNDARY
OPERATORS = NO_VALUE | NUMERIC | DATED | TEXTUAL | DOMAIN

EXACTLY_ONE = (NUMERIC | DATED | BOUNDARY) - {"between", "date_between"}
EXACTLY_TWO = frozenset(("between", "date_between"))
ALWAYS_VALID = NUMERIC | DATED | MEMBERSHIP | BOUNDARY | DOMAIN
VALID_BY_DEFAULT = ALWAYS_VALID | {"not_equals", "not_contains"}

QUANTIFIERS = ("any", "all", "none")
MAX_DEPTH, MAX_LEAVES, MAX_CLAUSES, MAX_VALUES, MAX_COLUMNS = 3, 12, 12, 20, 12
MAX_RELATIVE_DAYS = 36_600
ABSENT_VALUES = NULLISH_TEXTS + ("n/a", "na")


class PredicateError(ValueError):
    """The predicate tree is not well formed."""


def relative_boundary(days, now=None):
    """The date a number of days before now. It is a constant of the query, so reruns of a job agree."""
    if isinstance(days, bool) or not isinstance(days, int) or not 0 <= days <= MAX_RELATIVE_DAYS:
        raise PredicateError(f"Days must be a whole number from 0 to {MAX_RELATIVE_DAYS}.")
    today = now if now is not None else datetime.now(timezone.utc).date()
    return date_value(today) - timedelta(days=days)


def number_value(value):
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    text = str(value).strip()
    negative = text.startswith("(") and text.endswith(")")
    bare = (text[1:-1] if negative else text).replace("$", "").replace(",", "").strip()
    if len(text) > MAX_TYPED_LENGTH or not re.fullmatch(STRICT_SHAPE, bare):
        raise PredicateError(f"{value!r} is not a number.")
    return -float(bare) if negative else float(bare)


# Accepted forms of a date given as an operator value.
VALUE_DATE_FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m/%d/%y", "%m-%d-%Y", "%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y",
    "%B %Y", "%b %Y", "%Y",
)


def date_value(value):
    if isinstance(value, datetime):
        return (value.astimezone(timezone.utc) if value.tzinfo else value).date()
    if isinstance(value, date):
        return value
    for pattern in VALUE_DATE_FORMATS:
        try:
            return datetime.strptime(str(value).strip(), pattern).date()
        except ValueError:
            continue
    try:
        return date_value(datetime.fromisoformat(str(value).strip()))
    except ValueError:
        raise PredicateError(f"{value!r} is not a date.") from None


def _text_values(values):
    folded = (" ".join(str(value).split()).lower() for value in values if value is not None)
    return list(dict.fromkeys(text for text in folded if text not in ABSENT_VALUES))


def _typed_values(operator, values):
    if operator in NO_VALUE:
        if any(str(value).strip() for value in values if value is not None):
            raise PredicateError(f"'{operator}' takes no values.")
        return []
    if operator in EXACTLY_ONE and len(values) != 1:
        raise PredicateError(f"'{operator}' takes exactly one value.")
    if operator in EXACTLY_TWO and len(values) != 2:
        raise PredicateError(f"'{operator}' takes exactly two values.")
    if operator in NUMERIC or operator in DATED:
        typed = [number_value(v) if operator in NUMERIC else date_value(v) for v in values]
        if operator in EXACTLY_TWO and typed[0] > typed[1]:
            raise PredicateError("The lower bound exceeds the upper bound.")
        return typed
    typed = [d for d in map(fold_domain, values) if d] if operator in DOMAIN else _text_values(values)
    if not typed:
        raise PredicateError(f"'{operator}' needs at least one value.")
    return typed


def normalise_predicate(predicate, columns=None):
    """Check one predicate and fill in its defaults."""
    if not isinstance(predicate, dict):
        raise PredicateError("A predicate must be a dict.")
    operator = str(predicate.get("operator") or "").lower()
    if operator not in OPERATORS:
        raise PredicateError(f"Unknown predicate operator '{operator or 'missing'}'.")
    quantifier = str(predicate.get("quantifier") or "any").lower()
    if quantifier not in QUANTIFIERS:
        raise PredicateError(f"Unknown quantifier '{quantifier}'.")
    names = list(predicate.get("columns") or predicate.get("resolved_columns") or [])
    if not 1 <= len(names) <= MAX_COLUMNS:
        raise PredicateError(f"A predicate needs 1 to {MAX_COLUMNS} columns.")
    unknown = [name for name in names if columns is not None and name not in columns]
    if unknown:
        raise PredicateError(f"Unknown columns: {', '.join(unknown)}.")
    values = predicate.get("values")
    if values is None and predicate.get("value") is not None:
        values = [predicate["value"]]
    values = list(values or [])
    if len(values) > MAX_VALUES:
        raise PredicateError(f"At most {MAX_VALUES} values are allowed.")
    required = operator in ALWAYS_VALID or bool(predicate.get("require_valid_value", operator in VALID_BY_DEFAULT))
    return {
        "operator": operator,
        "columns": names,
        "values": _typed_values(operator, values),
        "quantifier": quantifier,
        "require_valid_value": required and operator not in NO_VALUE,
        "include_subdomains": bool(predicate.get("include_subdomains", True)),
        "lower_inclusive": bool(predicate.get("lower_inclusive", True)),
        "upper_inclusive": bool(predicate.get("upper_inclusive", True)),
    }


def normalise_group(group, columns=None):
    """Check a predicate tree and return it with normalised predicates. Nothing runs."""
    leaves = 0

    def visit(node, depth):
        nonlocal leaves
        if not isinstance(node, dict):
            raise PredicateError("A predicate group must be a dict.")
        if depth > MAX_DEPTH:
            raise PredicateError(f"Groups may be nested at most {MAX_DEPTH} levels.")
        logic = str(node.get("logic") or "and").lower()
        if logic not in ("and", "or"):
            raise PredicateError(f"Unknown logic '{logic}'.")
        clauses = node.get("clauses")
        if clauses is None:
            clauses = [{"type": "predicate", "predicate": p} for p in node.get("predicates") or []]
        if not isinstance(clauses, list) or len(clauses) > MAX_CLAUSES:
            raise PredicateError(f"A group takes a list of at most {MAX_CLAUSES} clauses.")
        checked = []
        for clause in clauses:
            kind = clause.get("type") if isinstance(clause, dict) else None
            if kind == "group":
                checked.append({"type": "group", **visit(clause, depth + 1)})
            elif kind == "predicate":
                leaves += 1
                if leaves > MAX_LEAVES:
                    raise PredicateError(f"At most {MAX_LEAVES} predicates are allowed.")
                checked.append({"type": "predicate", "predicate": normalise_predicate(clause.get("predicate"), columns)})
            else:
                raise PredicateError(f"Unknown clause type '{kind}'.")
        return {"logic": logic, "clauses": checked}

    return visit(group, 1)


def group_leaves(group):
    leaves = []
    for clause in group["clauses"]:
        leaves.extend([clause["predicate"]] if clause["type"] == "predicate" else group_leaves(clause))
    return leaves


def group_depth(group):
    """Levels of groups that hold a predicate."""
    if not group_leaves(group):
        return 0
    return 1 + max((group_depth(c) for c in group["clauses"] if c["type"] == "group"), default=0)


def _bounded(value, lower, upper, predicate):
    low = value >= F.lit(lower) if predicate["lower_inclusive"] else value > F.lit(lower)
    high = value <= F.lit(upper) if predicate["upper_inclusive"] else value < F.lit(upper)
    return low & high


def _outcome(column, data_type, predicate):
    """True or false for a usable cell, null for one that is absent or does not parse."""
    operator, values = predicate["operator"], predicate["values"]
    if operator in NO_VALUE:
        missing = is_nullish(column, data_type)
        return missing if operator == "missing" else ~missing
    if operator in NUMERIC or operator in DATED:
        parse = strict_number if operator in NUMERIC else strict_date
        value = parse(column, data_type)
        first = F.lit(values[0])
        return {
            "greater_than": lambda: value > first,
            "greater_than_or_equal": lambda: value >= first,
            "less_than": lambda: value < first,
            "less_than_or_equal": lambda: value <= first,
            "date_after": lambda: value > first,
            "date_before": lambda: value < first,
            "between": lambda: _bounded(value, *values, predicate),
            "date_between": lambda: _bounded(value, *values, predicate),
        }[operator]()
    folded = F.lower(collapse_blanks(as_text(column, data_type)))
    text = F.when(folded != "", folded)
    if operator in ("contains", "not_contains"):
        test = reduce(or_, (text.contains(value) for value in values))
    elif operator == "starts_with":
        test = text.startswith(values[0])
    elif operator == "ends_with":
        test = text.endswith(values[0])
    else:
        test = text.isin(*values)
    return ~test if operator in ("not_equals", "not_contains", "not_in") else test


def quantify(outcomes, quantifier="any", required=False):
    """Combine outcomes of several cells. Null outcomes take no part; "all" never holds without an outcome."""
    anything = reduce(or_, (F.coalesce(o, F.lit(False)) for o in outcomes))
    if quantifier == "any":
        return anything
    present = reduce(or_, (o.isNotNull() for o in outcomes))
    if quantifier == "all":
        return present & reduce(and_, (F.coalesce(o, F.lit(True)) for o in outcomes))
    return present & ~anything if required else ~anything


def _cells(df, predicate):
    return [(col(name), type_of(df, name)) for name in predicate["columns"]]


def _domain_condition(df, predicate):
    tokens = row_email_tokens(_cells(df, predicate))

    def hit(token):
        inside = domain_matches(token["domain"], predicate["values"], predicate["include_subdomains"])
        return ~inside if predicate["operator"] == "email_domain_not_in" else inside

    some = F.size(tokens) > 0
    if predicate["quantifier"] == "any":
        return F.exists(tokens, hit)
    if predicate["quantifier"] == "all":
        return some & F.forall(tokens, hit)
    return some & ~F.exists(tokens, hit)


def compile_predicate(df, predicate):
    """One normalised predicate as a Boolean column that is never null."""
    if predicate["operator"] in DOMAIN:
        return _domain_condition(df, predicate)
    outcomes = [_outcome(column, data_type, predicate) for column, data_type in _cells(df, predicate)]
    return quantify(outcomes, predicate["quantifier"], predicate["require_valid_value"])


def compile_group(df, group):
    """A checked or raw predicate tree as one Boolean column; an empty group is true."""
    checked = normalise_group(group, df.columns)

    def visit(node):
        tests = [
            compile_predicate(df, c["predicate"]) if c["type"] == "predicate" else visit(c) for c in node["clauses"]
        ]
        return reduce(or_ if node["logic"] == "or" else and_, tests) if tests else F.lit(True)

    return visit(checked)


def matching_email(df, group):
    """Addresses that show why a row meets its e-mail predicates, joined by "; "; None without such predicates."""
    predicates = [p for p in group_leaves(normalise_group(group, df.columns)) if p["operator"] in DOMAIN]
    if not predicates:
        return None
    found = [
        matching_emails(
            row_email_tokens(_cells(df, p)),
            p["values"],
            negated=p["operator"] == "email_domain_not_in",
            quantifier=p["quantifier"],
            include_subdomains=p["include_subdomains"],
        )
        for p in predicates
    ]
    merged = F.concat(*found) if len(found) > 1 else found[0]
    return F.array_join(F.array_distinct(merged), "; ")


def filter_predicates(df, group, base_filter=None, columns=None):
    """Rows that satisfy the tree, with "Matching Email" where e-mail predicates are involved.

    base_filter is an optional function from DataFrame to DataFrame that narrows the rows further.
    """
    emails = matching_email(df, group)
    rows = df.filter(compile_group(df, group))
    if emails is not None:
        rows = rows.withColumn("Matching Email", emails)
    if base_filter is not None:
        rows = base_filter(rows)
    if columns:
        shown = list(columns) + (["Matching Email"] if emails is not None and "Matching Email" not in columns else [])
        rows = rows.select(*(col(name) for name in shown))
    return rows


def _failure_counters(df, leaves):
    def failures(operators, parse):
        tests = [
            F.when(~is_nullish(c, t) & parse(c, t).isNull(), 1).otherwise(0)
            for p in leaves if p["operator"] in operators
            for c, t in _cells(df, p)
        ]
        total = F.sum(reduce(lambda a, b: a + b, tests)) if tests else F.lit(0)
        return F.coalesce(total, F.lit(0)).cast("long")

    return (
        failures(NUMERIC, strict_number).alias("numeric_parse_failure_count"),
        failures(DATED, strict_date).alias("date_parse_failure_count"),
    )


def parse_failures(df, group):
    """One row: cells that are filled in but do not parse, for the numeric and the date predicates."""
    return df.agg(*_failure_counters(df, group_leaves(normalise_group(group, df.columns))))


def _invalid_email_counter(df, columns):
    cells = [(col(name), type_of(df, name)) for name in columns]
    filled = reduce(or_, (~is_blank(c, t) for c, t in cells))
    broken = filled & (F.size(row_email_tokens(cells)) == 0)
    return F.count(F.when(broken, 1)).alias("invalid_email_row_count")


def invalid_email_rows(df, columns):
    """One row: how many rows have something in these columns but no address."""
    return df.agg(_invalid_email_counter(df, columns))


def predicate_metrics(df, group):
    """One row of counts for a predicate filter, all from one pass."""
    checked = normalise_group(group, df.columns)
    leaves = group_leaves(checked)
    email_columns = list(dict.fromkeys(c for p in leaves if p["operator"] in DOMAIN for c in p["columns"]))
    counters = [
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(compile_group(df, checked), 1)).alias("matched_row_count"),
        *_failure_counters(df, leaves),
    ]
    if email_columns:
        counters.append(_invalid_email_counter(df, email_columns))
    return df.agg(*counters).withColumns(
        {"predicate_count": F.lit(len(leaves)), "predicate_group_depth": F.lit(group_depth(checked))}
    )


def filter_spec(df, spec):
    """Free filter: {"all": [...]}, {"any": [...]}, {"not": ...} or one predicate given as {"op", "column", "value"}.

    Columns may be named by any header alias; without one the predicate is about the e-mail column.
    """
    return df.filter(compile_spec(df, spec))


def compile_spec(df, spec):
    if not isinstance(spec, dict):
        raise PredicateError("A filter spec must be a dict.")
    for key, combine in (("all", and_), ("any", or_)):
        if key in spec:
            parts = [compile_spec(df, child) for child in spec[key]]
            return reduce(combine, parts) if parts else F.lit(True)
    if "not" in spec:
        return ~compile_spec(df, spec["not"])
    operator = str(spec.get("op") or "equals").lower()
    if operator == "not_missing":
        operator = "exists"
    values = spec.get("values", spec.get("value"))
    named = spec.get("columns") or spec.get("column") or "email"
    named = [named] if isinstance(named, str) else list(named)
    predicate = {
        **{k: v for k, v in spec.items() if k not in ("op", "column", "columns", "value")},
        "operator": operator,
        "columns": [resolve_column(df.columns, name) for name in named],
        "values": values if isinstance(values, list) else [] if values is None else [values],
        "require_valid_value": bool(spec.get("require_valid_value", operator not in NO_VALUE)),
    }
    return compile_predicate(df, normalise_predicate(predicate, df.columns))
