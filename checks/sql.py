"""SQL fragments of the oracles: parsers and text forms, written for DuckDB."""

from __future__ import annotations

WS = r"' \t\n\r'"
DATE_FORMATS = [
    "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m/%d/%y", "%m-%d-%Y", "%B %d, %Y", "%B %d %Y", "%b %d, %Y", "%b %d %Y",
    "%Y-%m-%d %H:%M:%S",
]


def blank(x):
    return f"({x} IS NULL OR trim({x}) = '')"


def nullish(x):
    return f"({x} IS NULL OR lower(trim({x})) IN ('', 'nan', 'none', 'null', 'nat'))"


def lenient(x):
    bare = f"trim(replace(replace(replace({x}, '$', ''), ',', ''), '%', ''))"
    shape = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return f"(CASE WHEN regexp_matches({bare}, '{shape}') THEN try_cast({bare} AS DOUBLE) END)"


def strict(x):
    t = f"trim({x})"
    inner = f"(CASE WHEN {t} LIKE '(%' AND {t} LIKE '%)' THEN '-' || trim(substr({t}, 2, length({t}) - 2)) ELSE {t} END)"
    bare = f"replace(replace(replace({inner}, '$', ''), ',', ''), ' ', '')"
    shape = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
    return f"(CASE WHEN regexp_matches({bare}, '{shape}') THEN try_cast({bare} AS DOUBLE) END)"


def moment(x):
    formats = ", ".join(f"'{f}'" for f in DATE_FORMATS)
    month = f"try_strptime('1 ' || trim({x}), ['%d %B %Y', '%d %b %Y'])"
    year = f"CASE WHEN regexp_matches(trim({x}), '^\\d{{4}}$') THEN try_strptime(trim({x}) || '-01-01', '%Y-%m-%d') END"
    short = f"CASE WHEN regexp_matches(trim({x}), '/\\d\\d$') THEN try_strptime(trim({x}), '%m/%d/%y') END"
    return f"coalesce({year}, {short}, try_strptime(trim({x}), [{formats}]), {month})"


def day(x):
    return f"cast({moment(x)} AS DATE)"


def member(x):
    return f"nullif(lower(regexp_replace(trim({x}), '\\s+', ' ', 'g')), '')"


def compact(x):
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def norm(x, keep="a-z0-9"):
    return f"trim(regexp_replace(lower({x}), '[^{keep}]+', ' ', 'g'))"


def emails(x):
    """Addresses of one cell as a list. The generated cells need no look-behind."""
    local = "[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+"
    domain = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,63}"
    found = f"regexp_extract_all(replace(coalesce({x}, ''), '|', ' '), '{local}@{domain}')"
    lowered = f"list_transform({found}, lambda e: split_part(e, '@', 1) || '@' || lower(split_part(e, '@', 2)))"
    return f"list_filter({lowered}, lambda e: e NOT LIKE '.%' AND e NOT LIKE '%.@%' AND e NOT LIKE '%..%')"


def has(x, terms):
    """Word-or-phrase test on the normal form that keeps "&"."""
    words = [t for t in terms if " " not in t]
    phrases = [t for t in terms if " " in t]
    parts = ([rf"\b(?:{'|'.join(words)})\b"] if words else []) + phrases
    return f"coalesce(regexp_matches({x}, '{'|'.join(parts)}'), false)" if parts else "false"
