"""E-mail addresses in free cells, and domain tests at label boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions.missing import NULLISH_TEXTS, as_text, is_text, strip

# The accepted address shape and its length limits.
LOCAL_CLASS = r"A-Za-z0-9.!#$%&'*+/=?^_`{|}~-"
ADDRESS = (
    rf"(?<![{LOCAL_CLASS}])([{LOCAL_CLASS}]+)@"
    r"((?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63})(?![A-Za-z0-9-])"
)
MAX_LOCAL, MAX_DOMAIN = 64, 253
WELL_FORMED = rf"^(?!\.)(?!.*\.\.)(?!.*\.@)[^@]{{1,{MAX_LOCAL}}}@.{{1,{MAX_DOMAIN}}}$"

TOKEN_TYPE = "array<struct<address:string,domain:string,original:string>>"


def _empty():
    return F.array().cast(TOKEN_TYPE)


def _distinct_by_address(tokens):
    """Keep the first token of each address, ignoring case."""
    keys = F.transform(tokens, lambda token: F.lower(token["address"]))
    return F.filter(tokens, lambda token, i: F.array_position(keys, F.lower(token["address"])) == i + 1)


def email_tokens(column, data_type=None):
    """Array of (address, domain, original) found in one cell; empty when there is none."""
    cell = column if data_type is None or is_text(data_type) else as_text(column, data_type)
    text = F.translate(strip(cell), "|", " ")
    raw = F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0))

    def token(match):
        domain = F.lower(F.substring_index(match, "@", -1))
        local = F.substring_index(match, "@", 1)
        return F.struct(F.concat(local, F.lit("@"), domain).alias("address"), domain.alias("domain"), match.alias("original"))

    found = _distinct_by_address(F.transform(F.filter(raw, lambda match: match.rlike(WELL_FORMED)), token))
    return F.when(cell.contains("@") & ~F.lower(text).isin(*NULLISH_TEXTS), found).otherwise(_empty())


def row_email_tokens(columns_with_types):
    """Tokens of several cells in column order. Addresses repeat when cells repeat them."""
    parts = [email_tokens(column, data_type) for column, data_type in columns_with_types]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def extract_emails(column, data_type=None):
    return F.transform(email_tokens(column, data_type), lambda token: token["address"])


def fold_domain(value):
    text = str(value or "").strip().lower()
    return text.removeprefix("@").rstrip(".")


def domain_matches(domain, expected, include_subdomains=True):
    """True where the domain is one of the expected ones or, by default, below one of them."""
    actual = F.rtrim(F.regexp_replace(F.lower(strip(domain)), r"^@|\.+$", ""))
    targets = list(dict.fromkeys(filter(None, map(fold_domain, expected))))
    if not targets:
        return F.lit(False)
    hit = actual.isin(*targets)
    if include_subdomains:
        for target in targets:
            hit = hit | actual.endswith(f".{target}")
    return F.coalesce(hit, F.lit(False))


def matching_emails(tokens, expected, negated=False, quantifier="any", include_subdomains=True):
    """Distinct addresses that demonstrate the predicate; for "none" these are the ones that do not break it."""
    invert = negated != (quantifier == "none")

    def qualifies(token):
        inside = domain_matches(token["domain"], expected, include_subdomains)
        return ~inside if invert else inside

    return F.transform(_distinct_by_address(F.filter(tokens, qualifies)), lambda token: token["address"])


def mask_emails(column, max_length=None):
    """Addresses become a***@domain, for samples shown to people."""

    def masked(text, token):
        hidden = F.concat(F.substring(token["address"], 1, 1), F.lit("***@"), token["domain"])
        return F.replace(text, token["original"], hidden)

    text = F.aggregate(email_tokens(column), column, masked)
    return text if max_length is None else F.substring(text, 1, max_length)
