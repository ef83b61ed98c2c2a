"""Text normal forms and the word-or-phrase test built on them."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from rollbook.functions.missing import NULLISH_TEXTS, collapse_blanks, strip

# Misspelt company names and their usual spelling, applied as whole words.
COMPANY_SPELLINGS = {
    "capitol one": "capital one",
    "chainanalysis": "chainalysis",
    "mit lincoln labratory": "mit lincoln laboratory",
    "lincoln labratory": "lincoln laboratory",
    "northrop gruman": "northrop grumman",
    "northrop grumman corp": "northrop grumman",
    "indeed com": "indeed",
}

# Legal-form words dropped from company names.
COMPANY_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company")


# Up to this many phrases are tested one by one; longer lists go through one array expression, which keeps generated code small.
FEW = 4

# The second pattern says "neither alphanumeric nor &" by look-ahead: Java matches it several times faster than one class.
NOT_ALNUM = "[^a-z0-9]+"
NOT_ALNUM_OR_AMPERSAND = "(?:(?!&)[^a-z0-9])+"


def norm_text(column):
    return F.btrim(F.regexp_replace(F.lower(column), NOT_ALNUM, " "))


def norm_title(column):
    return F.btrim(F.regexp_replace(F.lower(column), NOT_ALNUM_OR_AMPERSAND, " "))


def norm_compact(column):
    return F.regexp_replace(F.lower(column), NOT_ALNUM, "")


def norm_member(column):
    """Folded text for membership tests; null where nothing was entered."""
    folded = F.lower(collapse_blanks(column))
    return F.when(~folded.isin(*NULLISH_TEXTS, "n/a", "na"), folded)


def fold_company_name(column):
    """Folded company name before spelling and legal-form words are looked at. Bracketed parts are dropped."""
    low = F.lower(column)
    plain = F.when(low.contains("("), F.regexp_replace(low, r"\([^)]*\)", " ")).otherwise(low)
    return F.btrim(F.regexp_replace(plain, NOT_ALNUM, " "))


def respell_company(folded):
    """Usual spelling and no legal-form words. Give it a column rather than an expression: it reads it several times."""
    spelt = folded
    for wrong, right in COMPANY_SPELLINGS.items():
        spelt = F.regexp_replace(spelt, rf"\b{wrong}\b", right)
    misspelt = reduce(or_, (folded.contains(wrong) for wrong in COMPANY_SPELLINGS))
    name = F.when(misspelt, spelt).otherwise(folded)
    return F.btrim(F.regexp_replace(name, rf"(?:^| )(?:{'|'.join(COMPANY_SUFFIXES)})(?= |$)", ""))


def norm_company(column):
    return respell_company(fold_company_name(column))


def filled_cell(column):
    """Trimmed cell text; absent cells and the texts that stand for them become empty text."""
    text = strip(column)
    return F.when(text.isNull() | F.lower(text).isin("nan", "none", "nat", "null"), F.lit("")).otherwise(text)


def fold_term(term, keep="a-z0-9&"):
    return re.sub(rf"[^{keep}]+", " ", str(term).lower()).strip()


def fold_company(term):
    """norm_company for a term known when the query is built."""
    name = re.sub(r"\([^)]*\)", " ", str(term).lower())
    name = " ".join(re.sub(r"[^a-z0-9]+", " ", name).split())
    for wrong, right in COMPANY_SPELLINGS.items():
        name = re.sub(rf"\b{wrong}\b", right, name)
    return " ".join(word for word in name.split() if word not in COMPANY_SUFFIXES)


def term_pattern(terms, keep="a-z0-9&"):
    """One expression for all terms: a word must stand alone, a phrase may occur anywhere in the normal form."""
    folded = list(dict.fromkeys(filter(None, (fold_term(term, keep) for term in terms))))
    words = [re.escape(term) for term in folded if " " not in term]
    phrases = [re.escape(term).replace(r"\ ", " ") for term in folded if " " in term]
    parts = []
    if words:
        parts.append(rf"\b(?:{'|'.join(words)})\b")
    if phrases:
        parts.append(f"(?:{'|'.join(phrases)})")
    return "|".join(parts)


def company_pattern(companies):
    names = list(dict.fromkeys(filter(None, (fold_company(name) for name in companies))))
    return rf"\b(?:{'|'.join(names)})\b" if names else ""


def matches(normalised, pattern):
    """False, not null, for absent text or an empty term list."""
    if not pattern:
        return F.lit(False)
    return F.coalesce(normalised.rlike(pattern), F.lit(False))


def has_term(normalised, terms, keep="a-z0-9&"):
    """Whether a term occurs. Words go into one expression; phrases are plain substrings, which are cheaper to look for."""
    folded = list(dict.fromkeys(filter(None, (fold_term(term, keep) for term in terms))))
    words = [term for term in folded if " " not in term]
    phrases = [term for term in folded if " " in term]
    tests = [normalised.rlike(term_pattern(words, keep))] if words else []
    if len(phrases) > FEW:
        tests.append(F.exists(F.array(*map(F.lit, phrases)), normalised.contains))
    else:
        tests += [normalised.contains(phrase) for phrase in phrases]
    return F.coalesce(reduce(or_, tests), F.lit(False)) if tests else F.lit(False)


def first_term(normalised, terms, keep="a-z0-9&"):
    """The first listed term that occurs, null if none does."""
    tests = [F.when(has_term(normalised, [term], keep), F.lit(str(term))) for term in terms if fold_term(term, keep)]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def company_match(normalised_company, companies):
    return matches(normalised_company, company_pattern(companies))


def clean_text(column, max_length=None):
    """Text without tags and NULs, blanks collapsed; with max_length longer texts end in "..."."""
    text = F.regexp_replace(F.coalesce(column, F.lit("")), r"<[^>\n]*>", "")
    text = F.regexp_replace(text, "\x00", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    if max_length is None:
        return text
    cut = F.concat(F.rtrim(F.substring(text, 1, max_length - 1)), F.lit("..."))
    return F.when(F.length(text) > max_length, cut).otherwise(text)


def full_name(first, last, full=None, preferred=None):
    """First and last name if both are there, else the full name, else the preferred name, else empty text."""

    def value(column):
        text = strip(column)
        return F.when(~F.lower(text).isin("", "nan", "none", "null"), text)

    choices = [F.concat(value(first), F.lit(" "), value(last))]
    choices += [value(column) for column in (full, preferred) if column is not None]
    return F.coalesce(*choices, F.lit(""))
