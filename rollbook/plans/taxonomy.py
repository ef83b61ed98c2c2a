"""Industry vocabularies: what in a title or an employer name speaks for an industry.

A vocabulary is a parameter of every classification. SEED is a short one of our own to start from; a real deployment keeps its
lists in a table of (industry, kind, term). TermTable leaves the terms there, to be joined, whatever their number;
taxonomies_from_table writes a short list into the query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

KINDS = ("title", "employer", "company", "exclusion", "ambiguous", "generic", "retrieval")
MAX_TERMS = 20_000
MAX_INDUSTRIES = 10_000

# Roles that never place a person in an industry by themselves.
GENERIC_ROLES = (
    "founder", "co-founder", "cofounder", "ceo", "chief executive officer", "president", "vice president", "director",
    "manager", "partner", "principal", "head of growth", "growth", "strategy", "operations", "partnerships", "sales",
    "marketing", "business development", "chief of staff", "finance", "product", "product lead", "general manager",
    "analyst", "associate", "investor",
)

# Other names of industries.
INDUSTRY_NAMES = {
    "vc": "venture_capital", "venturecapital": "venture_capital", "pe": "private_equity",
    "privateequity": "private_equity", "ib": "investment_banking", "investmentbanking": "investment_banking",
    "startup": "startups", "technology": "tech", "government": "government_legal", "governmentlegal": "government_legal",
    "legal_government": "government_legal",
}

# Order in which the industries of a company are listed.
PRIORITY = (
    "investment_banking", "banking", "venture_capital", "private_equity", "consulting", "government_legal", "law",
    "healthcare", "education", "marketing", "operations", "media", "finance", "startups", "nonprofit", "tech",
)


@dataclass(frozen=True)
class Vocabulary:
    """Terms of one industry by kind, in order of preference."""

    industry: str
    title: tuple = ()
    employer: tuple = ()
    company: tuple = ()
    exclusion: tuple = ()
    ambiguous: tuple = ()
    generic: tuple = ()
    retrieval: tuple = ()


@dataclass(frozen=True)
class Taxonomies:
    vocabularies: dict = field(default_factory=dict)

    def get(self, industry):
        """The vocabulary of an industry under any of its names, None if there is none."""
        return self.vocabularies.get(industry_key(industry))

    def terms(self, industry, kind):
        found = self.get(industry)
        return getattr(found, kind) if found else ()

    def __iter__(self):
        return iter(self.vocabularies)


def industry_key(name):
    key = re.sub(r"[^a-z0-9]+", "_", str(name or "").strip().lower()).strip("_")
    return INDUSTRY_NAMES.get(key, key)


def taxonomies(terms):
    """Taxonomies from {industry: {kind: [terms]}}."""
    for industry, kinds in terms.items():
        unknown = set(kinds) - set(KINDS)
        if unknown:
            raise ValueError(f"Unknown term kinds of '{industry}': {sorted(unknown)}.")
    return Taxonomies(
        {industry_key(i): Vocabulary(industry_key(i), **{k: tuple(v) for k, v in kinds.items()}) for i, kinds in terms.items()}
    )


def taxonomies_from_table(df):
    """Taxonomies from a table (industry, kind, term, priority). Vocabulary becomes part of the query, so its size is checked."""
    rows = df.select("industry", "kind", "term", "priority").orderBy("industry", "kind", F.col("priority").asc_nulls_last(), "term").take(MAX_TERMS + 1)
    if len(rows) > MAX_TERMS:
        raise ValueError(f"More than {MAX_TERMS} terms; a vocabulary is meant to be small.")
    terms = {}
    for row in rows:
        terms.setdefault(row["industry"], {}).setdefault(row["kind"], []).append(row["term"])
    return taxonomies(terms)


class TermTable:
    """Taxonomies whose terms stay in a table (industry, kind, term). Only the names of the industries come to the driver."""

    def __init__(self, df):
        key = F.btrim(F.regexp_replace(F.lower(F.btrim("industry")), "[^a-z0-9]+", "_"), F.lit("_"))
        names = F.create_map(*(F.lit(x) for pair in INDUSTRY_NAMES.items() for x in pair))
        folded = F.coalesce(F.element_at(names, key), key).alias("industry")
        present = df.select("industry", "kind", "term").where("term is not null")
        self.table = present.select(folded, "kind", "term")
        # Terms are many and spellings few, so spellings are told apart before they are folded; without the inline the two would be merged.
        spelt = present.select("industry", "kind").distinct()
        found = spelt.select(F.inline(F.array(F.struct(folded, "kind")))).distinct().limit(MAX_INDUSTRIES + 1).collect()
        if len(found) > MAX_INDUSTRIES:
            raise ValueError(f"More than {MAX_INDUSTRIES} industries and kinds.")
        unknown = {row["kind"] for row in found} - set(KINDS)
        if unknown:
            raise ValueError(f"Unknown term kinds: {sorted(map(str, unknown))}.")
        self.industries = {row["industry"] for row in found}

    def get(self, industry):
        key = industry_key(industry)
        return key if key in self.industries else None

    def __iter__(self):
        return iter(sorted(self.industries))


SEED = taxonomies(
    {
        "tech": {
            "title": ["software engineer", "developer", "programmer", "data scientist", "machine learning", "devops", "database", "cto"],
            "employer": ["technologies", "software", "cloud", "data", "labs", "analytics"],
            "company": ["Google", "Microsoft", "Uber", "Chainalysis"],
            "exclusion": ["school", "hospital", "clinical", "law", "insurance", "real estate"],
            "ambiguous": ["solutions", "innovation", "ventures"],
        },
        "consulting": {
            "title": ["consultant", "consulting"],
            "employer": ["consulting", "advisory"],
            "company": ["McKinsey", "Bain", "Deloitte", "Accenture", "Ernst & Young", "KPMG"],
            "exclusion": ["hospital", "school"],
            "ambiguous": ["partners", "group"],
        },
        "banking": {
            "title": ["banker", "credit analyst"],
            "employer": ["bank", "credit union"],
            "company": ["JPMorgan Chase", "Citibank", "Capital One"],
            "exclusion": ["food bank", "blood bank"],
            "ambiguous": ["trust"],
        },
        "investment_banking": {
            "title": ["investment banking", "investment banker"],
            "company": ["Goldman Sachs", "Morgan Stanley", "Lazard"],
        },
        "finance": {
            "title": ["portfolio manager", "financial analyst", "trader"],
            "employer": ["capital", "investments", "insurance", "asset management"],
            "company": ["BlackRock", "Fidelity", "Vanguard"],
            "ambiguous": ["holdings"],
        },
        "venture_capital": {
            "title": ["venture capital", "venture partner"],
            "employer": ["ventures", "venture capital"],
            "company": ["Sequoia Capital"],
        },
        "private_equity": {"title": ["private equity"], "employer": ["private equity"], "company": ["KKR", "Blackstone"]},
        "healthcare": {
            "title": ["physician", "nurse", "surgeon", "pharmacist", "clinical"],
            "employer": ["hospital", "clinic", "health", "medical center"],
            "company": ["Mayo Clinic"],
            "exclusion": ["veterinary"],
            "ambiguous": ["wellness", "care"],
        },
        "law": {
            "title": ["attorney", "lawyer", "paralegal", "counsel"],
            "employer": ["law firm", "law", "legal"],
            "company": ["Skadden"],
            "exclusion": ["law school"],
            "ambiguous": ["llp"],
        },
        "government_legal": {
            "title": ["policy analyst", "law clerk", "legislative aide"],
            "employer": ["department of", "city of", "ministry of", "court"],
            "company": ["World Bank", "United Nations"],
            "ambiguous": ["public", "council"],
        },
        "education": {
            "title": ["teacher", "professor", "lecturer"],
            "employer": ["school", "university", "college"],
            "ambiguous": ["institute", "academy"],
        },
        "media": {
            "title": ["editor", "journalist", "producer"],
            "employer": ["news", "media", "publishing", "studios"],
            "company": ["Spotify", "Netflix"],
        },
        "nonprofit": {
            "title": ["fundraiser", "development officer"],
            "employer": ["foundation", "charity", "nonprofit"],
            "company": ["Red Cross"],
        },
        "startups": {
            "title": ["startup founder"],
            "employer": ["startup", "stealth"],
            "generic": ["founding engineer"],
            "ambiguous": ["labs"],
        },
        "marketing": {
            "title": ["marketing manager", "brand manager"],
            "employer": ["advertising", "marketing"],
            "company": ["Ogilvy", "Publicis"],
        },
        "operations": {
            "title": ["operations manager", "logistics manager"],
            "employer": ["logistics", "supply chain", "freight"],
            "company": ["FedEx", "Maersk"],
        },
    }
)
