"""Rule-based industry classification of people, as column expressions.

Each test is one regular expression over folded text, computed once per row in a first projection; rules then read these Boolean
signals. A policy is an ordered list of rules (condition, outcome); the first that holds decides. All of that is row-wise. Where
the vocabulary is a TermTable, its terms are not part of the plan: distinct texts meet them by a join, and rules read the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from rollbook.functions.missing import as_text, type_of
from rollbook.functions.text import (
    company_match, filled_cell, fold_company_name, has_term, norm_company, norm_title, respell_company,
)
from rollbook.operators.columns import canonical_column, find_column, person_column
from rollbook.operators.sampling import col, data_columns
from rollbook.plans import phrases as V
from rollbook.plans.lookup import attach_vocabulary
from rollbook.plans.taxonomy import GENERIC_ROLES, PRIORITY, SEED, TermTable, industry_key
from rollbook.sources.files import ROW_ID

DIRECT, ADJACENT, UNCERTAIN, NON_MATCH = "direct_match", "adjacent", "uncertain", "non_match"
RANK = {DIRECT: 3, ADJACENT: 2, UNCERTAIN: 1, NON_MATCH: 0}
COUNTING_FLOOR = 0.70

# Parts of headers that mark a column as describing the employer.
DESCRIPTOR_MARKS = (
    "industry", "sector", "company description", "employer description", "organization description",
    "organisation description", "business description",
)


@dataclass(frozen=True)
class QuerySpec:
    """Which industries are asked for, and what else a match must or must not show.

    employers or titles ask for people of named employers or with certain titles instead of an industry.
    """

    industries: tuple = ()
    required: tuple = ()
    excluded: tuple = ()
    functions: tuple = ()
    excluded_functions: tuple = ()
    include_adjacent: bool = False
    scope: str = "industry"
    employers: tuple = ()
    titles: tuple = ()


@dataclass
class Signals:
    """Boolean tests of a row, each kept once under a short name and computed in one projection."""

    taxonomies: object
    tests: dict = field(default_factory=dict)
    names: dict = field(default_factory=dict)
    wanted: dict = field(default_factory=dict)
    described: bool = True

    def undescribed(self):
        """The same tests, as if no column described the employer."""
        return Signals(self.taxonomies, self.tests, self.names, self.wanted, described=False)

    def _keep(self, key, make):
        if key not in self.names:
            self.names[key] = f"_s{len(self.names)}"
            self.tests[self.names[key]] = make()
        return F.col(self.names[key])

    def title(self, *terms):
        return self._keep(("title", terms), lambda: has_term(F.col("_title"), terms))

    def employer(self, *terms):
        return self._keep(("employer", terms), lambda: has_term(F.col("_employer"), terms))

    def descriptor(self, *terms):
        if not self.described:
            return F.lit(False)
        return self._keep(("descriptor", terms), lambda: has_term(F.col("_descriptor"), terms))

    def either(self, *terms):
        """Title and employer read as one text."""
        both = F.btrim(F.concat_ws(" ", "_title", "_employer"))
        return self._keep(("either", terms), lambda: has_term(both, terms))

    def anywhere(self, *terms):
        """Title, employer and employer description read as one text."""
        if not self.described:
            return self.either(*terms)
        whole = F.btrim(F.concat_ws(" ", "_title", "_employer", "_descriptor"))
        return self._keep(("anywhere", terms), lambda: has_term(whole, terms))

    def company(self, *names):
        return self._keep(("company", names), lambda: company_match(F.col("_company"), names))

    def known(self, place, industry, kind):
        """A term of the industry's vocabulary occurs in that text."""
        if not isinstance(self.taxonomies, TermTable):
            return getattr(self, place)(*self.taxonomies.terms(industry, kind))
        if not self.described and place == "descriptor":
            return F.lit(False)
        place = "either" if not self.described and place == "anywhere" else place
        code = self.wanted.setdefault((place, industry_key(industry), kind), len(self.wanted))
        return self._keep(("known", code), lambda: F.coalesce(F.array_contains("_hits", F.lit(code)), F.lit(False)))

    def employer_of(self, industry):
        """The employer is a known company of the industry or carries its wording."""
        return self.known("company", industry, "company") | self.known("employer", industry, "employer")

    def label(self, label):
        industries = [i for i, name in V.EMPLOYER_LABELS.items() if name == label and self.taxonomies.get(i)]
        return reduce(or_, map(self.employer_of, industries)) if industries else F.lit(False)

    def labelled(self):
        return reduce(or_, map(self.label, dict.fromkeys(V.EMPLOYER_LABELS.values())))

    def function(self, name):
        found = self.title(*V.JOB_FUNCTIONS.get(name, ()))
        if name == "internal_strategy":
            return found & ~self.title(*V.JOB_FUNCTIONS["consulting_advisory"])
        return found

    def specialty(self, name):
        return self.title(*V.SPECIALTIES[name])

    @property
    def no_title(self):
        return F.col("_title_text") == ""

    @property
    def no_employer(self):
        return F.col("_employer_text") == ""


def outcome(name, confidence, reason):
    return F.struct(
        F.lit(RANK[name]).alias("rank"), F.lit(float(confidence)).alias("confidence"), F.lit(name).alias("classification"),
        F.lit(reason).alias("reason"),
    )


def decide(rules, otherwise):
    """First rule that holds."""
    chain = None
    for condition, result in rules:
        chain = F.when(condition, result) if chain is None else chain.when(condition, result)
    return chain.otherwise(otherwise) if chain is not None else otherwise


NO_EVIDENCE = "no title or employer evidence"


def _tech(s, spec):
    technical = s.title(*V.TECHNICAL_TITLES)
    known = s.known("company", "tech", "company")
    worded = s.employer(*V.TECH_EMPLOYER_WORDS)
    beside = s.title(*V.TECH_ADJACENT_TITLES)
    vague = s.known("employer", "tech", "ambiguous")
    other_domain = s.known("either", "tech", "exclusion")
    advisers = s.label("consulting_professional_services") & s.employer("consulting", "advisory", "professional services")
    is_technical = outcome(DIRECT, 0.98, "technical title")
    is_known = outcome(DIRECT, 0.95, "known technology company")
    is_worded = outcome(DIRECT, 0.88, "technology wording in employer")
    is_advisers = outcome(ADJACENT, 0.58, "consulting unit, not a technology company")
    is_vague = outcome(UNCERTAIN, 0.45, "ambiguous employer wording")
    if spec.scope == "technical_role":
        rules = [
            (technical, is_technical),
            (known | worded, outcome(ADJACENT, 0.58, "technology employer without technical title")),
            (beside, outcome(ADJACENT, 0.5, "title beside technology")),
            (vague, is_vague),
        ]
    elif spec.scope == "tech_company":
        rules = [
            (advisers, is_advisers),
            (known, is_known),
            (worded & ~other_domain, is_worded),
            (technical, outcome(ADJACENT, 0.62, "technical title outside technology companies")),
            (beside, outcome(ADJACENT, 0.52, "title beside technology")),
            (vague, is_vague),
        ]
    else:
        rules = [
            (technical & s.title("clinical data analyst"), outcome(ADJACENT, 0.58, "clinical data title")),
            (technical, is_technical),
            (s.title("marketplace operations"), outcome(ADJACENT, 0.52, "marketplace operations")),
            (advisers, is_advisers),
            (known, is_known),
            (worded & ~other_domain, is_worded),
            (beside, outcome(ADJACENT, 0.55, "title beside technology")),
            (vague, is_vague),
        ]
    return decide(rules, outcome(NON_MATCH, 0.2, NO_EVIDENCE))


def _investment_banking(s, spec):
    bank = s.known("company", "investment_banking", "company")
    other = s.title("corporate banking", "commercial banking", "risk analyst", "wealth management", "asset management")
    return decide(
        [
            (s.title(*V.INVESTMENT_BANKING_TITLES), outcome(DIRECT, 0.98, "investment banking title")),
            (other, outcome(NON_MATCH, 0.85, "other banking or finance role")),
            (bank & s.title("analyst", "associate", "vice president"), outcome(UNCERTAIN, 0.45, "investment bank, generic title")),
            (bank, outcome(NON_MATCH, 0.75, "investment bank alone")),
        ],
        outcome(NON_MATCH, 0.2, NO_EVIDENCE),
    )


def _banking_rules(s):
    """Banking rules in order, without the public-sector guard."""
    bank = s.employer_of("banking")
    return [
        (s.title(*V.BANKING_TITLES, *V.INVESTMENT_BANKING_TITLES), outcome(DIRECT, 0.92, "banking title")),
        (
            bank & s.title("software engineer", "developer", "product manager", "marketing manager"),
            outcome(NON_MATCH, 0.8, "bank employer, other role"),
        ),
        (bank & s.no_title, outcome(DIRECT, 0.78, "bank employer without title")),
        (
            bank & s.title("analyst", "associate", "vice president", "risk", "credit", "finance"),
            outcome(DIRECT, 0.78, "bank employer with plausible title"),
        ),
        (bank, outcome(UNCERTAIN, 0.45, "bank employer, unclear title")),
    ]


PUBLIC_EMPLOYER = "public-sector employer"


def _banking(s, spec):
    guard = (s.label("government_legal"), outcome(NON_MATCH, 0.9, PUBLIC_EMPLOYER))
    return decide([guard, *_banking_rules(s)], outcome(NON_MATCH, 0.2, NO_EVIDENCE))


def _finance(s, spec):
    is_banking = _banking(s, spec)["rank"] == RANK[DIRECT]
    return decide(
        [
            (s.label("government_legal"), outcome(NON_MATCH, 0.9, PUBLIC_EMPLOYER)),
            (is_banking, outcome(NON_MATCH, 0.88, "banking is kept apart from finance")),
            (s.title(*V.FINANCE_TITLES, *V.INVESTMENT_BANKING_TITLES), outcome(DIRECT, 0.9, "finance title")),
            (s.employer_of("finance"), outcome(DIRECT, 0.82, "finance employer")),
        ],
        outcome(NON_MATCH, 0.2, NO_EVIDENCE),
    )


def _marketing(s, spec):
    employer = s.employer_of("marketing")
    rules = [(s.title(*V.MARKETING_TITLES), outcome(DIRECT, 0.95, "marketing title"))]
    if "marketing_growth" in spec.functions:
        grows = s.title("growth", "head of growth")
        technology = s.label("technology") & ~s.title("growth marketing")
        rules += [
            (grows & technology, outcome(NON_MATCH, 0.85, "growth role at a technology employer")),
            (grows, outcome(DIRECT, 0.82, "growth role was asked for")),
        ]
    plausible = s.no_title | s.title("manager", "analyst", "director", "coordinator", "strategist")
    rules += [
        (s.title(*V.MARKETING_ADJACENT_TITLES), outcome(ADJACENT, 0.55, "title beside marketing")),
        (employer & plausible, outcome(DIRECT, 0.78, "marketing employer with plausible title")),
        (employer, outcome(UNCERTAIN, 0.45, "marketing employer, unclear title")),
    ]
    return decide(rules, outcome(NON_MATCH, 0.2, NO_EVIDENCE))


def _operations(s, spec):
    direct = s.title(*V.OPERATIONS_TITLES)
    elsewhere = s.title("product operations", "curriculum operations", "clinical operations", "revops")
    employer = s.employer_of("operations")
    return decide(
        [
            (direct & elsewhere, outcome(NON_MATCH, 0.85, "operations of another domain")),
            (direct, outcome(DIRECT, 0.95, "operations title")),
            (s.title(*V.OPERATIONS_ADJACENT_TITLES), outcome(ADJACENT, 0.55, "title beside operations")),
            (
                employer & s.title("manager", "analyst", "associate", "director"),
                outcome(DIRECT, 0.78, "operations employer with plausible title"),
            ),
            (employer, outcome(UNCERTAIN, 0.45, "operations employer, unclear title")),
        ],
        outcome(NON_MATCH, 0.2, NO_EVIDENCE),
    )


def _government_legal(s, spec):
    employer = s.employer_of("government_legal")
    schools = s.employer("department of education") & ~s.title("policy", "legal", "attorney", "law")
    return decide(
        [
            (s.title(*V.GOVERNMENT_LEGAL_TITLES), outcome(DIRECT, 0.95, "legal, policy or government title")),
            (employer & schools, outcome(NON_MATCH, 0.85, "education department without legal title")),
            (employer, outcome(DIRECT, 0.88, "government or legal employer")),
            (s.known("either", "government_legal", "ambiguous"), outcome(UNCERTAIN, 0.4, "weak public-sector wording")),
        ],
        outcome(NON_MATCH, 0.2, NO_EVIDENCE),
    )


def _consulting(s, spec):
    adviser = s.label("consulting_professional_services")
    advisory = s.title(*V.CLIENT_ADVISORY_TITLES)
    financial_advisory = s.title("financial advisory")
    unlike = s.function("engineering") | s.function("finance_investing") | s.function("education_teaching")
    internal = (
        s.function("internal_strategy") | s.function("product") | s.function("operations")
        | s.title(*V.CONSULTING_ADJACENT_WORDS)
    )
    return decide(
        [
            (s.no_title & s.no_employer, outcome(UNCERTAIN, 0.2, "nothing known")),
            (s.title("consultant", "consulting"), outcome(DIRECT, 0.95, "consulting title")),
            (advisory & adviser, outcome(DIRECT, 0.9, "client advisory at an advisory firm")),
            (advisory & ~s.labelled(), outcome(DIRECT, 0.75, "client advisory, employer unknown")),
            (advisory & s.label("financial_services"), outcome(ADJACENT, 0.6, "advisory inside financial services")),
            (advisory, outcome(UNCERTAIN, 0.55, "advisory elsewhere")),
            (financial_advisory & adviser, outcome(DIRECT, 0.85, "financial advisory at an advisory firm")),
            (financial_advisory, outcome(ADJACENT, 0.6, "financial advisory elsewhere")),
            (s.function("legal"), outcome(NON_MATCH, 0.9, "legal role")),
            (
                s.title(*V.FINANCE_NOT_CONSULTING_TITLES) & ~adviser,
                outcome(NON_MATCH, 0.85, "finance role without advisory context"),
            ),
            (adviser & unlike, outcome(UNCERTAIN, 0.55, "advisory firm, other function")),
            (adviser, outcome(DIRECT, 0.8, "advisory firm with plausible title")),
            (s.title("advisor", "adviser"), outcome(UNCERTAIN, 0.5, "adviser without context")),
            (internal, outcome(ADJACENT, 0.6, "internal business role")),
            (s.known("employer", "consulting", "ambiguous"), outcome(UNCERTAIN, 0.45, "ambiguous employer wording")),
        ],
        outcome(NON_MATCH, 0.2, NO_EVIDENCE),
    )


POLICIES = {
    "tech": _tech,
    "investment_banking": _investment_banking,
    "banking": _banking,
    "finance": _finance,
    "marketing": _marketing,
    "operations": _operations,
    "government_legal": _government_legal,
    "consulting": _consulting,
}


def _layers(s, industry):
    """Taxonomy layers in order: (condition, status, source, confidence)."""
    title = s.known("title", industry, "title")
    excluded = ~title & s.known("anywhere", industry, "exclusion")
    described = s.known("descriptor", industry, "employer")
    return [
        (title, "confirmed", "title_keyword", 1.0),
        (s.known("company", industry, "company"), "confirmed", "known_company", 0.95),
        (s.known("employer", industry, "employer"), "confirmed", "employer_keyword", 0.9),
        (described & ~excluded, "confirmed", "employer_keyword", 0.82),
        (excluded, "excluded", "exclusion_keyword", 0.9),
        (s.known("employer", industry, "ambiguous"), "uncertain", "ambiguous_employer", 0.45),
    ]


def _by_taxonomy(s, industry):
    names = {"confirmed": DIRECT, "uncertain": UNCERTAIN, "excluded": NON_MATCH}
    rules = [
        (condition, outcome(names[status], confidence, source.replace("_", " ")))
        for condition, status, source, confidence in _layers(s, industry)
    ]
    return decide(rules, outcome(NON_MATCH, 0.0, NO_EVIDENCE))


def industry_outcome(s, industry, spec):
    key = industry_key(industry)
    if key in POLICIES:
        return POLICIES[key](s, spec)
    if s.taxonomies.get(key) is None:
        return outcome(NON_MATCH, 0.0, "unknown industry")
    return _by_taxonomy(s, key)


def _shows(s, industry):
    """Some evidence for a required industry: employer label, related specialty, or a direct match by title or employer."""
    key = industry_key(industry)
    tests = [s.label(V.EMPLOYER_LABELS[key])] if key in V.EMPLOYER_LABELS else []
    tests += [s.specialty(name) for name in V.RELATED_SPECIALTIES.get(key, ())]
    if s.taxonomies.get(key):
        tests.append(industry_outcome(s.undescribed(), key, QuerySpec((key,)))["rank"] == RANK[DIRECT])
    return reduce(or_, tests) if tests else F.lit(False)


def _changed(result, name, confidence, reason):
    return F.struct(
        F.lit(RANK[name]).alias("rank"), confidence.alias("confidence"), F.lit(name).alias("classification"),
        F.lit(reason).alias("reason"),
    )


def _any(tests):
    tests = list(tests)
    return reduce(or_, tests) if tests else F.lit(False)


def _labels(pairs, empty):
    found = F.array_compact(F.array(*(F.when(test, F.lit(label)) for label, test in pairs)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(empty)))


def _profile_columns(s):
    labels = dict.fromkeys(V.EMPLOYER_LABELS.values())
    empty_title = F.when(s.no_title, F.array(F.lit("unknown")))
    return {
        "employer_industry": _labels([(label, s.label(label)) for label in labels], "unknown"),
        "job_function": empty_title.otherwise(_labels([(n, s.function(n)) for n in V.JOB_FUNCTIONS], "other")),
        "specialties": _labels([(n, s.specialty(n)) for n in V.SPECIALTIES], "unknown"),
    }


def _role_signal(s):
    return decide([(s.title(*terms), F.lit(name)) for name, terms in V.ROLE_SIGNALS], F.lit("unknown"))


def _employer_signal(s):
    rules = [(s.no_employer, F.lit("unknown"))]
    rules += [(s.label(label), F.lit(name)) for label, name in V.EMPLOYER_SIGNALS]
    rules += [
        (s.employer(*V.RESEARCH_EMPLOYER_WORDS), F.lit("research")),
        (s.known("employer", "tech", "ambiguous"), F.lit("ambiguous")),
    ]
    return decide(rules, F.lit("unknown"))


def _reason_code(s, selected):
    name = F.col("classification")
    technical, tech_asked = s.title(*V.TECHNICAL_TITLES), selected == "tech"
    known = tech_asked & s.known("company", "tech", "company")
    direct = decide(
        [
            (technical & s.label("financial_services"), F.lit("technical_role_in_finance")),
            (technical, F.lit("role_is_technical")),
            (known & (F.col("role_signal") == "product"), F.lit("product_role_at_tech_company")),
            (known & (F.col("role_signal") == "business"), F.lit("business_role_at_tech_company")),
            (known, F.lit("employer_is_known_tech")),
            (tech_asked & s.employer(*V.TECH_EMPLOYER_WORDS), F.lit("employer_has_strong_tech_keyword")),
        ],
        F.lit("direct_match"),
    )
    adjacent = decide(
        [
            (F.col("role_signal") == "product", F.lit("product_at_nontech_or_ambiguous_employer")),
            (F.col("role_signal") == "analytics", F.lit("analytics_adjacent")),
            (F.col("employer_signal") == "ambiguous", F.lit("ambiguous_tech_company")),
        ],
        F.lit("tech_adjacent"),
    )
    return decide(
        [(name == DIRECT, direct), (name == ADJACENT, adjacent), (name == UNCERTAIN, F.lit("uncertain_signal"))],
        F.lit("excluded_no_meaningful_signal"),
    )


def descriptor_columns(columns):
    """Columns that describe the employer."""

    def folded(name):
        return "".join(c if c.isalnum() else " " for c in name.lower())

    return [name for name in columns if any(mark in " ".join(folded(name).split()) for mark in DESCRIPTOR_MARKS)]


def prepared(df, profile=None):
    """Add the folded texts all rules read. Missing columns and cells count as empty.

    Each step reads columns of the step before, so that no regular expression runs twice on a row.
    """
    columns = data_columns(df)

    def cell(name):
        return as_text(col(name), type_of(df, name)) if name else F.lit(None).cast("string")

    title, employer = (person_column(columns, f, profile) for f in ("occupation", "employer"))
    described = [filled_cell(cell(name)) for name in descriptor_columns(columns)]
    cells = df.withColumns(
        {
            "_title_text": filled_cell(cell(title)),
            "_employer_text": filled_cell(cell(employer)),
            "_descriptor_text": F.concat_ws(" ", *described) if described else F.lit(""),
        }
    )
    folded = cells.withColumns(
        {
            "_title": norm_title(F.col("_title_text")),
            "_employer": norm_title(F.col("_employer_text")),
            "_descriptor": norm_title(F.col("_descriptor_text")),
            "_company": fold_company_name(F.col("_employer_text")),
        }
    )
    return folded.withColumn("_company", respell_company(F.col("_company")))


def _with_signals(df, s):
    if s.wanted:
        df = attach_vocabulary(df, s.taxonomies.table, s.wanted)
    return df.withColumns(s.tests) if s.tests else df


def _finish(df, kept, extra):
    return df.select(*(col(c) for c in kept), *extra)


def profile_people(df, taxonomies=SEED, profile=None):
    """Add employer_industry, job_function and specialties, independent of any question."""
    s = Signals(taxonomies)
    found = _profile_columns(s)
    rows = _with_signals(prepared(df, profile), s)
    return _finish(rows, df.columns, [value.alias(name) for name, value in found.items()])


def match_industry(df, industry, taxonomies=SEED, profile=None):
    """Add status, match_sources, confidence and reason of one industry's vocabulary layers."""
    key = industry_key(industry)
    if taxonomies.get(key) is None:
        raise ValueError(f"Unknown industry '{industry}'.")
    s = Signals(taxonomies)
    layers = _layers(s, key)
    generic = s.title(*GENERIC_ROLES) | s.known("title", key, "generic")

    def result(status, sources, confidence):
        listed = F.array(*map(F.lit, sources)) if sources else F.array().cast("array<string>")
        return F.struct(F.lit(status).alias("status"), listed.alias("sources"), F.lit(confidence).alias("confidence"))

    chosen = decide(
        [(condition, result(status, [source], confidence)) for condition, status, source, confidence in layers],
        result("excluded", [], 0.0),
    )
    rows = _with_signals(prepared(df, profile), s).withColumns({"_match": chosen, "_generic": generic})
    rides = (F.col("_match.status") == "confirmed") & (F.get("_match.sources", F.lit(0)) != "title_keyword") & F.col("_generic")
    sources = F.when(
        rides, F.concat("_match.sources", F.array(F.lit("generic_business_role_with_matching_employer")))
    ).otherwise(F.col("_match.sources"))
    return _finish(
        rows, df.columns,
        [F.col("_match.status").alias("status"), sources.alias("match_sources"), F.col("_match.confidence").alias("confidence")],
    )


def _outcomes(s, spec):
    """What is asked for, and the outcome for each."""
    for terms, test, reason in ((spec.employers, s.company, "employer was asked for"), (spec.titles, s.title, "title was asked for")):
        if terms:
            return [("", decide([(test(*terms), outcome(DIRECT, 1.0, reason))], outcome(NON_MATCH, 0.0, NO_EVIDENCE)))]
    return [(industry, industry_outcome(s, industry, spec)) for industry in spec.industries]


def _best_outcome(industries):
    """The outcome of highest rank, then confidence; of equals the industry asked for first."""

    def candidate(i, industry):
        found = F.col(f"_o{i}")
        return F.struct(
            found["rank"].alias("rank"), found["confidence"].alias("confidence"), F.lit(-i).alias("order"),
            found["classification"].alias("classification"), found["reason"].alias("reason"),
            F.lit(industry_key(industry)).alias("industry"),
        )

    candidates = [candidate(i, industry) for i, industry in enumerate(industries)]
    if len(candidates) == 1:
        return candidates[0]
    if candidates:
        return F.greatest(*candidates)
    return F.struct(
        F.lit(0).alias("rank"), F.lit(0.0).alias("confidence"), F.lit(0).alias("order"), F.lit(NON_MATCH).alias("classification"),
        F.lit("no industry was asked for").alias("reason"), F.lit("").alias("industry"),
    )


def classify(df, spec, taxonomies=SEED, profile=None, details=True):
    """Add classification, count_as_match, confidence, reason and, with details, the profile and its signals."""
    s = Signals(taxonomies)
    asked_for = _outcomes(s, spec)
    outcomes = {f"_o{i}": found for i, (_, found) in enumerate(asked_for)}
    growth = s.label("technology") if "marketing_growth" in spec.functions else F.lit(False)
    asked = {name: s.function(name) for name in spec.functions}
    required = {name: _shows(s, name) for name in spec.required}
    excluded = {name: industry_outcome(s, name, QuerySpec((name,)))["rank"] == RANK[DIRECT] for name in spec.excluded}
    unwanted = [s.function(name) for name in spec.excluded_functions]
    code = _reason_code(s, F.col("_selected")) if details else None
    role, employer = (_role_signal(s), _employer_signal(s)) if details else (None, None)
    facets = _profile_columns(s) if details else {}

    rows = _with_signals(prepared(df, profile), s)
    # Outcomes become columns before they are compared, so that each rule chain is one expression.
    rows = rows.withColumns(outcomes) if outcomes else rows
    rows = rows.withColumn("_best", _best_outcome([industry for industry, _ in asked_for]))
    result = F.struct("_best.rank", "_best.confidence", "_best.classification", "_best.reason")
    steps = []
    if asked:
        step = F.col("_r")
        high = F.greatest(step["confidence"], F.lit(0.85))
        on_growth = asked.get("marketing_growth", F.lit(False)) & growth
        hit = (step["rank"] != RANK[DIRECT]) & _any(asked.values())
        steps.append(
            F.when(hit & on_growth, _changed(step, NON_MATCH, high, "growth role at a technology employer"))
            .when(hit, _changed(step, DIRECT, high, "job function was asked for"))
            .otherwise(step)
        )
    direct = F.col("_r")["rank"] == RANK[DIRECT]
    if required:
        low = F.least(F.col("_r")["confidence"], F.lit(0.6))
        lacking = _any(~test for test in required.values())
        steps.append(F.when(direct & lacking, _changed(F.col("_r"), ADJACENT, low, "a required industry does not show")).otherwise(F.col("_r")))
    for tests, why in ((excluded.values(), "an excluded industry shows"), (unwanted, "an excluded function shows")):
        if tests:
            steps.append(F.when(direct & _any(tests), _changed(F.col("_r"), NON_MATCH, F.lit(0.9), why)).otherwise(F.col("_r")))
    rows = rows.withColumn("_r", result)
    for step in steps:
        rows = rows.withColumn("_r", step)
    confidence = F.round(F.col("_r")["confidence"], 2)
    counted = (F.col("_r")["rank"] == RANK[DIRECT]) & (F.col("_r")["confidence"] >= COUNTING_FLOOR)
    if spec.include_adjacent:
        counted = counted | (F.col("_r")["rank"] == RANK[ADJACENT])
    rows = rows.withColumns(
        {
            "classification": F.col("_r")["classification"], "count_as_match": counted, "match_confidence_value": confidence,
            "match_reason": F.col("_r")["reason"],
            "_selected": F.when(F.col("_best.confidence") + F.col("_best.rank") > 0, F.col("_best.industry")).otherwise(F.lit("")),
        }
    )
    added = [
        F.col("classification"), F.col("count_as_match"), F.col("match_confidence_value").alias("confidence"),
        F.col("match_reason").alias("reason"),
    ]
    if details:
        rows = rows.withColumns({"role_signal": role, "employer_signal": employer})
        value = F.col("_r")["confidence"]
        bucket = F.when(value >= 0.85, F.lit("high")).when(value >= 0.6, F.lit("medium")).otherwise(F.lit("low"))
        category = F.when(F.col("classification") == NON_MATCH, F.lit("excluded")).when(
            F.col("classification") == DIRECT, F.lit("direct")
        ).otherwise(F.col("classification"))
        added += [
            category.alias("match_category"), bucket.alias("match_confidence"), F.col("role_signal"), F.col("employer_signal"),
            code.alias("match_reason_code"), *(v.alias(n) for n, v in facets.items()),
        ]
    return _finish(rows, df.columns, added)


def people_by_employer(df, names, profile=None):
    """Rows whose employer is one of the names, as a whole or within word boundaries."""
    rows = prepared(df, profile)
    return rows.filter(company_match(F.col("_company"), names)).select(*(col(c) for c in df.columns))


def people_by_occupation(df, terms, profile=None):
    """Rows whose title has one of the terms."""
    rows = prepared(df, profile)
    return rows.filter(has_term(F.col("_title"), terms)).select(*(col(c) for c in df.columns))


def company_industries(df, column="employer", taxonomies=SEED):
    """Add industries: those that know the company, in the fixed order of industries."""
    name = find_column(df.columns, column)
    known = [i for i in PRIORITY if taxonomies.get(i)] + [i for i in taxonomies if i not in PRIORITY]
    s = Signals(taxonomies)
    tests = [(i, s.known("company", i, "company")) for i in known]
    folded = norm_company(F.coalesce(as_text(col(name), type_of(df, name)), F.lit("")))
    rows = _with_signals(df.withColumn("_company", folded), s)
    found = F.array_compact(F.array(*(F.when(test, F.lit(i)) for i, test in tests)))
    return _finish(rows, df.columns, [found.alias("industries")])


def explain_people(df, name, industry, taxonomies=SEED, profile=None, limit=None, row_id=ROW_ID):
    """Why the people of a name do or do not belong to an industry; every word of the name must occur.

    A limit takes the first ones by row id.
    """
    columns = data_columns(df)
    sources = [canonical_column(columns, f, profile) for f in ("first_name", "last_name", "full_name", "nickname")]
    parts = [F.coalesce(as_text(col(c), type_of(df, c)), F.lit("")) for c in dict.fromkeys(sources) if c]
    if not parts:
        raise ValueError("No column holds names.")
    shown = F.btrim(F.concat_ws(" ", *parts))
    rows = df.withColumn("_name", shown)
    for word in name.lower().split():
        rows = rows.filter(F.lower("_name").contains(word))
    matched = match_industry(rows, industry, taxonomies, profile)
    if limit is not None:
        matched = matched.orderBy(col(row_id)).limit(limit)
    title, employer = (person_column(columns, f, profile) for f in ("occupation", "employer"))
    found = matched.select(
        F.col("_name").alias("name"),
        *(col(c).alias(n) if c else F.lit("").alias(n) for c, n in ((title, "occupation"), (employer, "employer"))),
        F.lit(industry_key(industry)).alias("target_industry"), "status", "match_sources", "confidence",
    )
    return found
