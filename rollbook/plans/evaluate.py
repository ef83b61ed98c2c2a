"""Scoring of results against gold rows, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions.emails import row_email_tokens
from rollbook.functions.missing import as_text, type_of
from rollbook.functions.text import full_name, norm_text
from rollbook.operators.columns import compact
from rollbook.operators.predicates import compile_spec
from rollbook.operators.sampling import col, data_columns
from rollbook.operators.skew import attach_groups
from rollbook.sources.files import ROW_ID

NAME = "_name"

# Compact headers of the columns a row's name, employer and title come from.
NAME_HEADERS = {
    "first": ("firstname", "givenname", "evalfirstname"),
    "last": ("lastname", "surname", "familyname", "evallastname"),
    "full": ("fullname", "name", "personname", "alumniname"),
    "preferred": ("preferredname", "nickname"),
}
EMPLOYER_HEADERS = ("employer", "company", "organization")
TITLE_HEADERS = ("title", "occupation", "jobtitle", "role", "position")


def _cell(df, headers):
    """Text of the first column with one of the headers, else null text."""
    name = next((n for n in df.columns if compact(n) in headers), None)
    return as_text(col(name), type_of(df, name)) if name else F.lit(None).cast("string")


def row_name(df):
    """Full name of a row, from whichever name columns the table has."""
    return full_name(*(_cell(df, headers) for headers in NAME_HEADERS.values()))


def normalised_names(df, name=None):
    """Distinct folded names of a table, empty ones left out."""
    source = as_text(col(name), type_of(df, name)) if name else row_name(df)
    return df.select(norm_text(source).alias(NAME)).filter(F.col(NAME) != "").distinct()


def precision_recall(returned, expected, name=None):
    """One row: precision and recall of distinct names. Nothing returned is precise; nothing expected is recalled only if nothing came back."""
    a = normalised_names(returned, name).withColumn("_r", F.lit(1))
    b = normalised_names(expected, name).withColumn("_e", F.lit(1))
    counted = a.join(b, NAME, "full").agg(
        F.count("_r").alias("returned"), F.count("_e").alias("expected"),
        F.count(F.when(F.col("_r").isNotNull() & F.col("_e").isNotNull(), 1)).alias("both"),
    )
    r, e, both = F.col("returned"), F.col("expected"), F.col("both")
    precision = F.when(r == 0, 1.0).otherwise(both / r)
    recall = F.when(e > 0, F.try_divide(both, e)).when(r == 0, 1.0).otherwise(0.0)
    return counted.select("returned", "expected", "both", precision.alias("precision"), recall.alias("recall"))


def result_diff(returned, expected, known, name=None):
    """Rows (kind, name): false positives, false negatives and names that no known row has."""
    a, b, k = (normalised_names(df, name) for df in (returned, expected, known))

    def missing(kind, left, right):
        return left.join(right, NAME, "left_anti").select(F.lit(kind).alias("kind"), F.col(NAME).alias("name"))

    return missing("false_positive", a, b).unionAll(missing("false_negative", b, a)).unionAll(missing("unknown", a, k))


def _features(df, emails):
    """Name, employer, title and addresses as they are compared."""
    return {
        NAME: norm_text(row_name(df)),
        "_employer": norm_text(F.coalesce(_cell(df, EMPLOYER_HEADERS), F.lit(""))),
        "_title": norm_text(F.coalesce(_cell(df, TITLE_HEADERS), F.lit(""))),
        "_addresses": F.array_distinct(F.transform(emails, lambda t: F.lower(t["address"]))) if emails is not None else F.array().cast("array<string>"),
    }


def _gold_emails(gold):
    names = [n for n in data_columns(gold) if "email" in compact(n)]
    return row_email_tokens([(col(n), type_of(gold, n)) for n in names]) if names else None


def _result_emails(rows):
    names = [n for n in rows.columns if compact(n) == "matchingemail"]
    return row_email_tokens([(col(n), type_of(rows, n)) for n in names]) if names else None


def lookup(rows, table, keys):
    """Left join with a table unique on keys, even when many rows share a key."""
    return attach_groups(rows, table, keys)


IDENTITY = (NAME, "_employer", "_title", "_addresses")
PATTERN = (NAME, "match_employer", "match_title")


def _variants(gold):
    """Each gold row under every pattern that covers it; null stands for "any"."""
    e, t, nothing = F.col("_employer"), F.col("_title"), F.lit(None).cast("string")
    pairs = F.array(
        *(F.struct(x.alias("match_employer"), y.alias("match_title")) for x in (e, nothing) for y in (t, nothing))
    )
    return gold.select("*", F.inline(pairs))


def match_gold(rows, gold):
    """How result rows match gold rows, without forming pairs: one row per distinct (name, employer, title, addresses).

    Rows match by name; employer, then title, then address narrow the match, each only if some gold row is left. The outcome
    is a pattern: match_employer, match_title and by_email, where null or false means that the part does not matter.
    result_rows counts the result rows of the identity, gold_rows the gold rows of its pattern before addresses are used.
    """
    identities = rows.select(*(v.alias(n) for n, v in _features(rows, _result_emails(rows)).items()))
    grouped = identities.filter(F.col(NAME) != "").groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("result_rows"))
    left = grouped
    known = _gold_identities(gold)
    counts = _variants(known).groupBy(*PATTERN).agg(F.count(F.lit(1)).alias("_n"))
    # Each identity asks for the gold rows of its four patterns at once; the answers come back together under the identity.
    asked = lookup(_variants(left), counts, list(PATTERN))
    e_free, t_free = F.col("match_employer").isNull(), F.col("match_title").isNull()
    answers = asked.groupBy(*IDENTITY, "result_rows").agg(
        F.max(F.when(e_free & t_free, F.col("_n"))).alias("_n"),
        F.max(F.when(~e_free & t_free, F.col("_n"))).alias("_n_e"),
        F.max(F.when(e_free & ~t_free, F.col("_n"))).alias("_n_t"),
        F.max(F.when(~e_free & ~t_free, F.col("_n"))).alias("_n_et"),
    )
    by_employer = (F.col("_employer") != "") & F.col("_n_e").isNotNull()
    title_count = F.when(by_employer, F.col("_n_et")).otherwise(F.col("_n_t"))
    by_title = (F.col("_title") != "") & title_count.isNotNull()
    gold_rows = F.when(by_title, title_count).when(by_employer, F.col("_n_e")).otherwise(F.col("_n"))
    found = answers.filter("_n is not null").select(
        *IDENTITY, "result_rows",
        F.when(by_employer, F.col("_employer")).alias("match_employer"),
        F.when(by_title, F.col("_title")).alias("match_title"),
        gold_rows.alias("gold_rows"),
    )
    return _with_email_match(found, known)


def _gold_identities(gold, *extra):
    features = _features(gold, _gold_emails(gold))
    return gold.select(*extra, *(v.alias(n) for n, v in features.items())).filter(F.col(NAME) != "")


def _with_email_match(found, known):
    """Whether an address of the identity occurs among the gold rows of its pattern."""
    keys = [*PATTERN, "_address"]
    asked = found.select(*IDENTITY, *PATTERN[1:], F.explode("_addresses").alias("_address"))
    addressed = _variants(known.withColumn("_address", F.explode("_addresses")))
    present = addressed.select(*keys).distinct().withColumn("_present", F.lit(True))
    hits = lookup(asked, present, keys).filter("_present").select(*IDENTITY).distinct().withColumn("by_email", F.lit(True))
    joined = found.join(hits, list(IDENTITY), "left")
    return joined.withColumn("by_email", F.coalesce("by_email", F.lit(False)))


def matched_gold(rows, gold, row_id=ROW_ID):
    """The gold rows that some result row matches."""
    patterns = match_gold(rows, gold)
    variants = _variants(_gold_identities(gold, row_id))
    plain = patterns.filter("not by_email").select(*PATTERN).distinct().withColumn("_hit", F.lit(True))
    by_address = (
        patterns.filter("by_email").select(*PATTERN, F.explode("_addresses").alias("_address")).distinct().withColumn("_hit", F.lit(True))
    )
    ids = lookup(variants, plain, list(PATTERN)).filter("_hit").select(row_id)
    addressed = variants.withColumn("_address", F.explode("_addresses"))
    more = lookup(addressed, by_address, [*PATTERN, "_address"]).filter("_hit").select(row_id)
    return gold.join(ids.unionAll(more).distinct(), row_id, "left_semi")


def check_composition(composite, fuzzy, exact, logic="and", buckets=("direct", "adjacent", "uncertain"), row_id=ROW_ID):
    """Rows (bucket, row id, problem) where a composite bucket is not the fuzzy bucket combined with the exact rows. Empty if all agree."""
    wanted = fuzzy.filter(F.col("bucket").isin(*buckets)).select("bucket", row_id).distinct()
    exact_ids = exact.select(row_id).distinct()
    if logic == "and":
        wanted = wanted.join(exact_ids, row_id, "left_semi")
    else:
        every = exact_ids.select(F.explode(F.array(*map(F.lit, buckets))).alias("bucket"), row_id)
        wanted = wanted.unionByName(every).distinct()
    seen = composite.filter(F.col("bucket").isin(*buckets)).select("bucket", row_id).distinct()
    keys = ["bucket", row_id]
    missing = wanted.join(seen, keys, "left_anti").withColumn("problem", F.lit("missing"))
    surplus = seen.join(wanted, keys, "left_anti").withColumn("problem", F.lit("surplus"))
    return missing.unionByName(surplus)


def bucket_overlap(rows, buckets=("direct", "adjacent", "uncertain")):
    """Names that occur in more than one bucket."""
    named = rows.filter(F.col("bucket").isin(*buckets)).select(norm_text(row_name(rows)).alias("name"), "bucket")
    return (
        named.filter("name != ''").groupBy("name").agg(F.countDistinct("bucket").alias("bucket_count")).filter("bucket_count > 1")
    )


def expected_rows(gold, spec=None, industries=None, label="expected_industry"):
    """Gold rows of a filter spec, or with one of the labels; none without either."""
    if spec is not None:
        return gold.filter(compile_spec(gold, spec))
    if not industries:
        return gold.filter(F.lit(False))
    names = [industries] if isinstance(industries, str) else list(industries)
    return gold.filter(F.lower(col(label)).isin(*(str(n).lower() for n in names)))


def eval_report(cases):
    """One row: cases, passes, pass rate, mean precision and recall, unknown names and model calls over scored cases."""
    total, passed = F.count(F.lit(1)), F.count(F.when(F.col("passed"), 1))
    calls = F.coalesce(F.col("total_model_calls"), F.lit(0))
    return cases.agg(
        total.alias("total_cases"), passed.alias("passed"), (total - passed).alias("failed"),
        F.coalesce(F.round(F.try_divide(passed, total), 4), F.lit(0.0)).alias("pass_rate"),
        F.round(F.avg("precision"), 4).alias("average_precision"), F.round(F.avg("recall"), 4).alias("average_recall"),
        F.coalesce(F.sum("unknown_names"), F.lit(0)).alias("total_unknown_names"),
        F.coalesce(F.sum(calls), F.lit(0)).alias("total_model_calls"),
        F.count(F.when(calls > 0, 1)).alias("cases_with_model_calls"),
        F.count(F.when(calls == 0, 1)).alias("cases_without_model_calls"),
    )


def report_breakdown(cases, by="answer_source"):
    """Cases per answer source."""
    return cases.groupBy(F.coalesce(col(by), F.lit("unknown")).alias(by)).agg(F.count(F.lit(1)).alias("cases"))
