"""People filters: one bucket per person, alone or combined with exact predicates.

A person may have any number of rows. Rows that are in no bucket become one group, of which a task sends one row. One aggregation
per person picks the rows to show by row id (minima and maxima, combined before the shuffle), together with their cells. No
window, no sort by person and no second pass over the table is involved, so a person with a third of all rows costs no more
than their partial aggregates.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import functions as F

from rollbook.functions.missing import as_text, is_blank, type_of
from rollbook.functions.text import norm_compact, norm_text, term_pattern
from rollbook.operators.columns import find_column, people_selection, person_column, resolve_column
from rollbook.operators.order import sort_key
from rollbook.operators.predicates import compile_group, matching_email
from rollbook.operators.sampling import col, data_columns
from rollbook.operators.skew import attach_groups, spread
from rollbook.plans.classify import ADJACENT, UNCERTAIN, classify
from rollbook.plans.lookup import attach_hits
from rollbook.plans.taxonomy import SEED, TermTable, industry_key
from rollbook.session import saved
from rollbook.sources.files import ROW_ID

BUCKETS = ("counted", "direct", "adjacent", "uncertain")

# Columns that identify a person when names do not, in order.
ID_COLUMNS = ("Constituent ID", "Alumni ID", "NetID", "Net ID", "Email", "Email Address")


def person_key(df, profile=None, id_columns=ID_COLUMNS, row_id=ROW_ID):
    """Identity of a person: first and last name, else a full name, else an id or address, else the row itself."""
    columns = data_columns(df)

    def key(kind, *names):
        cells = [as_text(col(n), type_of(df, n)) for n in names]
        present = reduce(lambda a, b: a & b, (~is_blank(col(n), type_of(df, n)) for n in names))
        return F.when(present, F.concat_ws("|", F.lit(kind), *(norm_compact(c) for c in cells)))

    first, last = (person_column(columns, f, profile) for f in ("first_name", "last_name"))
    choices = [key("name", first, last)] if first and last else []
    full = find_column(columns, "person_name", profile)
    choices += [key("person", full)] if full else []
    found = (find_column(columns, name, profile) for name in id_columns)
    choices += [key("stable", name) for name in dict.fromkeys(found) if name]
    return F.coalesce(*choices, F.concat_ws("|", F.lit("row"), col(row_id).cast("string")))


def dedupe_people(df, profile=None, row_id=ROW_ID):
    """The first row of each person: the least row id per person, then the rows with those ids."""
    first = df.groupBy(person_key(df, profile, row_id=row_id).alias("_person")).agg(F.min(col(row_id)).alias("_first")).select("_first")
    return df.join(first, col(row_id) == F.col("_first"), "left_semi")


def _judged(df, spec, taxonomies, profile, row_id, *extra):
    """Rows (person, row id, verdict flags) of a classification. The rules cost much for each row, so rows are dealt over tasks first."""
    rows = classify(spread(df), spec, taxonomies, profile, details=False)
    counted, name = F.col("count_as_match"), F.col("classification")
    return rows.select(
        person_key(df, profile, row_id=row_id).alias("_person"),
        col(row_id).alias("_id"),
        counted.alias("_counted"),
        (counted & (name != ADJACENT)).alias("_direct"),
        (~counted & (name == ADJACENT)).alias("_adjacent"),
        (~counted & (name == UNCERTAIN)).alias("_uncertain"),
        *extra,
    )


def _when(flag):
    return F.when(F.col(flag), F.col("_id"))


# First counted row, last direct row (a later direct row replaces an earlier one), first adjacent and first uncertain row.
PICKS = {
    "counted": (F.min_by, "_counted"), "direct": (F.max_by, "_direct"), "adjacent": (F.min_by, "_adjacent"), "uncertain": (F.min_by, "_uncertain"),
}


def _beside():
    """A person who counts is not shown as adjacent, and one who is either is not shown as uncertain."""
    return {
        "adjacent": F.when(F.col("counted").isNull(), F.col("adjacent")),
        "uncertain": F.when(F.col("counted").isNull() & F.col("adjacent").isNull(), F.col("uncertain")),
    }


def _per_person(judged, *extra):
    chosen = judged.groupBy("_person").agg(*(best(F.col("_id"), _when(flag)).alias(name) for name, (best, flag) in PICKS.items()), *extra)
    return chosen.withColumns(_beside())


def _cells(df, profile, columns, row_id, extra=None):
    """Names and cells of the rows to show."""
    shown = df.withColumns(extra or {}).select(*people_selection(df, profile, columns), *(col(n) for n in extra or {}), col(row_id))
    cells = [*people_selection(df, profile, columns), *(extra or {}).values(), col(row_id)]
    return shown.columns, F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cells))).alias("_cells")


FLAGS = ("_counted", "_adjacent", "_uncertain")


def _flagged(judged, *more):
    """Rows in no bucket lose their person: they meet in one group a task, which shows no row.

    A filter would be pushed through all rules of the classification, repeating them wherever it names a flag.
    """
    return judged.withColumn("_person", F.when(reduce(or_, (F.col(flag) for flag in (*FLAGS, *more))), F.col("_person")))


def _chosen(judged, exact=False):
    """Per person the rows to show, whole, under the same choice as _per_person; with exact also the first exact row."""
    row = F.struct("_id", "_cells", *(["_exact"] if exact else []))
    picks = {name: best(row, _when(flag)).alias(name) for name, (best, flag) in PICKS.items()}
    chosen = judged.groupBy("_person").agg(*picks.values(), *([F.min_by(row, _when("_exact")).alias("exact")] if exact else []))
    return chosen.withColumns(_beside())


def _listed(chosen):
    """Rows (bucket, row) of the rows to show."""
    pairs = F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).alias("row")) for b in BUCKETS))
    return chosen.select(F.inline(pairs)).filter("row is not null")


def _display(rows, names):
    return rows.select("bucket", *(F.col(f"row._cells.c{i}").alias(n) for i, n in enumerate(names)))


def people_filter(df, spec, taxonomies=SEED, profile=None, columns=None, row_id=ROW_ID):
    """Rows (bucket, people columns, row id): every person in "counted" and "direct", or in "adjacent" or "uncertain"."""
    names, cells = _cells(df, profile, columns, row_id)
    chosen = _chosen(_flagged(_judged(df, spec, taxonomies, profile, row_id, cells)))
    return _display(_listed(chosen), names)


def people_metrics(df, spec, taxonomies=SEED, profile=None, row_id=ROW_ID):
    """One row: rows, people per bucket, and people counted only as adjacent."""
    judged = _judged(df, spec, taxonomies, profile, row_id)
    chosen = _per_person(
        judged, F.count(F.lit(1)).alias("rows"), F.max(F.col("_counted") & ~F.col("_direct")).alias("counted_adjacent")
    )
    return chosen.agg(
        F.sum("rows").alias("total_rows"),
        F.count("counted").alias("total_matches"),
        F.count("direct").alias("direct_count"),
        F.count("adjacent").alias("adjacent_count"),
        F.count("uncertain").alias("uncertain_count"),
        F.count(F.when(F.col("counted_adjacent"), 1)).alias("adjacent_included_count"),
    )


def _term_hits(df, columns, terms):
    """How many terms occur in some of the columns."""
    texts = [F.coalesce(norm_text(as_text(col(n), type_of(df, n))), F.lit("")) for n in columns]

    def occurs(pattern):
        return reduce(or_, (text.rlike(pattern) for text in texts))

    keep = "a-z0-9"
    patterns = [p for p in (term_pattern([term], keep) for term in dict.fromkeys(terms)) if p]
    hits = reduce(add, (occurs(p).cast("int") for p in patterns))
    return F.when(occurs(term_pattern(terms, keep)), hits).otherwise(0)


def _retrieved(df, spec, terms, columns, taxonomies):
    """Rows with the number of retrieval terms that occur in some of the columns: those given, and those of the specification.

    An industry brings its companies and retrieval terms; employers and titles that are asked for are terms themselves.
    """
    spark = df.sparkSession
    given = list(dict.fromkeys(t.strip() for t in (*terms, *spec.employers, *spec.titles) if t.strip()))
    listed = spark.createDataFrame([(t,) for t in given], "term string")
    if not (spec.employers or spec.titles):
        wanted = [industry_key(i) for i in spec.industries]
        if isinstance(taxonomies, TermTable):
            more = taxonomies.table.where(F.col("industry").isin(wanted) & F.col("kind").isin("company", "retrieval")).select(F.btrim("term").alias("term"))
        else:
            more = spark.createDataFrame([(t.strip(),) for i in wanted for kind in ("company", "retrieval") for t in taxonomies.terms(i, kind)], "term string")
        listed = listed.unionByName(more).distinct()
    names = [f"_search{i}" for i in range(len(columns))]
    texts = {n: F.coalesce(norm_text(as_text(col(c), type_of(df, c))), F.lit("")) for n, c in zip(names, columns)}
    searched = listed.select(F.explode(F.array(*map(F.lit, names))).alias("field"), norm_text("term").alias("folded"), "term")
    searched = searched.select("field", F.col("folded").alias("term"), F.lit(False).alias("whole"), F.col("term").alias("code"))
    rows = attach_hits(df.withColumns(texts), {n: (n,) for n in names}, searched, "_retrieved").drop(*names)
    return rows, F.when(F.col("_retrieved").isNotNull(), F.size("_retrieved")).otherwise(0)


def candidate_metrics(df, spec, terms, columns, taxonomies=SEED, profile=None, row_id=ROW_ID, retrieval=False):
    """One row: keyword hits, rows with a hit, and such rows that no bucket took up.

    With retrieval, the companies and retrieval terms of the vocabulary are keywords too, looked up by a join.
    A row is taken up when it counts, when it is adjacent and its person has not counted before it, or when it is uncertain
    and its person has neither counted nor been adjacent before it.
    """
    rows = df
    if retrieval:
        rows, hits = _retrieved(df, spec, terms, columns, taxonomies)
    else:
        hits = _term_hits(df, columns, terms)
    # Written once: a person's verdicts and the rows they apply to are both needed, and the rules should run once.
    judged = saved(_judged(rows, spec, taxonomies, profile, row_id, hits.alias("_hits")), "candidates")
    # Only rows with a hit are counted, and only counted and adjacent rows say anything about their person.
    people = judged.filter(F.col("_counted") | F.col("_adjacent")).groupBy("_person").agg(
        F.min(_when("_counted")).alias("_first_counted"),
        F.least(F.min(_when("_counted")), F.min(_when("_adjacent"))).alias("_first_related"),
    )
    rows = attach_groups(judged.filter("_hits > 0"), people, ["_person"])
    before_counted = F.col("_first_counted").isNull() | (F.col("_id") < F.col("_first_counted"))
    before_related = F.col("_first_related").isNull() | (F.col("_id") < F.col("_first_related"))
    taken = F.col("_counted") | (F.col("_adjacent") & before_counted) | (F.col("_uncertain") & before_related)
    candidate = F.col("_hits") > 0
    return rows.agg(
        F.coalesce(F.sum("_hits"), F.lit(0)).alias("raw_match_count"),
        F.count(F.when(candidate, 1)).alias("candidate_count"),
        F.count(F.when(candidate & ~taken, 1)).alias("non_match_count"),
    )


def _united(chosen):
    """Buckets of "fuzzy or exact": exact rows join counted and direct, and a row shown there leaves the other buckets."""
    exact = F.col("exact")

    def joined(bucket):
        row = F.col(bucket)
        other = F.when(~exact["_id"].eqNullSafe(row["_id"]), exact)
        return F.transform(F.array_compact(F.array(row, other)), lambda r: F.struct(F.lit(bucket).alias("bucket"), r.alias("row")))

    def unless_exact(bucket):
        row = F.when(~F.col(bucket)["_id"].eqNullSafe(exact["_id"]), F.col(bucket))
        return F.transform(F.array_compact(F.array(row)), lambda r: F.struct(F.lit(bucket).alias("bucket"), r.alias("row")))

    buckets = F.concat(joined("counted"), joined("direct"), unless_exact("adjacent"), unless_exact("uncertain"))
    return chosen.select(F.inline(buckets))


def composite_filter(df, spec, group, logic="and", taxonomies=SEED, profile=None, columns=None, row_id=ROW_ID, sort=None, limit=None):
    """People buckets combined with exact predicates.

    "and" keeps the shown rows that meet the predicates. A person's counted and direct row can differ, so the two buckets
    can keep different people. "or" adds the first matching row of each person to both. E-mail predicates add the column
    "Matching Email". sort is {"column", "direction"} of a column of the table; a limit takes the first rows in that order,
    or by bucket and row id.
    """
    if logic not in ("and", "or"):
        raise ValueError("Logic must be and or or.")
    emails = matching_email(df, group)
    extra = {"Matching Email": emails} if emails is not None else {}
    key = {}
    if sort:
        key = {"_sort": sort_key(df, resolve_column(df.columns, sort["column"]))}
    names, cells = _cells(df, profile, columns, row_id, {**extra, **key})
    exact = df.withColumn("_exact", F.coalesce(compile_group(df, group), F.lit(False)))
    judged = _judged(exact, spec, taxonomies, profile, row_id, F.col("_exact"), cells)
    if logic == "and":
        rows = _listed(_chosen(_flagged(judged), exact=True)).filter("row._exact")
    else:
        rows = _united(_chosen(_flagged(judged, "_exact"), exact=True))
    shown = _display(rows, names)
    order = [F.col("bucket"), col(row_id)]
    if sort:
        ascending = str(sort.get("direction") or "desc").lower().startswith("asc")
        order.insert(0, F.col("_sort").asc_nulls_last() if ascending else F.col("_sort").desc_nulls_last())
    if sort or limit is not None:
        shown = shown.orderBy(*order)
    shown = shown.drop("_sort") if sort else shown
    return shown if limit is None else shown.limit(limit)


def composite_metrics(df, spec, group, logic="and", taxonomies=SEED, profile=None, row_id=ROW_ID):
    """One row: shown rows per bucket after composition."""
    shown = composite_filter(df, spec, group, logic, taxonomies, profile, row_id=row_id)
    return shown.agg(*(F.count(F.when(F.col("bucket") == b, 1)).alias(f"{b}_count") for b in BUCKETS))
