"""Mapping of unfamiliar column headers to canonical fields.

The work is a few joins and windows over a table of candidates (source, canonical_field, confidence, method, evidence) that has
a handful of rows per column. Cell evidence comes from the values of sampled or whole columns, which are dealt over tasks and
parsed only by the tests their column's header leaves open; no task keeps the values of a column.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F
from pyspark.sql import types as T

from rollbook.functions.dates import lenient_moment
from rollbook.functions.emails import email_tokens, mask_emails
from rollbook.functions.missing import as_text, is_null, strip, type_of
from rollbook.functions.numbers import LENIENT_SHAPE
from rollbook.operators.columns import compact
from rollbook.operators.sampling import cells, col, data_columns, distinct_values, first_values, leading
from rollbook.operators.skew import spread
from rollbook.plans import registry as R
from rollbook.sources.files import ROW_ID

MAX_YEAR_AHEAD = 10
MAX_EVIDENCE = 5


def _type_word(data_type):
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(data_type, T.IntegralType):
        return "integer"
    return "number" if isinstance(data_type, T.NumericType) else "text"


def column_metadata(df, samples=3, row_id=ROW_ID):
    """Per column: type, null and distinct counts, and the first distinct values with addresses masked."""
    names = data_columns(df)
    counters = []
    for i, name in enumerate(names):
        absent = is_null(col(name), type_of(df, name))
        counters.append(F.count(F.when(absent, 1)).alias(f"m{i}"))
    rows = F.array(
        *(
            F.struct(
                F.lit(n).alias("column"), F.lit(_type_word(type_of(df, n))).alias("type"),
                F.col(f"m{i}").alias("missing_count"),
            )
            for i, n in enumerate(names)
        )
    )
    summary = df.agg(*counters).select(F.inline(rows))
    values = distinct_values(df, names, is_null, row_id)
    unique = values.groupBy("column").agg(F.count(F.lit(1)).alias("unique"))
    masked = leading(values, samples).withColumn("value", mask_emails(strip(F.col("value")))).filter("value != ''")
    ordered = F.array_sort(F.collect_list(F.struct("position", "value")))
    listed = masked.groupBy("column").agg(F.transform(ordered, lambda item: item["value"]).alias("sample_values"))
    joined = summary.join(unique, "column", "left").join(listed, "column", "left")
    return joined.select(
        "column", "type", "missing_count", F.coalesce("unique", F.lit(0)).cast("long").alias("unique_count"), "sample_values"
    )


def _literal_rows(spark, names, rows):
    """A small table whose rows are part of the query, so that it needs no scan."""

    def literal(value):
        if isinstance(value, int):
            return str(value)
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    listed = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})")


def _columns_table(df):
    rows = [(n, i, compact(n)) for i, n in enumerate(data_columns(df))]
    return _literal_rows(df.sparkSession, ("source", "ordinal", "header"), rows)


def header_candidates(df):
    """Candidates from headers alone: aliases exactly or in compact form, and header shapes."""
    headers = _columns_table(df)
    known = [(field, alias, compact(alias)) for field, names in R.FIELD_ALIASES.items() for alias in names]
    aliases = _literal_rows(df.sparkSession, ("canonical_field", "alias", "alias_header"), known)
    by_alias = (
        headers.join(aliases, headers.header == aliases.alias_header)
        .groupBy("source", "ordinal", "canonical_field")
        .agg(F.max(F.trim("source") == F.col("alias")).alias("exact"))
        .select(
            "source", "ordinal", "canonical_field",
            F.when(F.col("exact"), R.EXACT_ALIAS).otherwise(R.COMPACT_ALIAS).alias("confidence"),
            F.when(F.col("exact"), F.lit("exact_alias")).otherwise(F.lit("normalized_alias")).alias("method"),
            F.lit("The header is a known alias.").alias("evidence"),
        )
    )
    shapes = F.array(
        *(
            F.when(
                F.col("header").rlike(shape),
                F.struct(F.lit(field).alias("canonical_field"), F.lit(confidence).alias("confidence")),
            )
            for field, shape, confidence in R.HEADER_SHAPES
        )
    )
    by_shape = headers.select("source", "ordinal", F.inline(F.array_compact(shapes))).select(
        "*", F.lit("header_heuristic").alias("method"), F.lit("The header has the shape of this field.").alias("evidence")
    )
    return by_alias.unionByName(by_shape)


def _values(df, names, sample, row_id):
    """Rows (column, value): the present values of the columns, or their first ones if a sample is asked for."""
    if not names:
        return _literal_rows(df.sparkSession, ("column", "value"), [("", "")]).where("value <> ''")
    if sample is not None:
        return first_values(df, names, sample, missing=is_null, row_id=row_id).select("column", "value")
    texts = spread(df.select(*(as_text(col(n), type_of(df, n)).alias(f"c{i}") for i, n in enumerate(names))))
    return texts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("value")) for i, n in enumerate(names)))))


KINDS = ("email", "linkedin", "year", "boolean", "number", "date")


def sample_rates(df, sample=None, row_id=ROW_ID, this_year=None, asked=None):
    """Per column: how many filled values there are and which share looks like each kind of content.

    asked: {kind: columns} leaves out all other tests; their shares are 0, and columns that no test is asked of are not read.
    """
    names = data_columns(df)
    asked = {kind: names if asked is None else [n for n in names if n in asked.get(kind, ())] for kind in KINDS}
    text = strip(F.col("value"))
    year = F.regexp_extract(text, r"^(\d{4})(?:\.0)?$", 1)
    last = F.lit(this_year).cast("int") if this_year else F.year(F.current_date())
    bare = F.regexp_replace(text, r"[$,%\s]", "")
    tests = {
        "email": F.size(email_tokens(F.col("value"))) > 0,
        "linkedin": F.lower(text).contains("linkedin.com/"),
        "year": year.try_cast("int").between(1900, last + MAX_YEAR_AHEAD),
        "boolean": F.lower(text).isin("true", "false", "yes", "no", "y", "n", "1", "0"),
        "number": bare.rlike(LENIENT_SHAPE),
        "date": lenient_moment(F.col("value"), T.StringType()).isNotNull(),
    }
    filled = _values(df, [n for n in names if any(n in columns for columns in asked.values())], sample, row_id).filter(text != "")
    return filled.groupBy("column").agg(
        F.count(F.lit(1)).alias("filled"),
        *(
            (F.count(F.when(F.col("column").isin(asked[kind]) & test, 1)) / F.count(F.lit(1))).alias(f"{kind}_rate")
            if asked[kind] else F.lit(0.0).alias(f"{kind}_rate")
            for kind, test in tests.items()
        ),
    )


def _open_tests(df):
    """The tests by which each column can still become a candidate: its header rules out the others. Free text has none."""
    marks = {"year": ("grad", "class", "year", "yr"), "boolean": ("contact", "optout", "dnc", "donot"), "number": ("gift", "giving"), "date": ("date", "dt")}
    headers = {n: compact(n) for n in data_columns(df)}
    told = {n: header for n, header in headers.items() if not any(mark in header for mark in R.FREE_TEXT_MARKS)}
    texts = {n for n in told if isinstance(type_of(df, n), T.StringType)}  # no number or date reads as an address
    return {kind: [n for n in told if (n in texts if kind not in marks else any(mark in told[n] for mark in marks[kind]))] for kind in KINDS}


def sample_candidates(df, sample=None, row_id=ROW_ID, this_year=None):
    """Candidates from cell contents, together with what the header says. Free-text columns are skipped."""
    rates = sample_rates(df, sample, row_id, this_year, _open_tests(df))
    header = F.col("header")

    def mentions(*marks):
        return header.rlike("|".join(marks))

    several = F.col("filled") >= 2
    dated = mentions("date", "dt") & (F.col("date_rate") >= 0.80)
    rules = (
        ("email", several & (F.col("email_rate") >= 0.85), F.when(mentions("email", "eml"), 0.88).otherwise(0.72)),
        ("linkedin_url", several & (F.col("linkedin_rate") >= 0.80), F.when(mentions("linkedin"), 0.90).otherwise(0.82)),
        ("grad_year", several & (F.col("year_rate") >= 0.85) & mentions("grad", "class", "year", "yr"), F.lit(0.84)),
        ("do_not_contact", (F.col("boolean_rate") >= 0.90) & mentions("contact", "optout", "dnc", "donot"), F.lit(0.82)),
        ("lifetime_giving", (F.col("number_rate") >= 0.85) & mentions("gift", "giving"), F.lit(0.76)),
        ("last_contact_date", dated & mentions("contact"), F.lit(0.79)),
        ("last_gift_date", dated & mentions("gift") & ~mentions("contact"), F.lit(0.79)),
    )
    found = F.array(
        *(
            F.when(test, F.struct(F.lit(field).alias("canonical_field"), confidence.alias("confidence")))
            for field, test, confidence in rules
        )
    )
    joined = _columns_table(df).join(rates, F.col("source") == F.col("column")).filter(~mentions(*R.FREE_TEXT_MARKS))
    return joined.select("source", "ordinal", F.inline(F.array_compact(found))).select(
        "*", F.lit("sample_inference").alias("method"), F.lit("Most sampled values look like this field.").alias("evidence")
    )


def confidence_label(confidence):
    return F.when(confidence >= R.HIGH, F.lit("high")).when(confidence >= R.MEDIUM, F.lit("medium")).otherwise(F.lit("low"))


def schema_candidates(df, sample=None, row_id=ROW_ID, this_year=None):
    """Best candidate per source and field.

    There are a few candidates per column of the table, however many rows it has, so they fit one partition and the windows
    over them need no shuffle. They are sent there: a task that read all partitions of the steps before it would hold their buffers
    at once.
    """
    both = header_candidates(df).unionByName(sample_candidates(df, sample, row_id, this_year)).repartition(1)
    best = F.max_by(F.struct("method", "evidence"), "confidence")
    merged = both.groupBy("source", "ordinal", "canonical_field").agg(F.max("confidence").alias("confidence"), best.alias("_best"))
    return merged.select("source", "ordinal", "canonical_field", "confidence", "_best.method", "_best.evidence")


def _best_per_source(candidates):
    """Leading candidate per source, marked as contested when another field comes within the gap."""
    order = Window.partitionBy("source").orderBy(F.desc("confidence"), "canonical_field")
    whole = Window.partitionBy("source")
    top = F.max("confidence").over(whole)
    ranked = candidates.withColumn("_rank", F.row_number().over(order)).withColumn(
        "_close", F.sum((F.col("confidence") >= F.round(top - R.SOURCE_GAP, 6)).cast("int")).over(whole)
    )
    return ranked.filter("_rank = 1").withColumn("contested", F.col("_close") > 1)


def _assignments(candidates):
    """Uncontested sources per field in order of confidence, with the field's own conflicts marked."""
    chosen = _best_per_source(candidates).filter("not contested")
    field = Window.partitionBy("canonical_field")
    order = field.orderBy(F.desc("confidence"), "ordinal")
    top = F.max("confidence").over(field)
    single = ~F.col("canonical_field").isin(*R.MULTI_SOURCE_FIELDS)
    return (
        chosen.withColumn("_place", F.row_number().over(order))
        .withColumn("_near", F.sum((F.col("confidence") >= F.round(top - R.FIELD_GAP, 6)).cast("int")).over(field))
        .withColumn("_single", single)
        .withColumn("conflicted", single & (F.col("_near") > 1))
        .withColumn("kept", ~F.col("conflicted") & (~single | (F.col("_place") == 1)))
    )


def infer_schema(df, sample=None, row_id=ROW_ID, this_year=None):
    """Profile rows (canonical_field, source_columns, confidence, label, method, user_confirmed, evidence).

    evidence lists the different grounds of the mapped sources in their order, MAX_EVIDENCE at most.
    """
    assigned = _assignments(schema_candidates(df, sample, row_id, this_year)).filter("kept")
    ordered = F.array_sort(F.collect_list(F.struct("_place", "source")))
    profile = assigned.groupBy("canonical_field").agg(
        F.transform(ordered, lambda item: item["source"]).alias("source_columns"),
        F.min("confidence").alias("confidence"),
        F.when(F.countDistinct("method") == 1, F.first("method")).otherwise(F.lit("combined_inference")).alias("method"),
        F.transform(F.array_sort(F.collect_list(F.struct("_place", "evidence"))), lambda item: item["evidence"]).alias("_grounds"),
    )
    return profile.select(
        "canonical_field", "source_columns", "confidence", confidence_label(F.col("confidence")).alias("label"), "method",
        F.lit(False).alias("user_confirmed"), F.slice(F.array_distinct("_grounds"), 1, MAX_EVIDENCE).alias("evidence"),
    )


def unmapped_columns(profile, columns, ignored=()):
    """Rows (ordinal, source) of the columns that no profile row maps and that are not ignored, in table order."""
    spark = profile.sparkSession
    listed = [(i, c) for i, c in enumerate(columns) if c not in ignored]
    if not listed:
        return spark.createDataFrame([], "ordinal int, source string")
    mapped = profile.select(F.explode("source_columns").alias("source"))
    return _literal_rows(spark, ("ordinal", "source"), listed).join(mapped, "source", "left_anti").select("ordinal", "source")


def schema_conflicts(df, sample=None, row_id=ROW_ID, this_year=None):
    """Rows (type, canonical_fields, source_columns): sources with rival fields and fields with rival sources."""
    candidates = schema_candidates(df, sample, row_id, this_year)
    contested = _best_per_source(candidates).filter("contested").select("source", F.col("confidence").alias("top"))
    rivals = candidates.join(contested, "source").filter(F.col("confidence") >= F.round(F.col("top") - R.SOURCE_GAP, 6))
    by_source = rivals.groupBy("source").agg(F.sort_array(F.collect_set("canonical_field")).alias("canonical_fields")).select(
        F.lit("source_column_conflict").alias("type"), "canonical_fields", F.array("source").alias("source_columns")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_place", "source")))
    by_field = _assignments(candidates).filter("conflicted").groupBy("canonical_field").agg(
        F.transform(ordered, lambda item: item["source"]).alias("source_columns")
    )
    return by_source.unionByName(
        by_field.select(
            F.lit("single_field_multiple_sources").alias("type"), F.array("canonical_field").alias("canonical_fields"),
            "source_columns",
        )
    )


def validate_mapping(mapping, columns, ignored=()):
    """Check a user's mapping {field: [source, ...]}; raises ValueError with the first problem."""
    owner = {}
    for field, sources in mapping.items():
        if field not in R.FIELDS:
            raise ValueError(f"Unknown canonical field '{field}'.")
        if len(sources) > 1 and field not in R.MULTI_SOURCE_FIELDS:
            raise ValueError(f"Field '{field}' takes one source column.")
        for source in sources:
            if source not in columns:
                raise ValueError(f"Source column '{source}' does not exist.")
            if owner.setdefault(source, field) != field:
                raise ValueError(f"Source column '{source}' is assigned to '{owner[source]}' and '{field}'.")
            if source in ignored:
                raise ValueError(f"Source column '{source}' cannot be mapped and ignored.")
    return {field: list(sources) for field, sources in mapping.items() if sources}


def confirmed_profile(spark, mapping):
    """Profile rows of mappings a user has confirmed."""
    rows = [(field, list(sources), 1.0, "high", "user_confirmed", True, []) for field, sources in mapping.items()]
    return spark.createDataFrame(
        rows,
        "canonical_field string, source_columns array<string>, confidence double, label string, method string, user_confirmed boolean, "
        "evidence array<string>",
    )


def merge_profile(inferred, confirmed, reset=False):
    """Confirmed rows win over inferred ones for the same field or any of the same sources."""
    if reset:
        return inferred
    taken = confirmed.select(F.explode("source_columns").alias("source")).distinct()
    clashing = (
        inferred.select("canonical_field", F.explode("source_columns").alias("source"))
        .join(taken, "source", "left_semi")
        .select("canonical_field")
    )
    kept = inferred.join(confirmed, "canonical_field", "left_anti").join(clashing, "canonical_field", "left_anti")
    return kept.unionByName(confirmed)


def open_conflicts(conflicts, confirmed, reset=False):
    """Conflicts that confirmed rows leave open.

    Conflicts are edges between sources and fields. A confirmed source settles every conflict it is part of; a confirmed field
    settles the one about its rival sources, but not one between fields that rival for a source.
    """
    if reset:
        return conflicts
    settled = confirmed.select(F.explode("source_columns").alias("settled")).select(F.lit("source").alias("end"), "settled").unionByName(
        confirmed.select(F.lit("field").alias("end"), F.col("canonical_field").alias("settled"))
    )
    key = ["type", "canonical_fields", "source_columns"]
    edges = conflicts.select(*key, F.explode("source_columns").alias("settled")).withColumn("end", F.lit("source")).unionByName(
        conflicts.where("type = 'single_field_multiple_sources'").select(*key, F.explode("canonical_fields").alias("settled")).withColumn("end", F.lit("field"))
    )
    return conflicts.join(edges.join(settled, ["end", "settled"], "left_semi").select(*key), key, "left_anti")


def profile_state(inferred, confirmed, conflicts, columns, ignored=(), status=None, reset=False):
    """One row about a profile after merging: its status, the columns in no use, those ignored, and what is still in conflict.

    A status "confirmed" stays; anything else, and a reset, is "unreviewed". Ignored columns that are gone or confirmed are not listed.
    """
    spark = inferred.sparkSession
    merged = merge_profile(inferred, confirmed, reset)
    kept = [] if reset else [c for c in ignored if c in columns]
    used = confirmed.select(F.explode("source_columns").alias("source"))
    left_out = _literal_rows(spark, ("place", "source"), list(enumerate(kept))).join(used, "source", "left_anti") if kept else None
    free = unmapped_columns(merged, columns)
    free = free.join(left_out, "source", "left_anti") if left_out is not None else free

    def in_order(rows, by):
        listed = F.transform(F.array_sort(F.collect_list(F.struct(by, "source"))), lambda r: r["source"])
        return rows.agg(listed.alias("v")).scalar()

    word = "confirmed" if status == "confirmed" and not reset else "unreviewed"
    return open_conflicts(conflicts, confirmed, reset).agg(F.count(F.lit(1)).alias("conflicts")).select(
        F.lit(word).alias("status"), in_order(free, "ordinal").alias("unmapped_columns"),
        (in_order(left_out, "place") if left_out is not None else F.array().cast("array<string>")).alias("ignored_columns"), "conflicts",
    )


def active_mapping(profile, columns=None):
    """{field: [sources]}: confirmed rows first, then inferred ones of high confidence; no source is used twice.

    The profile has at most one row per canonical field, so it is small enough for the driver.
    """
    usable = profile.filter(F.col("user_confirmed") | (F.col("confidence") >= R.HIGH))
    rows = sorted(usable.collect(), key=lambda row: (not row["user_confirmed"], row["canonical_field"]))
    used, active = set(), {}
    for row in rows:
        sources = [s for s in row["source_columns"] if s not in used and (columns is None or s in columns)]
        if sources:
            active[row["canonical_field"]] = sources
            used.update(sources)
    return active


def apply_mapping(df, mapping):
    """Canonical names for mapped columns; fields with several sources become arrays. Other columns keep their names."""
    mapped = {source for sources in mapping.values() for source in sources}
    fields = []
    for field, sources in mapping.items():
        if len(sources) == 1 and field not in R.MULTI_SOURCE_FIELDS:
            fields.append(col(sources[0]).alias(field))
        else:
            fields.append(F.array(*(as_text(col(s), type_of(df, s)) for s in sources)).alias(field))
    taken = set(mapping)
    return df.select(*fields, *(col(n) for n in df.columns if n not in mapped and n not in taken))


def semantic_columns(df, field, mapping=None, samples=None, row_id=ROW_ID):
    """All columns of a field in table order: mapped ones, else by header, and for e-mail also by contents."""
    names = data_columns(df)
    mapped = [s for s in (mapping or {}).get(field, ()) if s in names]
    if mapped:
        return mapped
    wanted = {compact(alias) for alias in R.FIELD_ALIASES.get(field, (field,))}
    if field != "email":
        return [n for n in names if compact(n) in wanted]
    free = [n for n in names if not any(mark in compact(n) for mark in R.FREE_TEXT_MARKS if mark != "memo")]

    def named(name):
        key = compact(name)
        about = any(mark in key for mark in R.EMAIL_METADATA_MARKS)
        return ("email" in key and not about) or key in wanted

    unsure = [n for n in free if not named(n)]
    found = set()
    if unsure:
        values = cells(df, unsure, row_id=row_id) if samples is None else first_values(df, unsure, samples, row_id=row_id)
        hit = (F.size(email_tokens(F.col("value"))) > 0).cast("double")
        rates = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("rate"))
        found = {row["column"] for row in rates.filter("n >= 3 and rate >= 0.8").collect()}
    return [n for n in free if named(n) or n in found]


def schema_summary(profile, columns, conflicts=None, ignored=()):
    """One row: mapped fields, unmapped columns, and conflicts."""
    spark = profile.sparkSession
    sources = profile.select(F.explode("source_columns").alias("source")).distinct()
    headers = spark.createDataFrame([(c,) for c in columns if c not in ignored], "source string")
    unmapped = headers.join(sources, "source", "left_anti").agg(F.count(F.lit(1)).alias("n")).scalar()
    conflicted = conflicts.agg(F.count(F.lit(1)).alias("n")).scalar() if conflicts is not None else F.lit(0).cast("long")
    return profile.agg(
        F.count(F.when(F.size("source_columns") > 0, 1)).alias("schema_mapped_count"),
        F.count(F.when(F.col("user_confirmed"), 1)).alias("schema_confirmed_count"),
    ).select("*", unmapped.alias("schema_unmapped_count"), conflicted.alias("schema_conflict_count"))
