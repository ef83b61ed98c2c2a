"""CSV in and out, header repair, absent-value texts, and row identity."""

from __future__ import annotations

import re
from collections import Counter
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rollbook.functions.missing import is_text, strip
from rollbook.session import saved

ROW_ID = "_row_id"

# Cell texts a CSV loader turns into null by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Headers with these prefixes hold answer keys and are never shown to the application.
ANSWER_KEY_PREFIXES = ("expected_", "eval_")


def unique_columns(names):
    """Trimmed header names; blank ones become "Unnamed" and repeats get _2, _3, ..."""
    seen = Counter()
    result = []
    for name in names:
        base = str(name).strip()
        if not base or base.lower() == "nan":
            base = "Unnamed"
        seen[base] += 1
        result.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return result


def with_unique_columns(df):
    return df.toDF(*unique_columns(df.columns))


def null_tokens(df, tokens=NA_TOKENS, columns=None):
    """Turn the texts a loader treats as absent into null."""
    wanted = set(columns or df.columns)
    projected = []
    for field in df.schema:
        cell = F.col(f"`{field.name}`")
        if field.name in wanted and is_text(field.dataType):
            cell = F.when(~cell.isin(*tokens), cell)
        projected.append(cell.alias(field.name))
    return df.select(*projected)


def read_csv(spark, path, multiline=False, trim_cells=False, na_tokens=None):
    """A headed CSV as text columns. Large files are split over tasks; multiline=True reads cells with quoted
    line breaks, at the price of one task per file."""
    header = (
        spark.read.option("header", False).option("multiLine", multiline).option("escape", '"').csv(path).limit(1)
    )
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    df = reader.csv(path)
    first = header.first()
    df = df.toDF(*unique_columns(["" if cell is None else cell for cell in first])) if first else df
    if trim_cells:
        df = drop_blank_rows(df.select(*(strip(F.col(f"`{c}`")).alias(c) for c in df.columns)))
    return null_tokens(df, na_tokens) if na_tokens else df


def drop_blank_rows(df):
    """Drop rows in which every cell is empty."""
    filled = [F.coalesce(strip(F.col(f"`{c}`").cast("string")), F.lit("")) != "" for c in df.columns]
    keep = filled[0]
    for test in filled[1:]:
        keep = keep | test
    return df.filter(keep)


def write_csv(df, path):
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def free_row_id_name(columns):
    name = ROW_ID
    while name in columns:
        name = f"_{name}"
    return name


MAX_FILES = 100_000
FILE_ROWS = 40  # bits of a row's place in its file


def _plain_path(path):
    """A file's address without escapes and with one slash behind the scheme, as two listings of Spark differ in both."""
    return re.sub("^([^:/]+):/+", r"\1:/", unquote(path))


def _placed(df, name):
    """Ids from the file and the place of each row in it, or None where rows don't come straight from Parquet files.

    They are the same in every read of the same files, so nothing has to be written.
    """
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return None
    files = sorted({_plain_path(f) for f in df.inputFiles()})
    if not files or len(files) > MAX_FILES or len(files) >= 1 << (63 - FILE_ROWS) or {"_file", "_place"} & set(df.columns):
        return None
    if len(files) == 1:
        number = F.lit(0)
    else:
        listed = df.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "_file string, _number long")
        decoded = F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))
        rows = rows.withColumn("_file", F.regexp_replace(decoded, "^([^:/]+):/+", "$1:/"))
        rows = rows.join(F.broadcast(listed), "_file", "left")  # at most MAX_FILES rows
        number = F.coalesce("_number", F.raise_error(F.concat(F.lit("Unknown file "), F.col("_file"))).cast("long"))
    place = F.shiftleft(number.cast("long"), FILE_ROWS) + F.col("_place")
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))


def with_row_id(df, key=None, name=None, check=True):
    """Stable row identity. An integer key is used as it is; a repeated or missing one raises ValueError, unless check is off.

    Without a key, rows that come straight from Parquet files are named by file and place. Ids of other rows follow the scan order,
    and the table is written to the shared folder once, here, so that every later read of the result has the same ids.
    """
    name = name or free_row_id_name(df.columns)
    if key:
        value = F.col(f"`{key}`").cast("long")
        if check:
            bad = df.groupBy(value.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or k is null").limit(1).collect()
            if bad:
                raise ValueError(f"Column '{key}' is no key: {'a value is missing' if bad[0]['k'] is None else 'value ' + str(bad[0]['k']) + ' is repeated'}.")
        return df.withColumn(name, value)
    placed = _placed(df, name)
    return placed if placed is not None else saved(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def is_answer_key(name):
    return str(name).strip().lower().startswith(ANSWER_KEY_PREFIXES)


def app_view(df):
    """The table without its answer-key columns."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not is_answer_key(c)))
