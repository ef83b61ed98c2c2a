"""Terms of a table looked up in texts by the words they hold.

A term that is one word meets the equal words of a text. A longer one meets the places where two words follow each other, by the
last letters of its first word and the first letters of its second; what meets is then tested whole. So texts and terms are
joined by equality, the plan does not grow with the list, and a list too large to broadcast is shuffled like any table.

Texts are looked up once each, however many rows show them, and what they hold is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions.text import norm_company, norm_title
from rollbook.operators.skew import attach_groups, spread

REACH = 2
NO_WORD = "*"


def words_of(text):
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")


def text_keys(text):
    """Distinct keys under which a folded text can hold a term."""
    words = words_of(text)
    following = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(words, 1, following).alias("a"), F.slice(words, 2, following).alias("b"))
    joints = F.flatten(F.transform(pairs, lambda p: F.array(*(
        F.concat(F.right(p["a"], F.lit(i)), F.lit(" "), F.left(p["b"], F.lit(j))) for i in range(1, REACH + 1) for j in range(1, REACH + 1)
    ))))
    return F.array_distinct(F.concat(words, joints, F.array(F.lit(NO_WORD))))


def term_key(term):
    """The key of a folded term; terms of signs only, or of a sign and a word, are looked up in every text."""
    words = words_of(term)
    joint = F.concat(F.right(F.get(words, F.lit(0)), F.lit(REACH)), F.lit(" "), F.left(F.get(words, F.lit(1)), F.lit(REACH)))
    lone = F.size(words) == 1
    return F.when(F.size(words) > 1, joint).when(lone & (F.get(words, F.lit(0)) == term), term).otherwise(F.lit(NO_WORD))


def _holds(text, term, whole):
    """As has_term() and company_match(): a phrase may occur anywhere, a word and a company name must stand alone."""
    alone = F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), term, F.lit(" ")))
    signs = F.rlike(text, F.concat(F.lit(r"\b\Q"), term, F.lit(r"\E\b")))
    return F.when(whole, alone).when(term.contains(" "), text.contains(term)).when(term.contains("&"), signs).otherwise(alone | signs)


def attach_hits(rows, texts, terms, name="_hits"):
    """Add the distinct codes of the terms each row holds (null for none).

    texts: {field: (column of rows, ...)} - the columns joined by blanks are the field's text; terms: a table (field, term, whole, code)
    with folded terms. Null texts count as empty.
    """
    own = list(dict.fromkeys(c for columns in texts.values() for c in columns))
    pieces = F.array(*(
        F.struct(F.lit(field).alias("_field"), F.btrim(F.concat_ws(" ", *columns)).alias("_text")) for field, columns in texts.items()
    ))
    keyed = rows.select(*own).distinct().select(*own, F.inline(pieces)).where("_text <> ''")
    keyed = keyed.select("*", F.explode(text_keys(F.col("_text"))).alias("_key"))
    listed = terms.where("term <> ''").select(
        F.col("field").alias("_field"), term_key(F.col("term")).alias("_key"), F.col("term").alias("_term"), F.col("whole").alias("_whole"), F.col("code").alias("_code"),
    ).distinct()
    found = keyed.join(listed, ["_field", "_key"]).where(_holds(F.col("_text"), F.col("_term"), F.col("_whole")))
    return attach_groups(rows, found.groupBy(*own).agg(F.collect_set("_code").alias(name)), own)


#: Texts of a prepared row that rules look into.
FIELDS = {
    "title": ("_title",), "employer": ("_employer",), "descriptor": ("_descriptor",), "either": ("_title", "_employer"),
    "anywhere": ("_title", "_employer", "_descriptor"), "company": ("_company",),
}


def attach_vocabulary(rows, table, wanted):
    """Add the codes of the wanted (field, industry, kind) whose terms a prepared row holds.

    wanted: {(field, industry, kind): code}, a few dozen at most; table: (industry, kind, term).
    """
    codes = rows.sparkSession.createDataFrame([(*key, code) for key, code in wanted.items()], "field string, industry string, kind string, code int")
    kinds = list(dict.fromkeys(kind for _, _, kind in wanted))  # the join would drop other kinds too, but only after their names are folded
    raw = spread(table.where(F.col("kind").isin(kinds)).join(F.broadcast(codes), ["industry", "kind"]).select("field", "term", "code"))
    whole = F.col("field") == "company"
    folded = F.when(whole, norm_company(F.col("term"))).otherwise(norm_title(F.col("term")))
    # Filters on plain columns would be pushed to where terms are read, and fold them there; they stay behind an inline.
    terms = raw.select(F.inline(F.array(F.struct("field", folded.alias("term"), whole.alias("whole"), "code"))))
    return attach_hits(rows, {field: FIELDS[field] for field in dict.fromkeys(f for f, _, _ in wanted)}, terms)
