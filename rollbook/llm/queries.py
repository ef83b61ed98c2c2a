"""The operators applied to whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.llm import bpe, decontaminate, divergence, licenses, pii, quality, ranked_search, secrets_scan, suffix_dedup, token_counts, toxicity
from rollbook.llm.exact_dedup import exact_dedup
from rollbook.llm.jaccard_join import jaccard_join

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return keep


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op1_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
         g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g USING (t)
    """,
)
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir), keep="largest")


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op7_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
         b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
         win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
                 FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
         dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
                FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
         hit AS (SELECT dw.doc_id, dw.i, dw.n, win.item_id FROM dw JOIN win USING (n, g)),
         places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
         items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
                   FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op7_decontaminate(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.decontaminate(documents(spark, sf_dir), benchmark))


@query("op4_secrets")
def op4_secrets(spark, sf_dir):
    return secrets_scan.digest(secrets_scan.scan_secrets(documents(spark, sf_dir)))


@query("op10_licenses")
def op10_licenses(spark, sf_dir):
    return licenses.digest(licenses.scan_licenses(documents(spark, sf_dir)))


@query("op3_quality")
def op3_quality(spark, sf_dir):
    found = quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.digest(bpe.encode_texts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken")))


@query("op6_jaccard_join")
def op6_jaccard_join(spark, sf_dir):
    return jaccard_join(documents(spark, sf_dir))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(documents(spark, sf_dir)))


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(documents(spark, sf_dir), token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


@query("op9_pii")
def op9_pii(spark, sf_dir):
    found = pii.pseudonymise(documents(spark, sf_dir), key="a secret of the data's owner")
    return found.select("doc_id", "text", F.size("spans").cast("long").alias("n_values"))


LOWERED_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_divergence",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all({LOWERED_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
         tok AS (SELECT i, lang, source, unnest(w) AS term FROM d),
         kept AS (SELECT lang, term FROM (SELECT DISTINCT i, lang, term FROM tok) GROUP BY 1, 2 HAVING count(*) >= 10),
         v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
         grp AS (SELECT DISTINCT lang, source FROM d),
         cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
         tot AS (SELECT lang, source, sum(c)::BIGINT AS n FROM cnt GROUP BY 1, 2),
         p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (coalesce(n, 0) + 2 * v) AS p
               FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN tot USING (lang, source) LEFT JOIN cnt USING (lang, source, term)),
         langs AS (SELECT lang, term, sum(c)::BIGINT AS c FROM cnt GROUP BY 1, 2),
         q AS (SELECT lang, term, 1 + (1000000000 * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v)::BIGINT AS q FROM langs JOIN v USING (lang)),
         sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
                  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
         pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                   FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
                   LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
         terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
)
def op11_divergence(spark, sf_dir):
    return divergence.source_divergence(documents(spark, sf_dir))


@query("op12_toxicity")
def op12_toxicity(spark, sf_dir):
    found = toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query(
    "op13_ranked_search",
    rf"""
    WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
         tok AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d),
         size AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
         item AS (SELECT DISTINCT item_id, unnest({WORDS_SQL}) AS term FROM benchmark),
         tf AS (SELECT doc_id, n, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM item) GROUP BY 1, 2, 3),
         weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term, docs),
         score AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
                   FROM item JOIN tf USING (term) JOIN weight USING (term), size GROUP BY 1, 2),
         ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM score WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 10
    """,
)
def op13_ranked_search(spark, sf_dir):
    return ranked_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
