"""Ranked lexical search over hashed max-sketches.

1. The terms of all queries form a vocabulary; one scan counts documents, their lengths and the documents that hold each term.
2. A second scan folds the impacts of each document's terms, all of them, into SKETCH coordinates by a hash of the term, keeping
   the largest of each. A query's terms, looked up there and weighted, add up to an upper bound of its score. All queries are
   looked up at once: sketches times the matrix of query weights by coordinate.
3. Per query, documents are rescored exactly in the order of their bounds, a step at a time, until no bound reaches the tenth best
   score so far. Tasks keep their best documents over all they read and give only those.
4. The best of all tasks are ranked in Spark.

Impacts need only the length of a document and three numbers of the corpus, so a sketch does not depend on the queries. Bounds only
save work: scores are exact, and a hash that falls together loosens a bound but changes no result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.kernels import BYTE_VALUES, coded, counted, ranges, rolling, span_hash, text_chunks
from rollbook.llm.shared import saved

SKETCH = 2048
STEP = 32
TOP = 10
MAX_PAIRS = 200_000


def query_terms(queries, id_col="item_id", text_col="text"):
    """Distinct rows (item, term); an item's rows are read together. Items without terms give none."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                numbers, terms, first = coded(data, offsets)
                row, number, _ = counted(numbers, first, len(terms))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(row)), terms.take(pa.array(number)).cast(pa.large_string()).cast(pa.string())], names=["item", "term"],
                )

    source = queries.select(F.col(f"`{id_col}`").alias("item"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, T.StructType([T.StructField("item", source.schema["item"].dataType), T.StructField("term", T.StringType())])).distinct()


def corpus_numbers(source, vocabulary):
    """Documents with a term, terms with repeats, and for each word of the vocabulary the documents that hold it."""
    size = len(vocabulary)

    def run(batches):
        known = pa.array(vocabulary, pa.large_binary())
        total = np.zeros(size + 2, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(1), 1 << 22):
                numbers, terms, first = coded(data, offsets)
                lengths = np.diff(first)
                total[size] += np.count_nonzero(lengths)
                total[size + 1] += lengths.sum()
                place = pa.compute.index_in(terms, known).fill_null(-1).to_numpy(zero_copy_only=False)
                hit = place[numbers] >= 0
                row = np.repeat(np.arange(len(lengths)), lengths)[hit]
                keys = np.unique(row * max(size, 1) + place[numbers[hit]])
                total[:size] += np.bincount(keys % max(size, 1), minlength=size)[:size]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    found = source.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most one row a word, and two
    total = np.zeros(size + 2, np.int64)
    for k, n in found:
        total[k] = n
    return int(total[size]), int(total[size + 1]), total[:size]


def weights(documents, holding):
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in holding], np.int64)


def length_numbers(lengths, documents, total):
    """100-90+((90*n*N) div L) of each length, exact for any size."""
    if not total:
        return np.full(len(lengths), 10, np.int64)
    longest = int(lengths.max()) if len(lengths) else 0
    n = lengths.astype(object) if 90 * longest * documents >= 1 << 62 else lengths.astype(np.int64)
    return np.asarray(10 + 90 * n * documents // total).astype(np.int64)


def impacts(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def coordinates(terms, size):
    """The coordinate of each term of a binary array."""
    if not len(terms):
        return np.zeros(0, np.int64)
    bounds = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset:terms.offset + len(terms) + 1]
    data = np.frombuffer(terms.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    return (span_hash(rolling(BYTE_VALUES[data]), bounds[:-1], bounds[1:]) % np.uint64(size)).astype(np.int64)


def max_sketches(row, number, value, n_rows, place, size):
    """Coordinatewise maxima of the impacts: one line a document."""
    out = np.zeros((n_rows, size))
    np.maximum.at(out, (row, place[number]), value)
    return out


class Best:
    """The best documents of each item so far: highest score first, then the least id; a null id comes last."""

    def __init__(self, items, top):
        self.top, self.threshold = top, np.ones(items, np.int64)  # a score of 0 is no result
        self.item = np.zeros(0, np.int64)
        self.score, self.id, self.bare = self.item, self.item, np.zeros(0, bool)

    def add(self, item, score, ids, bare):
        keep = score >= self.threshold[item]
        if not keep.any():
            return
        item, score, ids, bare = (
            np.concatenate([mine, new[keep]]) for mine, new in zip((self.item, self.score, self.id, self.bare), (item, score, ids, bare))
        )
        order = np.lexsort((ids, bare, -score, item))
        item, score, ids, bare = item[order], score[order], ids[order], bare[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.top - 1
        self.threshold[item[last]] = score[last]
        keep = place < self.top
        self.item, self.score, self.id, self.bare = item[keep], score[keep], ids[keep], bare[keep]


class Queries:
    """Items as lists of words of a vocabulary, with weights and sketch coordinates."""

    def __init__(self, vocabulary, word, first, weight, sketch):
        self.vocabulary, self.word, self.first, self.weight, self.sketch = vocabulary, word, first, weight, sketch

    def prepare(self):
        self.known = pa.array(self.vocabulary, pa.large_binary())
        n = len(self.first) - 1
        self.matrix = np.zeros((self.sketch, n))
        item = np.repeat(np.arange(n), np.diff(self.first))
        np.add.at(self.matrix, (coordinates(self.known, self.sketch)[self.word], item), self.weight[self.word])
        return self


def rescore(queries, table, rows, items):
    """Exact scores of pairs of a row and an item; table holds the impacts of query words by row and local word."""
    counts = queries.first[items + 1] - queries.first[items]
    at = queries.word[ranges(queries.first[items], counts)]
    values = table[0][np.repeat(rows, counts), table[1][at]] * queries.weight[at]
    return np.add.reduceat(values, np.cumsum(counts) - counts) if len(values) else np.zeros(0, np.int64)


def search_chunk(queries, best, numbers, terms, first, ids, bare, documents, total):
    """Bounds of all items for the rows of a chunk, and exact scores of those that may be among the best. Returns pairs rescored."""
    n = len(first) - 1
    row, number, tf = counted(numbers, first, len(terms))
    value = impacts(tf, length_numbers(np.diff(first), documents, total)[row])
    bounds = max_sketches(row, number, value, n, coordinates(terms, queries.sketch), queries.sketch) @ queries.matrix

    place = pa.compute.index_in(terms, queries.known).fill_null(-1).to_numpy(zero_copy_only=False)
    hit = place[number] >= 0
    local, column = np.unique(place[number[hit]], return_inverse=True)
    exact = np.zeros((n, len(local) + 1), np.int64)  # the last column is for words that no row has
    exact[row[hit], column] = value[hit]
    where = np.full(len(queries.known), len(local))
    where[local] = np.arange(len(local))
    rescored = 0
    for i in range(0, bounds.shape[1], 256):
        block = bounds[:, i:i + 256]
        at, item = np.nonzero(block >= best.threshold[i:i + 256])
        item += i
        order = np.lexsort((-bounds[at, item], item))
        at, item = at[order], item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        while len(item):
            now = rank < STEP
            best.add(item[now], rescore(queries, (exact, where), at[now], item[now]), ids[at[now]], bare[at[now]])
            rescored += int(now.sum())
            left = ~now & (bounds[at, item] >= best.threshold[item])
            at, item, rank = at[left], item[left], rank[left] - STEP
    return rescored


def _search(source, queries, documents, total, top):
    items = len(queries.first) - 1

    def run(batches):
        queries.prepare()
        best = Best(items, top)
        for batch in batches:
            bare = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_chunks(batch.column(1)):
                search_chunk(queries, best, *coded(data, offsets), ids[i:j], bare[i:j], documents, total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array(best.id, mask=best.bare), pa.array(best.score)], names=["item", "doc_id", "score"],
        )

    return source.mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs, queries, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", top=TOP, sketch=SKETCH, max_pairs=MAX_PAIRS):
    """Rows (item_id, rank, doc_id, score): the `top` best documents of each item with a score above 0, equal ones by ascending id.

    Ids of documents are whole numbers; a null id ranks behind others of its score. Null and empty texts have no terms: such
    documents are no results, and such items have none. Rows that repeat an id are ranked each; rows that repeat an item are one
    item with the terms of all. Empty tables give no rows. Texts are read whole. Other columns are not read. Items are searched
    in blocks of about max_pairs terms, one scan each, so that what travels to tasks stays bounded.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    pairs = saved(query_terms(queries, item_col, item_text_col), "search-terms")
    item_type = pairs.schema["item"].dataType
    blocks = max(1, -(-pairs.count() // max_pairs))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    parts = []
    for k in range(blocks):
        rows = pairs.where(block == k).collect()
        items = list(dict.fromkeys(r["item"] for r in rows))
        vocabulary = sorted({r["term"].encode() for r in rows})
        number = {term: i for i, term in enumerate(vocabulary)}
        of_item = {item: [] for item in items}
        for r in rows:
            of_item[r["item"]].append(number[r["term"].encode()])
        word = np.array([w for item in items for w in sorted(of_item[item])], np.int64)
        first = np.concatenate([[0], np.cumsum([len(of_item[item]) for item in items])]).astype(np.int64)
        documents, total, holding = corpus_numbers(source, vocabulary)
        found = _search(source, Queries(vocabulary, word, first, weights(documents, holding), sketch), documents, total, top)
        ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
        names = spark.createDataFrame(
            list(enumerate(items)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type)]),
        )
        parts.append(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # at most max_pairs items
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
