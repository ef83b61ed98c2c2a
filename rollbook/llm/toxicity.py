"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its own hash and of its character n-grams, with marks for its ends; a document is the mean
of its distinct words and of PADDING words without content, which keep short and repetitive texts from saying much. A linear softmax
reads that mean. Embeddings and softmax are fitted together, in numpy on the driver, on a bounded sample of labelled documents.
Unseen spellings share the n-grams of seen ones, so they are scored alike; n-grams never seen say nothing.

As the model is linear behind the embeddings, each n-gram has one number in the end, and tasks score a document as the mean of the
numbers of its words. That table has a fixed size; every document is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rollbook.llm.kernels import BYTE_VALUES, coded, counted, ranges, rolling, span_hash, text_chunks
from rollbook.llm.shared import texts

BUCKETS = 1 << 18
DIMENSIONS = 4
SIZES = (3, 4, 5)
PADDING = 16
TRAIN_ROWS = 10_000
#: The sample ends where its documents have this many distinct words together; one with more than a tenth of it does not teach.
TRAIN_WORDS = 3_000_000
EPOCHS = 6
BATCH = 128
RATE = 60.0
#: Squared gradients that an n-gram needs before its rate falls; it keeps the rate of rare ones low.
DAMPING = 1e-9
THRESHOLD = 0.3


def subwords(words, sizes=SIZES, buckets=BUCKETS):
    """Buckets of the n-grams of distinct words (a binary array), one word after another, and the n+1 bounds of each word's.

    The first bucket of a word is that of the whole word; n-grams are counted in characters.
    """
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    lengths = np.diff(bounds)
    data = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0]:bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    ends = np.cumsum(lengths + 2)
    starts = ends - lengths - 2
    body = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    body[ranges(starts + 1, lengths)] = data
    body[starts], body[ends - 1] = 60, 62  # < and >
    prefix = rolling(BYTE_VALUES[body])
    at = np.flatnonzero((body & 0xC0) != 0x80)  # first bytes of characters
    edges = np.append(at, len(body))
    last = np.searchsorted(at, ends)
    owner = np.repeat(np.arange(len(words)), np.diff(np.concatenate([[0], last])))
    found, of = [span_hash(prefix, starts, ends)], [np.arange(len(words))]
    for n in sizes:
        begin = np.flatnonzero(np.arange(len(at)) + n <= last[owner])
        begin = begin[(edges[begin] > starts[owner[begin]]) | (edges[begin + n] < ends[owner[begin]])]  # the whole word is there
        found.append(span_hash(prefix, edges[begin], edges[begin + n]))
        of.append(owner[begin])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    hashes = np.concatenate(found)[order]
    return (hashes % np.uint64(buckets)).astype(np.int64), np.searchsorted(of[order], np.arange(len(words) + 1))


def word_means(table, grams, bounds):
    """The mean of the table's lines over each word's n-grams; every word has one at least."""
    if len(bounds) < 2:
        return table[:0]
    sums = np.add.reduceat(table[grams], bounds[:-1])
    n = np.diff(bounds)
    return sums / (n if table.ndim == 1 else n[:, None])


class Model:
    """Embeddings (buckets x dimensions), the softmax over two classes, and the one number of each bucket that follows."""

    def __init__(self, embeddings, weights, bias, sizes=SIZES):
        self.embeddings, self.weights, self.bias, self.sizes = embeddings, weights, bias, sizes

    def slopes(self):
        """What a bucket adds to the log odds of label 1 where it is the whole document."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])

    def offset(self):
        return float(self.bias[1] - self.bias[0])


def loss_and_gradients(model, grams, bounds, word, weight, first, labels):
    """Mean log loss of documents and its gradients by embeddings, weights and bias.

    word and weight are the documents' words and their shares, document d from first[d] to first[d + 1].
    """
    n = len(labels)
    vectors = word_means(model.embeddings, grams, bounds)
    parts = vectors[word] * weight[:, None]
    docs = np.zeros((n, parts.shape[1]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        docs[some] = np.add.reduceat(parts, first[some])
    logits = docs @ model.weights + model.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = -np.log(np.maximum(p[np.arange(n), labels], 1e-300)).mean()
    wrong = p.copy()
    wrong[np.arange(n), labels] -= 1
    wrong /= n
    to_docs = wrong @ model.weights.T
    owner = np.repeat(np.arange(n), np.diff(first))
    sizes = np.diff(bounds)
    gradient = np.empty_like(model.embeddings)
    for k in range(gradient.shape[1]):
        to_word = np.bincount(word, weights=weight * to_docs[owner, k], minlength=len(sizes)) / sizes
        gradient[:, k] = np.bincount(grams, weights=np.repeat(to_word, sizes), minlength=len(gradient))
    return loss, gradient, docs.T @ wrong, wrong.sum(axis=0)


def fit(words, word, first, labels, sizes=SIZES, buckets=BUCKETS, dimensions=DIMENSIONS, epochs=EPOCHS, batch=BATCH, rate=RATE, seed=5):
    """The model for labelled documents, by mini-batches with rates that fall with past gradients: one a bucket, one for the softmax."""
    rng = np.random.default_rng(seed)
    model = Model(np.zeros((buckets, dimensions)), rng.normal(0, 1, (dimensions, 2)), np.zeros(2), sizes)
    if not len(labels):
        return model
    parts = [subwords(words.slice(i, 1 << 15), sizes, buckets) for i in range(0, len(words), 1 << 15)]
    grams = np.concatenate([g.astype(np.int32) for g, _ in parts]) if parts else np.zeros(0, np.int32)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))]) if parts else np.zeros(1, np.int64)
    del parts
    past = [np.full((buckets, 1), DAMPING), 1e-12, 1e-12]
    order = np.arange(len(labels))
    steps, step = epochs * -(-len(labels) // batch), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), batch):
            docs = order[k:k + batch]
            counts = first[docs + 1] - first[docs]
            pairs = ranges(first[docs], counts)
            own, local = np.unique(word[pairs], return_inverse=True)
            sizes_ = bounds[own + 1] - bounds[own]
            _, *gradients = loss_and_gradients(
                model, grams[ranges(bounds[own], sizes_)], np.concatenate([[0], np.cumsum(sizes_)]), local, np.repeat(1 / (counts + PADDING), counts),
                np.concatenate([[0], np.cumsum(counts)]), labels[docs],
            )
            pace = rate * (1 - step / steps)
            step += 1
            for k_, (value, gradient) in enumerate(zip((model.embeddings, model.weights, model.bias), gradients)):
                past[k_] = past[k_] + np.einsum("ij,ij->i", gradient, gradient)[:, None] if k_ == 0 else past[k_] + (gradient * gradient).sum()
                value -= (pace if k_ == 0 else min(pace, 0.05)) * gradient / np.sqrt(past[k_])
    return model


def held_out(doc_id):
    """Rows that never teach: crc32 of the id as text leaves 2 when divided by four. A null id never teaches either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _bag(column: pa.Array) -> pa.Array:
    """The distinct words of each text, with blanks between them."""
    parts = []
    for _, _, data, offsets in text_chunks(column, 1 << 22):
        numbers, words, first = coded(data, offsets)
        row, number, _ = counted(numbers, first, len(words))
        ends = pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32())
        lists = pa.ListArray.from_arrays(ends, words.take(pa.array(number)).cast(pa.binary()))
        parts.append(pa.compute.binary_join(lists, b" ").cast(pa.binary()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def fit_toxicity(docs, labels, id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="toxic", train_rows=TRAIN_ROWS, train_words=TRAIN_WORDS, **settings):
    """The model, fitted on labelled documents that are not held out: at most train_rows of them, drawn by a hash of their id.

    A label that is null, or whose id is null or in no document, is left out. If an id has several labels, the largest counts; if
    it has several documents, each teaches. The sample also ends where its documents have train_words distinct words together,
    and a document with more than a tenth of that does not teach: both bound the driver's memory. Without labels all score 0.5.
    """
    known = labels.select(F.col(f"`{label_id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    present = docs.select(F.col(f"`{id_col}`").alias("doc_id")).distinct()
    drawn = known.where(~held_out(F.col("doc_id"))).join(present, "doc_id", "left_semi").withColumn("draw", F.xxhash64("doc_id"))
    drawn = drawn.orderBy("draw", "doc_id").limit(train_rows)
    rows = texts(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id")  # at most train_rows ids
    rows = rows.select("draw", "doc_id", "label", F.arrow_udf(_bag, "binary")("text").alias("bag"))
    rows = rows.withColumn("size", F.when(F.length("bag") > 0, F.regexp_count(F.col("bag").cast("string"), F.lit(" ")) + 1).otherwise(0))
    taken, labels_, size = [], [], 0
    for row in rows.where(F.col("size") <= train_words // 10).orderBy("draw", "doc_id", F.xxhash64("bag")).toLocalIterator():
        size += row["size"]
        if size > train_words:
            break
        taken.append(bytes(row["bag"]))
        labels_.append(int(row["label"] > 0))
    data = np.frombuffer(b"".join(taken), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in taken])]).astype(np.int64)
    del taken
    numbers, words, first = coded(data, offsets)
    return fit(words, numbers, first, np.array(labels_, np.int64), **settings)


def score_column(model):
    """A function of a text column that gives the score."""
    slopes, offset, sizes = model.slopes(), model.offset(), model.sizes

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        parts = []
        for _, _, data, offsets in text_chunks(column, 1 << 22):
            numbers, words, first = coded(data, offsets)
            odds = np.zeros(len(offsets) - 1)
            if len(numbers):
                of_word = word_means(slopes, *subwords(words, sizes, len(slopes)))
                row, number, _ = counted(numbers, first, len(words))
                n = np.bincount(row, minlength=len(odds))
                odds = np.bincount(row, weights=of_word[number], minlength=len(odds)) / (n + PADDING)
            parts.append(1 / (1 + np.exp(-np.clip(odds + offset, -30, 30))))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def toxicity_scores(docs, labels, id_col="doc_id", text_col="text", **settings):
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier).

    Null, empty and other texts without words get the score of the bias alone; repeated rows get equal scores; an empty table
    gives no rows. Texts are read whole. Only the text enters the score. Other columns are not read.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, **settings)
    return texts(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model)("text").alias("score"))
