"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a calibrated temperature.

1. Every token has a sparse random index vector, made from its hash. Over the whole corpus, each word sums the index vectors of its
   left and right neighbours: its word vector. The WORDS most frequent words, by counts over all documents, have vectors of their
   own, or nearly as many; rarer ones, whose contexts say little, share BUCKETS vectors by their hash. Tasks send one row a vector they touched and
   the rows are summed in Spark, so what travels grows with the number of tasks, and the table has a fixed size.
2. A document is the mean and the spread of the word vectors and index vectors of its tokens, and a few ratios.
3. The network is fitted on the driver on at most TRAIN_ROWS labelled documents, drawn by a hash of their id; a fifth of them only
   sets the temperature. Nothing else is sampled: word vectors come from all documents and all of them are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.kernels import BYTE_VALUES, mix, rolling, span_hash, text_chunks
from rollbook.llm.shared import saved, texts

WORDS = 1 << 16
BUCKETS = 1 << 13
COUNTED = 1 << 20
DIMENSIONS = 32
TRAIN_ROWS = 20_000
HIDDEN = 32
THRESHOLD = 0.3

_CLASS = np.ones(256, np.uint8)  # 0: space, 1: letters and digits, 2: other signs
_CLASS[:33] = 0
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 2


def tokens(data, offsets):
    """Hashes of the runs of letters or of signs, case kept, and for each row the position of its first token (n+1 values)."""
    kind = _CLASS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    return span_hash(rolling(BYTE_VALUES[data]), starts, ends), np.searchsorted(starts, offsets)


def index_vectors(hashes):
    """The two places and signs of a token's index vector."""
    h = mix(hashes)
    places = [((h >> np.uint64(s)) % np.uint64(DIMENSIONS)).astype(np.int64) for s in (8, 24)]
    signs = [1 - 2 * ((h >> np.uint64(s)) & np.uint64(1)).astype(np.int64) for s in (40, 41)]
    return places, signs


class Vectors:
    """Sorted hashes of the words with vectors of their own, and the table: their vectors, then the shared ones."""

    def __init__(self, words, table=None):
        self.words, self.table = words, table

    def __len__(self):
        return len(self.words) + BUCKETS

    def places(self, hashes):
        """The line of each token's vector."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        own = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        return np.where(own, at, len(self.words) + (hashes % np.uint64(BUCKETS)).astype(np.int64))


def frequent_words(docs, text_col="text", size=WORDS):
    """Sorted hashes of the most frequent tokens of all documents, `size` of them at most.

    Counts are told apart by eighths of a doubling, and whole levels are taken from the top while they fit: so the driver gets the
    sizes of some hundred levels and the words that are taken, and no task sends more than it has of those.
    """

    def run(batches):
        hashes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["word", "n"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), 1 << 22):
                more, n = np.unique(tokens(data, offsets)[0], return_counts=True)
                hashes, inverse = np.unique(np.concatenate([hashes, more]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([counts, n]), minlength=len(hashes)).astype(np.int64)
                if len(hashes) > COUNTED:
                    yield out()
                    hashes, counts = hashes[:0], counts[:0]
        yield out()

    counted = texts(docs, text_col, text_col).select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = saved(counted.select("word", F.floor(F.log2("n") * 8).cast("int").alias("level")), "words")
    taken, lowest = 0, None
    for level, n in sorted(counted.groupBy("level").count().collect(), reverse=True):
        taken += n
        if taken > size:
            break
        lowest = level
    if lowest is None:
        return np.zeros(0, np.uint64)
    rows = counted.where(F.col("level") >= lowest).select("word").toPandas()  # at most size rows
    return np.sort(rows["word"].to_numpy(np.int64).view(np.uint64))


def neighbour_sums(table, places, hashes, first):
    """Add to the flat table of sums the index vectors of the left and right neighbours within each row."""
    n = len(hashes)
    if n < 2:
        return
    at, signs = index_vectors(hashes)
    line = places * DIMENSIONS
    together = np.ones(n - 1, bool)
    cut = first[(first > 0) & (first < n)] - 1
    together[cut] = False
    left = np.flatnonzero(together)
    for to, of in ((left, left + 1), (left + 1, left)):
        for place, sign in zip(at, signs):
            np.add.at(table, line[to] + place[of], sign[of])


def word_vectors(docs, text_col="text", size=WORDS):
    """Vectors from all documents: lines of length 1, or 0 for what never has a neighbour."""
    names = [f"s{k}" for k in range(DIMENSIONS)]
    vectors = Vectors(frequent_words(docs, text_col, size))

    def run(batches):
        table = np.zeros(len(vectors) * DIMENSIONS, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), 1 << 22):
                hashes, first = tokens(data, offsets)
                neighbour_sums(table, vectors.places(hashes), hashes, first)
        table = table.reshape(-1, DIMENSIONS)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(table[used, k]) for k in range(DIMENSIONS)]], names=["line", *names])

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("line", *names)])
    sums = texts(docs, text_col, text_col).select("text").mapInArrow(run, schema).groupBy("line").agg(*[F.sum(n).alias(n) for n in names])
    found = sums.toPandas()  # at most WORDS + BUCKETS rows
    table = np.zeros((len(vectors), DIMENSIONS), np.float32)
    if len(found):
        table[found["line"].to_numpy()] = found[names].to_numpy(np.float64)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return Vectors(vectors.words, (table / np.where(length > 0, length, 1)).astype(np.float32))


FEATURES = 4 * DIMENSIONS + 4


def pooled(data, offsets, vectors):
    """One line of features for each row; a row without tokens has zeros."""
    hashes, first = tokens(data, offsets)
    counts = np.diff(first)
    out = np.zeros((len(counts), FEATURES), np.float32)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n, at = counts[some, None].astype(np.float32), first[some]
    line = vectors.places(hashes)
    seen = vectors.table[line]
    own = np.zeros((len(hashes), DIMENSIONS), np.float32)
    for place, sign in zip(*index_vectors(hashes)):
        own[np.arange(len(hashes)), place] += sign
    d = DIMENSIONS
    for k, v in enumerate((seen, own)):
        mean = np.add.reduceat(v, at) / n
        out[some, 2 * k * d:(2 * k + 1) * d] = mean
        out[some, (2 * k + 1) * d:(2 * k + 2) * d] = np.sqrt(np.maximum(np.add.reduceat(v * v, at) / n - mean * mean, 0))
    row = np.repeat(np.arange(len(counts)), counts)
    joint = np.zeros(len(hashes), np.float32)
    joint[1:] = np.where(row[1:] == row[:-1], np.einsum("ij,ij->i", seen[1:], seen[:-1]), 0)
    same = np.zeros(len(hashes), np.float32)
    same[2:] = (row[2:] == row[:-2]) & ((hashes[2:] == hashes[:-2]) | (hashes[1:-1] == hashes[2:]))
    kinds = np.unique(row * len(vectors) + line) // len(vectors)
    size = np.diff(offsets)[some].astype(np.float32)
    n = n[:, 0]
    out[some, 4 * d] = np.add.reduceat(joint, at) / n
    out[some, 4 * d + 1] = np.add.reduceat(same, at) / n
    out[some, 4 * d + 2] = np.bincount(kinds, minlength=len(counts))[some] / n
    out[some, 4 * d + 3] = n / size
    return out


class Network:
    """Standardised features, one hidden tanh layer, one logit divided by a temperature."""

    def __init__(self, mean, scale, weights, temperature=1.0):
        self.mean, self.scale, self.weights, self.temperature = mean, scale, weights, temperature

    def logits(self, x):
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def scores(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x, y, hidden=HIDDEN, epochs=60, batch=256, rate=3e-3, decay=1e-4, seed=7):
    """Fit by Adam on four fifths of the rows, then set the temperature on the rest (least log loss). Without rows: always 0.5."""
    width = x.shape[1]
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    if not len(x):
        return Network(np.zeros(width), np.ones(width), [*weights[:2], weights[2] * 0, weights[3]])
    order = rng.permutation(len(x))
    held, used = order[:len(x) // 5], order[len(x) // 5:]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-3
    z = (x - mean) / scale
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for epoch in range(epochs):
        rng.shuffle(used)
        pace = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for k in range(0, len(used), batch):
            rows = used[k:k + batch]
            a = np.tanh(z[rows] @ weights[0] + weights[1])
            g = (1 / (1 + np.exp(-np.clip(a @ weights[2] + weights[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(g, weights[2]) * (1 - a * a)
            grads = (z[rows].T @ back + decay * weights[0], back.sum(0), a.T @ g + decay * weights[2], g.sum(keepdims=True))
            step += 1
            for w, grad, (m, v) in zip(weights, grads, moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    made = Network(mean, scale, weights)
    if len(held):
        logits, truth = made.logits(x[held]), y[held]
        loss = lambda t: np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean()
        made.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return made


def held_out(doc_id):
    """Rows that never teach: crc32 of the id as text divides by five. A null id never teaches either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def score_column(vectors, network):
    """A function of a text column that gives the score."""
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        parts = [network.scores(pooled(data, offsets, vectors)) for _, _, data, offsets in text_chunks(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def fit_quality(docs, labels, id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="quality", train_rows=TRAIN_ROWS):
    """Word vectors of all documents, and the network fitted on at most train_rows labelled ones that are not held out.

    A label that is null, or whose id is null or in no document, is left out. If an id has several labels, the largest counts; if
    it has several documents, each teaches. Without any usable label every score is 0.5.
    """
    vectors = word_vectors(docs, text_col)
    known = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    # Ids that no longer have a document are left out before the sample is drawn; only ids travel here.
    present = docs.select(F.col(f"`{id_col}`").alias("doc_id")).distinct()
    drawn = known.where(~held_out(F.col("doc_id"))).join(present, "doc_id", "left_semi")
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    features = F.arrow_udf("binary")(_features(vectors))
    rows = (
        texts(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id")  # at most train_rows ids
        .select("label", features("text").alias("x")).toPandas()
    )
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), FEATURES).astype(np.float64)
    y = (rows["label"].to_numpy() > 0).astype(float)
    order = np.lexsort((x[:, 0], x[:, 1], x[:, -1]))  # rows come in any order; the fit should not depend on it
    return vectors, fit_network(x[order], y[order])


def _features(vectors):
    def features(column: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for _, _, data, offsets in text_chunks(column) for row in pooled(data, offsets, vectors)], pa.binary())

    return features


def quality_scores(docs, labels, id_col="doc_id", text_col="text", **fit):
    """One row per input row: doc_id, held_out, score (0 to 1, higher: better).

    Null and empty texts have no tokens and get the score of zero features; repeated rows get equal scores; an empty table gives
    no rows. Texts are read whole. Only the text enters the score. Other columns are not read.
    """
    vectors, network = fit_quality(docs, labels, id_col, text_col, **fit)
    return texts(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(vectors, network)("text").alias("score"))
