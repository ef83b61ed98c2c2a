"""Benchmark decontamination: each shard of training text gets an FM-index, in which all benchmark windows are searched.

A shard holds the words of whole documents, as symbols of the benchmark's vocabulary. Runs of such words that are too short for
the shortest window are left out, since no window fits in; what is left out becomes one separator. The benchmark is the stated
query set: it is sent to all tasks, and its size is checked before. No shuffle takes place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.fm_index import FMIndex
from rollbook.llm.kernels import ranges, text_buffers, text_chunks, words
from rollbook.llm.shared import texts

WINDOW = 10
#: Bounds of what is sent to every task. A window costs the driver some 250 bytes while they are made, and tasks 100.
MAX_BENCHMARK_BYTES, MAX_WINDOWS = 64 << 20, 4_000_000
SHARD_SYMBOLS = 1 << 20
SHARD_ROWS = 50_000

SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "start_byte", "end_byte")])


def window_names(symbols, starts, size):
    """Numbers of the runs of `size` symbols at the starts: equal runs, and only they, have equal numbers.

    Runs of 1, 2, 4, ... symbols are numbered by pairs of halves, and a run of `size` by its parts; nothing is hashed.
    """
    named, n = symbols.astype(np.int64), 1
    whole, offset = np.zeros(len(starts), np.int64), 0
    while size:
        if size & 1:
            part = named[starts + offset]
            whole = np.unique(whole * (int(part.max()) + 1 if len(part) else 1) + part, return_inverse=True)[1]
            offset += n
        size >>= 1
        if size:
            named = np.unique(named[:-n] * (int(named.max()) + 1) + named[n:], return_inverse=True)[1] if len(named) > n else named[:0]
            n *= 2
    return whole


def phrases(item_ids, item_texts, window=WINDOW):
    """Vocabulary (sorted word hashes), windows as right-aligned symbols, their lengths, and the items of each window."""
    _, _, hashes, first = words(*text_buffers(pa.array(item_texts, pa.large_string())))
    vocabulary = np.unique(hashes)
    symbols = np.searchsorted(vocabulary, hashes)
    names, number = np.unique(np.array([str(i) for i in item_ids], object), return_inverse=True) if len(item_ids) else (np.array([]), np.zeros(0, np.int64))
    counts = np.diff(first)
    owner = np.repeat(number, counts)
    # One group of windows for each length: whole windows, and the few items that are shorter.
    patterns, pairs = [], []
    for size in sorted({min(window, int(c)) for c in counts if c}):
        rows = np.flatnonzero(counts >= window if size == window else counts == size)
        starts = ranges(first[rows], counts[rows] - size + 1)
        if len(starts) > MAX_WINDOWS:
            raise ValueError(f"The benchmark has {len(starts)} windows; split it into parts of at most {MAX_WINDOWS}.")
        _, at, same = np.unique(window_names(symbols, starts, size), return_index=True, return_inverse=True)
        pattern = np.full((len(at), window), -1, np.int32)
        pattern[:, window - size:] = symbols[starts[at][:, None] + np.arange(size)]
        pairs.append(np.unique((same + sum(map(len, patterns))) * len(names) + owner[starts]))
        patterns.append(pattern)
    patterns = np.concatenate(patterns) if patterns else np.full((0, window), -1, np.int32)
    of, owners = np.divmod(np.concatenate(pairs), len(names)) if pairs else (np.zeros(0, np.int64),) * 2
    return {
        "vocabulary": vocabulary, "patterns": patterns, "lengths": (patterns >= 0).sum(1), "names": names.tolist(),
        "owner_start": np.searchsorted(of, np.arange(len(patterns) + 1)), "owners": owners,
    }


def reduce_words(hashes, first, vocabulary, shortest):
    """Symbols of the words that can lie in a window, with a separator between runs, and the word position of each symbol."""
    n = len(hashes)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    edges = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < n)]
    begin[edges] = known[edges]
    starts = np.flatnonzero(begin)
    stop = ~known
    stop[edges] = True
    stops = np.append(np.flatnonzero(stop), n)
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    long = ends - starts >= shortest
    starts, sizes = starts[long], (ends - starts)[long]
    places = ranges(starts, sizes)
    where = places + 0
    heads = np.cumsum(sizes) - sizes
    symbols = np.insert(at[places] + 1, heads, 0)
    return symbols, np.insert(where, heads, -1)


class Shard:
    """Documents gathered for one index."""

    def __init__(self, known):
        self.known = known
        self.clear()

    def clear(self):
        self.symbols, self.where, self.owner, self.begin, self.end, self.counts, self.ids = [], [], [], [], [], [], []
        self.size = self.rows = 0

    def add(self, ids, data, offsets):
        starts, ends, hashes, first = words(data, offsets)
        self.counts.append(np.diff(first))
        self.ids.append(ids)
        k = self.known
        if len(hashes) and len(k["vocabulary"]):
            symbols, where = reduce_words(hashes, first, k["vocabulary"], int(k["lengths"].min()))
            row = np.searchsorted(first, where, side="right") - 1
            row[where < 0] = -1
            inside = where >= 0
            local = np.where(inside, where - first[row], -1)
            self.symbols.append(symbols)
            self.where.append(local)
            self.owner.append(np.where(inside, row + self.rows, -1))
            self.begin.append(np.where(inside, starts[where] - offsets[row], -1))
            self.end.append(np.where(inside, ends[where] - offsets[row], -1))
            self.size += len(symbols)
        self.rows += len(ids)

    def hits(self):
        """Found windows: the row of the document, first symbol, window. One line for each occurrence."""
        k = self.known
        if not self.size:
            return (np.zeros(0, np.int64),) * 2
        index = FMIndex(np.concatenate(self.symbols), len(k["vocabulary"]) + 1)
        low, high = index.search(np.where(k["patterns"] >= 0, k["patterns"] + 1, -1))
        found = np.repeat(np.arange(len(low)), high - low)
        return index.locate(ranges(low, high - low)), found

    def result(self):
        counts = np.concatenate(self.counts)
        position, window = self.hits()
        k, n = self.known, self.rows
        span_of, items_of = {}, {}
        hit = np.zeros(n, np.int64)
        if len(position):
            where, owner, begin, end = (np.concatenate(x) for x in (self.where, self.owner, self.begin, self.end))
            last = position + k["lengths"][window] - 1
            order = np.lexsort((position, owner[position]))
            position, last, window = position[order], last[order], window[order]
            reach = np.maximum.accumulate(last)  # symbols of later documents lie behind, so the maximum never crosses one
            new = np.ones(len(position), bool)
            new[1:] = (owner[position[1:]] != owner[position[:-1]]) | (position[1:] > reach[:-1] + 1)
            heads = np.flatnonzero(new)
            tails = reach[np.append(heads[1:] - 1, len(position) - 1)]
            heads = position[heads]
            np.add.at(hit, owner[heads], tails - heads + 1)
            for a, z in zip(heads.tolist(), tails.tolist()):
                span_of.setdefault(int(owner[a]), []).append(
                    {"first_word": int(where[a]), "end_word": int(where[z]) + 1, "start_byte": int(begin[a]), "end_byte": int(end[z])}
                )
            pairs = np.unique(owner[position] * len(k["lengths"]) + window)
            rows, window = np.divmod(pairs, len(k["lengths"]))
            sizes = np.diff(k["owner_start"])[window]
            items = k["owners"][ranges(k["owner_start"][window], sizes)]
            pairs = np.unique(np.repeat(rows, sizes) * len(k["names"]) + items)
            for row, item in zip(*(x.tolist() for x in np.divmod(pairs, len(k["names"])))):
                items_of.setdefault(row, []).append(k["names"][item])
        spans = [span_of.get(r, []) for r in range(n)]
        items = [items_of.get(r, []) for r in range(n)]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(self.ids), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([(f.name, pa.int64()) for f in SPAN]))), pa.array(items, pa.list_(pa.string())),
            ],
            names=["doc_id", "n_words", "n_hit", "spans", "items"],
        )
        self.clear()
        return batch


def send_phrases(benchmark, item_col, item_text_col, window):
    """The windows of all items, as a broadcast of checked size."""
    items = texts(benchmark, item_col, item_text_col)
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"The benchmark has {size} characters; split it into parts of at most {MAX_BENCHMARK_BYTES}.")
    rows = items.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").collect()
    return benchmark.sparkSession.sparkContext.broadcast(phrases([r["id"] for r in rows], [r["text"] for r in rows], window))


def decontaminate(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", window=WINDOW):
    """One row per input row: doc_id, n_words, n_hit, spans (merged, of words and of UTF-8 bytes), items (sorted as strings).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Every word in an
    occurrence of a window is hit; spans that touch are merged. Null texts have no words, a null item id counts as "". Repeated
    rows give repeated rows; repeated items count once. Empty tables give no rows, or rows without hits. Documents may be of any
    length Spark can hold; matches never cross documents. Other columns are not read. The benchmark may have up to
    MAX_BENCHMARK_BYTES of text and MAX_WINDOWS windows; a larger one raises, since its windows are sent to every task.
    """
    known = send_phrases(benchmark, item_col, item_text_col, window)

    def run(batches):
        shard = Shard(known.value)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                shard.add(batch.column(0).slice(i, j - i), data, offsets)
                if shard.size >= SHARD_SYMBOLS or shard.rows >= SHARD_ROWS:
                    yield shard.result()
        if shard.rows:
            yield shard.result()

    source = texts(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType())),
    ])
    return source.mapInArrow(run, schema)


def hit_words(benchmark, item_col="item_id", item_text_col="text", window=WINDOW):
    """A function of a text column that gives the number of hit words, for filters that keep whole rows. Limits as above."""
    known = send_phrases(benchmark, item_col, item_text_col, window)

    @F.arrow_udf("long")
    def hits(column: pa.Array) -> pa.Array:
        shard, counts = Shard(known.value), []
        for i, j, data, offsets in text_chunks(column):
            shard.add(pa.nulls(j - i), data, offsets)
            if shard.size >= SHARD_SYMBOLS:
                counts.append(shard.result().column("n_hit"))
        if shard.rows:
            counts.append(shard.result().column("n_hit"))
        return pa.concat_arrays(counts) if counts else pa.array([], pa.int64())

    return hits


def digest(found):
    """The columns of the report: counts, a hash of the items, and whether anything was hit."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

