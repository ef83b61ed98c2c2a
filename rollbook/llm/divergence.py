"""Source divergence audit: how the words of each source differ from those of every other source of its language.

1. Tasks count words per language, source and word, and documents that hold them, before anything is shuffled. One exchange by
   (language, word) gives the kept words, each with its counts by source: a column of the group-word count matrix of its language.
2. Each task takes the columns it reads in blocks and lays a K-squared tree (k = 2) over each block: bitmaps of the quadrants that
   hold a count, level by level, with ranks to find children. Sources are taken in tiles, so a tree has at most 2 * TILE rows.
3. The tree is traversed jointly for all pairs of sources: a pair of quadrants that are both empty adds its width to a counter of
   its level, and is priced at once for all its pairs, since all its words have the same two shares; other quadrants are
   descended to single cells. Pending nodes wait on a stack in pieces of bounded size.
4. Sums per pair and block are added up in Spark. Words that set a source apart from its language come from the same pass.

Groups are collected on the driver in parts of at most MAX_GROUPS; more groups are priced part against part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.kernels import coded, counted, text_chunks
from rollbook.llm.shared import saved

SCALE = 1_000_000_000
TILE = 512
BLOCK_COLUMNS = 4096
FRONTIER = 1 << 17
TASK_ROWS = 1 << 19
MAX_GROUPS = 20_000
TOP_TERMS = 10

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def word_counts(docs, text_col="text", lang_col="lang", source_col="source"):
    """Rows (lang, source, term, n, docs): occurrences and documents, summed over each task or over TASK_ROWS rows of it."""
    names = ["lang", "source", "term", "n", "docs"]

    def merged(tables):
        whole = pa.concat_tables(tables).group_by(names[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return whole.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(names)

    def run(batches):
        pending, rows = [], 0
        for batch in batches:
            lang, source = (batch.column(k).dictionary_encode() for k in range(2))
            sources = max(1, len(source.dictionary))
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * sources + source.indices.to_numpy(zero_copy_only=False)
            for i, j, data, offsets in text_chunks(batch.column(2), 1 << 22):
                numbers, terms, first = coded(data, offsets, _LETTERS)
                if not len(numbers):
                    continue
                size = len(terms)
                row, number, tf = counted(numbers, first, size)
                keys, inverse = np.unique(group[i:j][row] * size + number, return_inverse=True)
                n = np.bincount(inverse, weights=tf, minlength=len(keys)).astype(np.int64)
                holding = np.bincount(inverse, minlength=len(keys))
                of = keys // size
                pending.append(pa.table([
                    lang.dictionary.take(pa.array(of // sources)), source.dictionary.take(pa.array(of % sources)),
                    terms.take(pa.array(keys % size)).cast(pa.large_string()).cast(pa.string()), pa.array(n), pa.array(holding.astype(np.int64)),
                ], names=names))
                rows += len(keys)
                if rows > 2 * TASK_ROWS:
                    pending = [merged(pending)]
                    rows = len(pending[0])
                    if rows > TASK_ROWS:
                        yield from pending[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                        pending, rows = [], 0
        if pending:
            yield from merged(pending).combine_chunks().to_batches(max_chunksize=1 << 16)

    text, long = T.StringType(), T.LongType()
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (text, text, text, long, long))])
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return docs.select(*cells).mapInArrow(run, schema)


def kept_columns(counts, min_docs):
    """One row per language and kept term: the occurrences of its sources. One exchange, by language and term."""
    cells = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    columns = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return columns.where(F.col("docs") >= min_docs).drop("docs")


class QuadTree:
    """A K-squared tree over the nonzero cells (row, column) of a matrix: per level the bitmap of children and its ranks."""

    def __init__(self, rows, columns, height):
        code = np.zeros(len(rows), np.int64)
        for bit in range(height):
            code |= ((rows >> bit & 1) << (2 * bit + 1)) | ((columns >> bit & 1) << (2 * bit))
        self.order = np.argsort(code)
        code = code[self.order]
        self.bits, self.ranks, above = [], [], np.zeros(1, np.int64)
        for level in range(1, height + 1):
            nodes = np.unique(code >> 2 * (height - level))
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            self.ranks.append(np.cumsum(bits) - 1)
            above = nodes

    def child(self, level, node, quadrant):
        """Numbers of the children at the next level, or -1; an absent node (-1) has none. A leaf's number is its place in order."""
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits[level][at], self.ranks[level][at], -1)


def shares(count, total, kept):
    """Fixed-point share of a count, exact for counts of any size."""
    if len(count) and (int(count.max()) + 2) * SCALE >= 1 << 62:
        count, total = count.astype(object), total.astype(object)
    return np.asarray(1 + SCALE * (count + 2) // (total + 2 * kept)).astype(np.int64)


def distance(p, q):
    return (p - q) * (p - q) // (p + q)


def pair_sums(rows, columns, counts, totals, width, kept, split):
    """Summed distances of pairs of rows over `width` columns, as a matrix.

    Without split the pairs are all g < h; with it, g below split and h from it on. Pairs outside are meaningless.
    """
    n = len(totals)
    size = max(n, width, 2)
    height = int(size - 1).bit_length()
    out = np.zeros((n, n), np.int64)
    empty = [np.zeros((-(-n >> height - level) or 1,) * 2, np.int64) for level in range(height + 1)]
    tree = QuadTree(rows, columns, height)
    values = counts[tree.order]
    root = 0 if len(rows) else -1
    if root < 0:
        empty[0][0, 0] = width
    none = np.zeros(1, np.int64)
    stack = [] if root < 0 else [(0, none, none, none, none, none)]
    while stack:
        level, a, b, ra, rb, c = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(level, *(x[:half] for x in (a, b, ra, rb, c))), (level, *(x[half:] for x in (a, b, ra, rb, c)))]
            continue
        if level == height:
            keep = (ra < split) & (rb >= split) if split else ra < rb
            a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
            counts_a, counts_b = (np.where(x >= 0, values[np.maximum(x, 0)], 0) for x in (a, b))
            found = distance(shares(counts_a, totals[ra], kept), shares(counts_b, totals[rb], kept))
            np.add.at(out, (ra, rb), found)
            continue
        shift = height - level - 1
        last_row, last_column = (n - 1) >> shift, (width - 1) >> shift
        children = []
        for k in range(8):
            i, j, side = k >> 2, k >> 1 & 1, k & 1
            ra2, rb2, c2 = 2 * ra + i, 2 * rb + j, 2 * c + side
            real = (rb2 <= last_row) & (c2 <= last_column)
            real &= ((ra2 << shift) < split) & (((rb2 + 1) << shift) > split) if split else ra2 <= rb2
            at = np.flatnonzero(real)
            if not len(at):
                continue
            ra2, rb2, c2 = ra2[at], rb2[at], c2[at]
            a2, b2 = tree.child(level, a[at], 2 * i + side), tree.child(level, b[at], 2 * j + side)
            zero = (a2 < 0) & (b2 < 0)
            if zero.any():
                wide = np.minimum(width, (c2[zero] + 1) << shift) - (c2[zero] << shift)
                np.add.at(empty[level + 1], (ra2[zero], rb2[zero]), wide)
            children.append([x[~zero] for x in (a2, b2, ra2, rb2, c2)])
        if children:
            stack.append((level + 1, *map(np.concatenate, zip(*children))))
    zeros = np.zeros((n, n), np.int64)
    for level, counter in enumerate(empty):
        blocks = np.arange(n) >> (height - level)
        zeros += counter[np.ix_(blocks, blocks)]
    base = shares(np.zeros(n, np.int64), totals, kept)
    return out + zeros * distance(base[:, None], base[None, :])


def _priced(columns, groups, cross, top):
    """Rows (lang, a, b, term, value): summed distance of sources a < b (term null), or a term's distance (b null).

    groups: per language the sources of one part, or of two (cross: only pairs across), with kept terms and totals.
    """
    names = ["lang", "a", "b", "term", "value"]

    def blocks(batch):
        lang, found = batch.column(0).dictionary_encode(), batch.column(2)
        number = lang.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(lang.dictionary.to_pylist()):
            chosen = np.flatnonzero(number == k)
            for i in range(0, len(chosen), BLOCK_COLUMNS):
                at = pa.array(chosen[i:i + BLOCK_COLUMNS])
                yield name, batch.column(1).take(at), found.take(at)

    def one(name, terms, cells):
        parts, kept, whole = groups[name]
        width = len(terms)
        column = np.repeat(np.arange(width), np.diff(cells.offsets.to_numpy()))
        flat = cells.flatten()
        count = flat.field("n").to_numpy(zero_copy_only=False)
        known = [s for part in parts for s in part[0]]
        row = pa.compute.index_in(flat.field("source"), pa.array(known, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        totals = np.concatenate([part[1] for part in parts])
        sizes = [len(part[0]) for part in parts]

        if not cross and len(totals):
            by_term = np.zeros(width, np.int64)
            np.add.at(by_term, column, count)
            own = np.flatnonzero(row >= 0)
            p = shares(count[own], totals[row[own]], kept)
            q = shares(by_term[column[own]], np.full(len(own), whole), kept)
            place = np.empty(width, np.int64)
            place[np.array(sorted(range(width), key=[t.encode() for t in terms.to_pylist()].__getitem__), np.int64)] = np.arange(width)
            more = p > q
            own, value = own[more], distance(p[more], q[more])
            order = np.lexsort((place[column[own]], -value, row[own]))
            own, value = own[order], value[order]
            begin = np.searchsorted(row[own], row[own])
            best = np.arange(len(own)) - begin < top
            for k, v in zip(own[best].tolist(), value[best].tolist()):
                yield known[row[k]], None, terms[int(column[k])].as_py(), v

        tiles = []
        for part in range(len(parts)):
            start = sum(sizes[:part])
            tiles.append([np.arange(i, min(i + TILE, start + sizes[part])) for i in range(start, start + sizes[part], TILE)])
        if cross:
            pairs = [(x, y) for x in tiles[0] for y in tiles[1]]
        else:
            pairs = [(x, y) for i, x in enumerate(tiles[0]) for y in tiles[0][i:]]
        place = np.full(len(totals) + 1, -1)
        for x, y in pairs:
            same = x is y
            rows = x if same else np.concatenate([x, y])
            place[:] = -1
            place[rows] = np.arange(len(rows))
            at = place[row]
            inside = np.flatnonzero(at >= 0)
            sums = pair_sums(at[inside], column[inside], count[inside], totals[rows], width, kept, 0 if same else len(x))
            g, h = np.triu_indices(len(rows), 1) if same else (v.ravel() for v in np.indices((len(x), len(y))) + np.array([0, len(x)])[:, None, None])
            for k, m, v in zip(g.tolist(), h.tolist(), sums[g, h].tolist()):
                yield known[rows[k]], known[rows[m]], None, v

    def run(batches):
        for batch in batches:
            for name, terms, cells in blocks(batch):
                found = list(zip(*one(name, terms, cells)))
                if found:
                    types = (pa.string(), pa.string(), pa.string(), pa.int64())
                    arrays = [pa.array(v, t) for v, t in zip(found, types)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(arrays[0]), pa.string()), *arrays], names=names)

    schema = "lang string, a string, b string, term string, value long"
    return columns.select("lang", "term", "cells").mapInArrow(run, schema)


def source_divergence(docs, text_col="text", lang_col="lang", source_col="source", min_docs=10, top_terms=TOP_TERMS, max_groups=MAX_GROUPS):
    """Rows (lang, source, part, item, value, rank), rank from 1 by value downwards, then item by its bytes.

    part "pair": item is each other source of the language, value their summed distance over all kept terms. part "term": item is
    a kept term more frequent in the source than in its language, value its distance, the top_terms highest. Null text, language
    and source count as empty; a source without terms has all counts 0; a language without kept terms has distances 0; a source
    alone in its language has no pairs; repeated rows count each; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    columns = saved(kept_columns(word_counts(docs, text_col, lang_col, source_col), min_docs), "divergence-terms")
    totals = columns.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    kept = columns.groupBy("lang").agg(F.count("*").alias("kept"))
    whole = totals.groupBy("lang").agg(F.sum("n").alias("whole"))
    named = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    groups = (
        named.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").join(whole, "lang", "left")
        .select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", "kept", "whole")))
    )
    groups = saved(groups, "divergence-groups")
    parts = max(1, -(-groups.count() // max_groups))
    part = F.pmod(F.xxhash64("lang", "source"), F.lit(parts))

    priced = []
    for i in range(parts):
        first = groups.where(part == i).collect()
        for j in range(i, parts):
            chosen = [first] if i == j else [first, groups.where(part == j).collect()]
            info = {}
            for k, rows in enumerate(chosen):
                for r in sorted(rows, key=lambda r: r["source"].encode()):
                    of = info.setdefault(r["lang"], ([([], []) for _ in chosen], r["kept"], r["whole"]))
                    of[0][k][0].append(r["source"])
                    of[0][k][1].append(r["n"])
            packed = {lang: ([(s, np.array(n, np.int64)) for s, n in of], kept, whole) for lang, (of, kept, whole) in info.items()}
            # A language with no source in these parts has nothing to price.
            own = columns.join(F.broadcast(spark.createDataFrame([(lang,) for lang in packed], "lang string")), "lang", "left_semi") if packed else columns.limit(0)
            priced.append(_priced(own, packed, i != j, top_terms))
    found = priced[0]
    for more in priced[1:]:
        found = found.unionByName(more)

    term = found.where(F.col("term").isNotNull()).select("lang", F.col("a").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    sums = found.where(F.col("term").isNull()).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # Languages without kept terms: every pair, at 0. Both directions of a pair are part of the result.
    bare = groups.where("kept = 0")
    zero = bare.alias("g").join(bare.alias("h"), (F.col("g.lang") == F.col("h.lang")) & (F.col("g.source") != F.col("h.source")))
    zero = zero.select("g.lang", "g.source", F.lit("pair").alias("part"), F.col("h.source").alias("item"), F.lit(0).cast("long").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = sums.select("lang", both.alias("p"), "value").select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [term.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)]
    ranked += [pair.unionByName(zero).withColumn("rank", F.row_number().over(by))]
    return ranked[0].unionByName(ranked[1])
