"""N-gram Jaccard join by chosen paths.

1. Each document becomes the set of its word shingles. Documents with equal sets are one text from here on.
2. A set is embedded as T_COORDINATES min-hashes; two sets agree in one with a probability equal to their similarity.
3. Chosen paths: every run starts at a root; a node samples coordinates (its path alone decides which) and a set goes on to the
   child named by its value there. Sets alone in a node drop out, nodes of at most LEAF sets are compared by brute force, larger
   ones are split again, down to DEPTH, by two levels at once where children could still be too large. What still stays together
   there, or a child that keeps DENSE of its parent's sets for each level, is so alike that it is taken as one plausible group:
   splitting on would only repeat it.
   Runs are repeated until the expected recall at the threshold reaches the target.
4. Groups of plausible sets are joined to components, and within a component all pairs are checked exactly on the whole sets, in
   blocks of BLOCK sets a side. A pair meets in one pair of blocks only, so links are counted once, and pairs are never emitted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.components import components
from rollbook.llm.kernels import mix, text_chunks, window_hashes, words
from rollbook.llm.shared import join_groups, saved, texts

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
T_COORDINATES = 128
LEAF = 256
DEPTH = 6
DENSE = 0.75
BLOCK = 256
_COLUMNS = 4096

_MULTIPLIERS = mix(np.arange(1, T_COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ADDENDS = mix(np.arange(1001, 1001 + T_COORDINATES, dtype=np.uint64))


def second_share(similarity):
    """How often a node samples a second coordinate: 1 / similarity on average, so that expected paths of a link don't die out."""
    return min(1.0, 1 / similarity - 1)


def expected_recall(similarity, runs, depth=DEPTH):
    """Expected probability that a pair just at the threshold meets in a node of full depth in one of the runs.

    All runs draw from the same min-hashes, so the runs are independent only for a given number of agreeing coordinates.
    """
    two, total = second_share(similarity), 0.0
    for k in range(T_COORDINATES + 1):
        alive = 1.0
        for _ in range(depth):
            x = k / T_COORDINATES * alive
            alive = (1 - two) * x + two * (1 - (1 - x) ** 2)
        total += math.comb(T_COORDINATES, k) * similarity ** k * (1 - similarity) ** (T_COORDINATES - k) * (1 - (1 - alive) ** runs)
    return total


def runs_needed(similarity, recall, depth=DEPTH):
    """Runs after which a pair just at the threshold has met in a node of full depth with the wanted probability."""
    low, high = 0, 1
    while expected_recall(similarity, high, depth) < recall:
        low, high = high, 2 * high
        if high > 1 << 20:
            raise ValueError(f"No number of runs reaches a recall of {recall} at a similarity of {similarity}.")
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if expected_recall(similarity, middle, depth) >= recall else (middle, high)
    return high


def children(paths, two):
    """For each path its sampled coordinates: (row of the path, coordinate). The path alone decides."""
    h = mix(paths.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    first = (h % np.uint64(T_COORDINATES)).astype(np.int64)
    again = np.flatnonzero((h >> np.uint64(32)).astype(np.float64) / 2**32 < two)
    other = (first[again] + 1 + ((h[again] >> np.uint64(8)) % np.uint64(T_COORDINATES - 1)).astype(np.int64)) % T_COORDINATES
    return np.concatenate([np.arange(len(paths)), again]), np.concatenate([first, other])


def child_path(paths, coordinates, values):
    return mix(mix(paths.view(np.uint64) + np.uint64(1)) + coordinates.astype(np.uint64) * np.uint64(0x100000001B3) + (values.astype(np.uint64) << np.uint64(20))).view(np.int64)


def shingle_sets(data, offsets, size):
    """Distinct shingle hashes of each row, ordered within the row, and the position of each row's first (n+1)."""
    _, _, hashes, first = words(data, offsets)
    out, _, row = window_hashes(hashes, first, size)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(offsets)))


def set_prints(hashes, first, some):
    """128-bit fingerprints of the non-empty sets."""
    one = np.add.reduceat(mix(hashes), first[:-1][some])
    two = np.add.reduceat(mix(hashes ^ np.uint64(0x5DEECE66D1234567)), first[:-1][some])
    return np.stack([one, two], axis=1)


def embeddings(hashes, first, some):
    """Min-hashes (32 bits) of the non-empty sets, one line each."""
    out = np.empty((len(some), T_COORDINATES), np.uint32)
    at = first[:-1][some]
    for k in range(T_COORDINATES):
        out[:, k] = np.minimum.reduceat(((hashes * _MULTIPLIERS[k] + _ADDENDS[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def sorted_groups(batches, keys):
    """Tables of rows that agree in the key columns, from batches sorted by them; a group may span batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = np.append(np.flatnonzero(change), table.num_rows)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            key = tuple(c[a] for c in columns)
            if key != now and held:
                yield now, pa.concat_tables(held)
                held = []
            now = key
            held.append(table.slice(a, z - a))
    if held:
        yield now, pa.concat_tables(held)


def clusters(near):
    """Labels of the connected rows of a symmetric matrix of booleans."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def agreement(sketches):
    """Shares of equal bytes between all rows, a few rows at a time."""
    n = len(sketches)
    out = np.empty((n, n), np.float32)
    step = max(1, (1 << 22) // (n * T_COORDINATES))
    for i in range(0, n, step):
        out[i:i + step] = (sketches[i:i + step, None, :] == sketches[None, :, :]).mean(axis=2)
    return out


def plausible(similarity):
    """Least agreement of a pair that may reach the similarity: five standard deviations below it."""
    return similarity - 5 * math.sqrt(similarity * (1 - similarity) / T_COORDINATES)


def intersections(values, owner, n):
    """Sizes of the intersections of n sets, from the concatenated distinct values and the owner of each."""
    codes, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    place = np.cumsum(counts > 1) - 1
    shared = counts[at] > 1
    column, row = place[at[shared]], owner[shared]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, total, _COLUMNS):
        a, z = np.searchsorted(column, [low, low + _COLUMNS])
        part = np.zeros((n, min(_COLUMNS, total - low)), np.float32)
        part[row[a:z], column[a:z] - low] = 1
        out += part @ part.T
    return out


def jaccard_join(docs, id_col="doc_id", text_col="text", size=SHINGLE, similarity=SIMILARITY, recall=RECALL, leaf=LEAF, block=BLOCK, depth=DEPTH):
    """One row per input row: doc_id, class_id, n_links, n_linked_docs, n_copies.

    Two texts are linked if the Jaccard similarity of their sets of `size`-word shingles is at least `similarity`; a text of fewer
    words, but not none, is one shingle. class_id is the smallest doc_id of the connected texts, n_links the number of other texts
    (different sets) linked to this one, n_linked_docs the number of other documents behind them and behind equal sets, n_copies
    the number of documents with the same set, this one included. Texts without words, null ones too, are linked to nothing.
    Repeated rows are copies of each other. A null doc_id comes first in the order of ids, as a class id too. An empty table gives
    no rows. Other columns are not read. Checked links are exact; the expected recall at the threshold is `recall`, above it more.
    """
    source = texts(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType
    two, runs = second_share(similarity), runs_needed(similarity, recall, depth)

    def embed(batches):
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64)).view(np.int64)
        run, coordinate = children(roots, two)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                hashes, first = shingle_sets(data, offsets, size)
                some = np.flatnonzero(np.diff(first))
                n = j - i
                prints, sketches, paths = [None] * n, [None] * n, [None] * n
                if len(some):
                    values = embeddings(hashes, first, some)
                    names = child_path(np.broadcast_to(roots[run], (len(some), len(run))).ravel(), np.broadcast_to(coordinate, (len(some), len(run))).ravel(), values[:, coordinate].ravel()).reshape(len(some), -1)
                    low = mix(values.ravel().astype(np.uint64)).astype(np.uint8).reshape(values.shape)
                    for k, p, s, w in zip(some.tolist(), set_prints(hashes, first, some), low, names):
                        prints[k], sketches[k], paths[k] = p.tobytes(), s.tobytes(), w
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                    names=["doc_id", "print", "sketch", "paths"],
                )

    rows = saved(source.mapInArrow(embed, T.StructType([
        T.StructField("doc_id", id_type), T.StructField("print", T.BinaryType()), T.StructField("sketch", T.BinaryType()), T.StructField("paths", T.ArrayType(T.LongType())),
    ])), "embedded")
    sets = saved(
        rows.where("print IS NOT NULL").groupBy("print")
        .agg(F.min(F.struct("doc_id")).alias("best"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
        .select(F.monotonically_increasing_id().alias("rid"), "print", "best", "copies", "sketch", "paths"),
        "sets",
    )
    edges = _plausible_groups(sets, two, leaf, depth, plausible(similarity))
    groups = components(edges)
    checked = _checked(source, sets, groups, size, similarity, block)
    classes = components(checked.where("node IS NOT NULL").select("rid", "node"))

    links = checked.groupBy("rid").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    named = sets.select("rid", "best", "copies", "print").join(classes, "rid", "left").join(links, "rid", "left")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("best").alias("class"))
    named = join_groups(named, least, "label", "left").select("print", F.coalesce("class", "best").alias("class"), "copies", "links", "linked")
    return (
        rows.select("doc_id", "print").join(named, "print", "left")
        .select(
            "doc_id", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("class.doc_id")).alias("class_id"),
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            (F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_linked_docs"),
            F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        )
    )


def _plausible_groups(sets, two, leaf, depth, least):
    """(rid, node): sets that meet in a node are plausibly linked, or stayed together down to full depth."""
    def crowded(rows):
        """Rows of paths with at least two sets, with the number of sets."""
        sizes = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        return join_groups(rows, sizes, "path")

    def split(batches):
        for batch in batches:
            paths, rid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sketches = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, T_COORDINATES)
            n, level = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            # A node whose children can still be too large to compare goes down two levels at once: one written table less.
            twice = (n * DENSE > leaf) & (level + 2 <= depth)
            row, coordinate = children(paths, two)
            down = child_path(paths[row], coordinate, sketches[row, coordinate])
            again = np.flatnonzero(twice[row])
            second, coordinate = children(down[again], two)
            origin = row[again][second]
            down = np.concatenate([down[~twice[row]], child_path(down[again][second], coordinate, sketches[origin, coordinate])])
            row = np.concatenate([row[~twice[row]], origin])
            steps = 1 + twice[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(down), pa.array(rid[row]), batch.column(2).take(pa.array(row)), pa.array(n[row] * DENSE ** steps), pa.array((level[row] + steps).astype(np.int32))],
                names=["path", "rid", "sketch", "dense", "level"],
            )

    def compare(batches):
        for (path,), table in sorted_groups(batches, ["path"]):
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, T_COORDINATES)
            label = clusters(agreement(sketches) >= least)
            size = np.bincount(label, minlength=len(label))
            keep = size[label] > 1
            if keep.any():
                node = mix(np.array([path], np.int64).view(np.uint64) + label[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                yield pa.RecordBatch.from_arrays([table.column("rid").combine_chunks().filter(pa.array(keep)), pa.array(node)], names=["rid", "node"])

    first = crowded(sets.select("rid", F.explode("paths").alias("path")))
    now = first.join(sets.select("rid", "sketch"), "rid").select("path", "rid", "sketch", "n", F.lit(None).cast("double").alias("dense"), F.lit(1).alias("level"))
    now, found = saved(now, "paths"), None
    while True:
        small = now.where(F.col("n") <= leaf).select("path", "rid", "sketch").repartition("path").sortWithinPartitions("path").mapInArrow(compare, "rid long, node long")
        found = small if found is None else found.unionByName(small)
        large = now.where(F.col("n") > leaf)
        settled = (F.col("level") >= depth) | F.coalesce(F.col("n") >= F.col("dense"), F.lit(False))
        found = found.unionByName(large.where(settled).select("rid", F.col("path").alias("node")))
        large = large.where(~settled)
        if large.isEmpty():  # after `depth` rounds at most
            return found
        # Written before it is counted and joined: a plan that reads the split twice would also run it twice.
        parts = saved(large.select("path", "rid", "sketch", "n", "level").mapInArrow(split, "path long, rid long, sketch binary, dense double, level int"), "split")
        now = saved(crowded(parts).select("path", "rid", "sketch", "n", "dense", "level"), "paths")


def _checked(source, sets, groups, size, similarity, block):
    """(rid, links, linked, node): exact links within one pair of blocks of a component, and a node that linked sets share there."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("m"))
    members = join_groups(groups, sizes, "label").join(sets.select("rid", "print", "best", "copies"), "rid")
    members = members.select(
        "rid", "label", "copies", F.ceil(F.col("m") / block).cast("int").alias("blocks"), F.col("print").alias("wanted"), F.col("best.doc_id").alias("member_id"),
    )
    with_text = source.join(members, source["doc_id"].eqNullSafe(members["member_id"])).select("rid", "label", "copies", "blocks", "wanted", "text")

    def deal(batches):
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for i, j, data, offsets in text_chunks(batch.column(5)):
                hashes, first = shingle_sets(data, offsets, size)
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                rid, label, copies, blocks, wanted = (c.slice(i, j - i) for c in columns)
                same = [p.tobytes() == w for p, w in zip(set_prints(hashes, first, some), wanted.take(pa.array(some)).to_pylist())]
                some = some[np.array(same, bool)]
                rid, label, copies, blocks = (c.take(pa.array(some)).to_numpy() for c in (rid, label, copies, blocks))
                own = (mix(rid.astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                for a in range(0, len(some), 64):
                    part = np.arange(a, min(a + 64, len(some)))
                    line = np.repeat(part, blocks[part])
                    other = np.concatenate([np.arange(blocks[k]) for k in part])
                    body = [hashes[first[some[k]]:first[some[k] + 1]].tobytes() for k in part]
                    low, high = np.minimum(own[line], other), np.maximum(own[line], other)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(label[line]), pa.array(low << 32 | high), pa.array(rid[line]), pa.array(copies[line]), pa.array(own[line]), pa.array([body[k - a] for k in line], pa.binary())],
                        names=["label", "pair", "rid", "copies", "own", "shingles"],
                    )

    def check(batches):
        for (label, pair), table in sorted_groups(batches, ["label", "pair"]):
            rid, at = np.unique(table.column("rid").to_numpy(), return_index=True)
            copies, own = table.column("copies").to_numpy()[at], table.column("own").to_numpy()[at]
            bodies = table.column("shingles").take(pa.array(at)).to_pylist()
            lengths = np.array([len(b) // 8 for b in bodies])
            values = np.frombuffer(b"".join(bodies), np.uint64)
            both = intersections(values, np.repeat(np.arange(len(rid)), lengths), len(rid))
            linked = both >= similarity * (lengths[:, None] + lengths[None, :] - both) - 1e-6
            np.fill_diagonal(linked, False)
            if pair >> 32 != pair & 0xFFFFFFFF:
                linked &= own[:, None] != own[None, :]
            counts = linked.sum(axis=1)
            node = mix(clusters(linked).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([label], np.int64).view(np.uint64)) + mix(np.array([pair], np.int64).view(np.uint64) + np.uint64(7)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(counts.astype(np.int64)), pa.array(linked @ copies), pa.array(node.view(np.int64), mask=counts == 0)],
                names=["rid", "links", "linked", "node"],
            )

    dealt = with_text.select("rid", "label", "copies", "blocks", "wanted", "text").mapInArrow(
        deal, "label long, pair long, rid long, copies long, own long, shingles binary"
    )
    return saved(
        dealt.repartition("label", "pair").sortWithinPartitions("label", "pair").mapInArrow(check, "rid long, links long, linked long, node long"), "checked"
    )
