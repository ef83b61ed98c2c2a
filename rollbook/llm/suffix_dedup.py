"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier.

1. Every start of a LENGTH-byte string belongs to the least gram (GRAM bytes, by hash, the leftmost of equals) inside its string;
   equal strings therefore belong to equal grams at the same distance. The starts of one gram lie side by side; they and the
   bytes their strings cover are a snippet.
2. Snippets are shuffled by gram, as hashes. Only grams that occur twice in the corpus matter. Of equal snippets only the first
   place is looked at further; at the others every string starts earlier. Each task does this for its own batches before the
   shuffle, so that a third of all documents being copies sends one row for each batch.
3. Shards hold the snippets of whole grams; a gram with very many places is dealt to several shards. In each shard a suffix array
   (refinement by doubling) and Kasai's common prefixes give the groups of starts with LENGTH bytes in common; the first place of
   a group stays.
4. For grams dealt to several shards, the first strings of each shard are merged in sorted order, where a binary search finds the
   first place of each string.
5. The covered starts go back to their documents and are cut out there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.kernels import BYTE_VALUES, mix, ranges, rolling, span_hash, text_chunks
from rollbook.llm.shared import texts

LENGTH = 100
GRAM = 24
SHARD_BYTES = 1 << 20
SPLIT = 1 << 14


def suffix_order(data):
    """The suffix array of the bytes; a suffix that ends is smaller.

    Ranks over seven bytes are doubled (Larsson-Sadakane); only groups that are still equal are sorted again, in their own places.
    """
    n = len(data)
    # Seven bytes with room for an end mark below all bytes.
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key *= np.uint64(257)
        key[:n - k] += data[k:].astype(np.uint64) + np.uint64(1)
    order = np.argsort(key)
    slots, members, sorted_key, depth = np.arange(n), order, key[order], 7
    rank = np.empty(n, np.int64)
    while True:
        new = np.ones(len(members), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(first, append=len(members))
        rank[members] = np.repeat(slots[first], sizes)
        left = np.repeat(sizes > 1, sizes)
        if not left.any():
            return order
        slots, members = slots[left], members[left]
        after = members + depth
        key = rank[members] * (n + 1)
        inside = after < n
        key[inside] += rank[after[inside]] + 1
        again = np.argsort(key)
        members, sorted_key = members[again], key[again]
        order[slots] = members
        depth *= 2


def common_prefixes(data, order, cap, stride=32):
    """Kasai: for each suffix in order, the bytes (at most cap) it has in common with the one before.

    In text order a common prefix is at most one shorter than that of the position before, so each comparison starts there. The
    text is walked in `stride` interleaved steps, each for all positions that leave the same rest.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.int16), np.arange(-1, -cap - 2, -1, dtype=np.int16)])
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n  # stands for no suffix: its first byte equals none
    common = np.zeros(n, np.int64)
    for rest in range(min(stride, n)):
        at = np.arange(rest, n, stride)
        have = np.maximum(common[at - 1] - 1, 0) if rest else np.zeros(len(at), np.int64)
        have = np.where(before[at] == n, 0, have)
        other = before[at]
        going = np.flatnonzero((have < cap) & (other < n))
        while len(going):
            same = padded[at[going] + have[going]] == padded[np.minimum(other[going] + have[going], n + cap)]
            same &= (at[going] + have[going] < n) & (other[going] + have[going] < n)
            going = going[same]
            have[going] += 1
            going = going[have[going] < cap]
        common[at] = have
    return common[order]


def snippets(data, offsets, length, gram):
    """Gram hash, snippet hash, row, first start and number of starts of each snippet of the rows."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    window = length - gram + 1
    prefix = rolling(BYTE_VALUES[data])
    at = np.arange(n - gram + 1)
    hashes = span_hash(prefix, at, at + gram)
    least = hashes >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if window > span:
        least = np.minimum(least[:span - window], least[window - span:])
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = ranges(offsets[:-1], sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    owner = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(heads, append=len(starts))
    low, row = starts[heads], row[heads]
    return hashes[owner[heads]], span_hash(prefix, low, low + counts + length - 1), row, low - offsets[row], counts


def shard_groups(bodies, length):
    """For snippets in order of their places: for each start (snippet by snippet) whether its string is in an earlier start."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begin = np.cumsum(sizes) - sizes
    order = suffix_order(data)
    group = np.cumsum(common_prefixes(data, order, length) < length)
    starts = ranges(begin, sizes - length + 1)
    of = np.empty(len(data), np.int64)
    of[order] = group
    of = of[starts]
    # Starts come in the order of places, so the first of a group is the one with the smallest index.
    _, first = np.unique(of, return_index=True)
    covered = np.ones(len(starts), bool)
    covered[first] = False
    return starts, covered, sizes - length + 1


def true_runs(flags, counts):
    """Runs of true flags inside consecutive pieces of the given sizes: piece, first offset in the piece, length."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[np.concatenate([[0], np.cumsum(counts)])] = True
    change = edge.copy()
    change[1:-1] |= flags[1:] != flags[:-1]
    at = np.flatnonzero(change)
    at, end = at[:-1], at[1:]
    good = flags[at] if len(flags) else np.zeros(0, bool)
    at, end = at[good], end[good]
    begin = np.cumsum(counts) - counts
    piece = np.searchsorted(begin, at, side="right") - 1
    return piece, at - begin[piece], end - at


# A code holds a first start, a number of starts (below 128) and what it means.
PLACE, COVERED = 0, 2


def code(start, count, meaning):
    return (start * 128 + count) * 4 + meaning


def covered_runs(codes, length):
    """Merged byte runs [start, end) from the codes of covered starts of a document."""
    place = np.sort(np.asarray(codes, np.int64)) >> 2
    start, end = place >> 7, (place >> 7) + (place & 127) + length - 1
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return start[head], reach[np.append(head[1:] - 1, len(start) - 1)]


def salted(table, salts, gram=True):
    """Rows of a table of places with salts (one for all, or one each), with or without their gram."""
    n = table.num_rows
    grams = table.column("gram").combine_chunks() if gram else pa.nulls(n, pa.int64())
    salts = pa.array(np.broadcast_to(np.asarray(salts, np.int32), n))
    return pa.RecordBatch.from_arrays(
        [grams, salts, *(table.column(c).combine_chunks() for c in ("doc_id", "tie", "code"))], names=["gram", "salt", "doc_id", "tie", "code"]
    )


class OpenRun:
    """First places of the gram whose run may go on in the next batch; at most `split` of them are held."""

    def __init__(self, split):
        self.split, self.gram, self.held, self.left, self.rows = split, None, None, 0, 0

    def add(self, gram, firsts, rows):
        """More places of a gram: its new first places, and the number of rows they come from."""
        if gram != self.gram:
            yield from self.close()
            self.gram = gram
        self.rows += rows
        if self.left == 0:
            self.held = firsts if self.held is None else pa.concat_tables([self.held, firsts])
            if self.held.num_rows <= self.split:
                return
            firsts, self.held = self.held, None
        yield salted(firsts, (self.left + np.arange(firsts.num_rows)) // self.split)
        self.left += firsts.num_rows

    def close(self):
        if self.held is not None and self.rows > 1:
            yield salted(self.held, -1)
        self.gram, self.held, self.left, self.rows = None, None, 0, 0


def suffix_dedup(docs, id_col="doc_id", text_col="text", length=LENGTH, gram=GRAM, split=SPLIT, shard_bytes=SHARD_BYTES):
    """One row per input row: doc_id, n_bytes, spans (start, end of the removed runs in UTF-8 bytes), kept (the bytes that stay).

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a document with a smaller id, or in the same
    document further left; overlaps count, and strings are judged on the input. Null texts are empty. A null id is smaller than all
    others. Rows that repeat id and text are one document and share its result; documents that repeat only the id are ordered by a
    hash of their text. Matches never cross documents. An empty table gives no rows. Other columns are not read. Grams and snippets
    are told apart by 64-bit hashes each, strings by their bytes.
    """
    window = length - gram + 1
    if not 0 < window < 128:
        raise ValueError("length - gram must be from 0 to 126")
    source = texts(docs, id_col, text_col)
    repeated = not source.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    source = source.withColumn("tie", F.xxhash64("text") if repeated else F.lit(0).cast("long")).select("doc_id", "tie", "text")
    # Rows that repeat id and text have the same places; only one of them may be looked at, or each would be the other's earlier copy.
    once = source.dropDuplicates(["doc_id", "tie"]) if repeated else source
    id_type = source.schema["doc_id"].dataType

    def cut(batches):
        """Snippets as hashes. Later copies within a batch have no gram: they are covered, whatever the rest of the corpus holds."""
        for batch in batches:
            order = pc.sort_indices(pa.Table.from_batches([batch.select([0, 1])]), [("doc_id", "ascending"), ("tie", "ascending")], null_placement="at_start")
            batch = batch.take(order)
            found = []
            for i, _, data, offsets in text_chunks(batch.column(2)):
                grams, whole, row, start, count = snippets(data, offsets, length, gram)
                found.append((grams, whole, row + i, code(start, count, PLACE)))
            grams, whole, row, codes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
            _, first = np.unique(mix(grams.astype(np.uint64)) ^ whole.astype(np.uint64), return_index=True)
            later = np.ones(len(row), bool)
            later[first] = False
            for k in range(0, len(row), 1 << 17):
                part = slice(k, k + (1 << 17))
                at, null = pa.array(row[part]), later[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[part].view(np.int64), mask=null), pa.array(whole[part].view(np.int64), mask=null),
                        batch.column(0).take(at), batch.column(1).take(at), pa.array(codes[part]),
                    ],
                    names=["gram", "whole", "doc_id", "tie", "code"],
                )

    def sort_out(batches):
        """Rows sorted by gram, snippet and place. Yields later places of snippets (no gram), and first places of repeated grams.

        First places have a salt: -1, or the number of the shard where their gram has more than `split` different snippets.
        """
        run = OpenRun(split)
        last = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            loose = table.column("gram").null_count
            if loose:
                yield salted(table.slice(0, loose), -1)
                table = table.slice(loose)
            if not table.num_rows:
                continue
            grams, whole = table.column("gram").to_numpy(), table.column("whole").to_numpy()
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (whole[1:] != whole[:-1])
            new[0] = (grams[0], whole[0]) != last
            last = grams[-1], whole[-1]
            if not new.all():
                yield salted(table.filter(pa.array(~new)), -1, gram=False)
            edges = np.append(np.flatnonzero(np.append(True, grams[1:] != grams[:-1])), len(grams))
            # Runs that begin and end in this batch are handled at once; the first and the last may go on.
            inner = slice(1, len(edges) - 2)
            starts, ends = edges[:-1][inner], edges[1:][inner]
            if len(starts):
                low, high = starts[0], ends[-1]
                sizes = ends - starts
                firsts = new[low:high] & np.repeat(sizes > 1, sizes)
                counts = np.add.reduceat(firsts.astype(np.int64), starts - low)
                number = ranges(np.zeros(len(counts), np.int64), counts)
                yield salted(table.slice(low, high - low).filter(pa.array(firsts)), np.where(np.repeat(counts, counts) > split, number // split, -1))
            for k in sorted({0, len(edges) - 2}):
                a, z = edges[k], edges[k + 1]
                yield from run.add(grams[a], table.slice(a, z - a).filter(pa.array(new[a:z])), z - a)
        yield from run.close()

    def schema(*fields):
        kinds = {"doc_id": id_type, "bytes": T.BinaryType(), "string": T.BinaryType(), "salt": T.IntegerType()}
        return T.StructType([T.StructField(f, kinds.get(f, T.LongType())) for f in fields])

    places = (
        once.mapInArrow(cut, schema("gram", "whole", "doc_id", "tie", "code"))
        .repartition(F.coalesce("gram", F.xxhash64("doc_id", "code"))).sortWithinPartitions("gram", "whole", "doc_id", "tie", "code")
        .mapInArrow(sort_out, schema("gram", "salt", "doc_id", "tie", "code"))
    )
    firsts = places.where("gram IS NOT NULL")

    def ship(batches):
        """The bytes of the first places, each document's all at once."""
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(2)):
                lists = batch.column(3).slice(i, j - i)
                flat = lists.flatten()
                grams, salt, codes = (flat.field(k).to_numpy() for k in range(3))
                row = np.repeat(np.arange(j - i), pc.list_value_length(lists).to_numpy())
                begin = offsets[row] + (codes >> 9)
                end = begin + (codes >> 2 & 127) + length - 1
                raw = data.tobytes()
                owner = pa.array(row)
                ids, ties = batch.column(0).slice(i, j - i).take(owner), batch.column(1).slice(i, j - i).take(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams), pa.array(salt), ids, ties, pa.array(codes),
                        pa.array([raw[a:z] for a, z in zip(begin.tolist(), end.tolist())], pa.binary()),
                    ],
                    names=["gram", "salt", "doc_id", "tie", "code", "bytes"],
                )

    def judge(batches):
        """Rows sorted by gram and salt. Whole groups of (gram, salt) fill a shard, where they are put in the order of their places."""
        def judged(table):
            table = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("doc_id", "tie", "code")], null_placement="at_start"))
            bodies = table.column("bytes").to_pylist()
            codes, salt = table.column("code").to_numpy(), table.column("salt").to_numpy()
            starts, covered, counts = shard_groups(bodies, length)
            piece, offset, run = true_runs(covered, counts)
            open_ = np.flatnonzero(~covered & np.repeat(salt >= 0, counts))  # first in this shard of a gram dealt to several
            owner = np.repeat(np.arange(len(bodies)), counts)[open_]
            text = b"".join(bodies)
            begin = np.cumsum(counts) - counts
            line = np.concatenate([piece, owner])
            marks = np.concatenate([code((codes[piece] >> 9) + offset, run, COVERED), code((codes[owner] >> 9) + open_ - begin[owner], 1, COVERED)])
            strings = [None] * len(piece) + [text[s:s + length] for s in starts[open_].tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(strings, pa.binary()), *(table.column(c).combine_chunks().take(pa.array(line)) for c in ("doc_id", "tie")), pa.array(marks)],
                names=["string", "doc_id", "tie", "code"],
            )

        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            gram, salt = table.column("gram").to_numpy(), table.column("salt").to_numpy()
            change = np.ones(len(gram), bool)
            change[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
            change[0] = last != (gram[0], salt[0])
            last = gram[-1], salt[-1]
            at = 0
            for z in np.flatnonzero(change).tolist():
                if z > at:
                    part = table.slice(at, z - at)
                    held.append(part)
                    size += part.column("bytes").nbytes
                    at = z
                if size >= shard_bytes:
                    yield judged(pa.concat_tables(held))
                    held, size = [], 0
            held.append(table.slice(at))
            size += held[-1].column("bytes").nbytes
        if held:
            yield judged(pa.concat_tables(held))

    def merged(batches):
        """Rows sorted by string and place. Of each string, which shards found for the first time, only the very first stays."""
        last = None
        for batch in batches:
            strings = batch.column(0)
            loose = strings.null_count
            if loose:  # nulls come first: rows without a question
                yield batch.slice(0, loose).select([1, 2, 3])
            batch = batch.slice(loose)
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), dtype=object)
            first = np.searchsorted(keys, keys, side="left")
            later = first < np.arange(len(keys))
            later[keys == last] = True
            last = keys[-1]
            yield batch.filter(pa.array(later)).select([1, 2, 3])

    wanted = firsts.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("gram", "salt", "code")).alias("firsts"))
    s, w = source.alias("s"), wanted.alias("w")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tie") == F.col(f"{b}.tie"))
    shipped = once.alias("s").join(w, same("s", "w")).select("s.doc_id", "s.tie", "s.text", "w.firsts").mapInArrow(
        ship, schema("gram", "salt", "doc_id", "tie", "code", "bytes")
    )
    marks = (
        shipped.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
        .mapInArrow(judge, schema("string", "doc_id", "tie", "code"))
        # Rows with a question meet by their string; the others may go anywhere.
        .repartition(F.when(F.col("string").isNull(), F.xxhash64("doc_id", "code")).otherwise(F.xxhash64("string"))).sortWithinPartitions("string", "doc_id", "tie", "code")
        .mapInArrow(merged, schema("doc_id", "tie", "code"))
    )
    # At places that are not the first of their snippet all strings are covered.
    later = places.where("gram IS NULL").select("doc_id", "tie", F.col("code").bitwiseOR(COVERED).alias("code"))
    codes = later.unionByName(marks).groupBy("doc_id", "tie").agg(F.collect_list("code").alias("codes"))

    def remove(batches):
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                found = batch.column(2).slice(i, j - i).to_pylist()
                raw, spans, kept = data.tobytes(), [], []
                for r, c in enumerate(found):
                    a, z = int(offsets[r]), int(offsets[r + 1])
                    starts, ends = covered_runs(c, length) if c else ((), ())
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(starts, ends)])
                    at, parts = a, []
                    for x, y in zip(starts, ends):
                        parts.append(raw[at:a + int(x)])
                        at = a + int(y)
                    kept.append(b"".join([*parts, raw[at:z]]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    c = codes.alias("c")
    return s.join(c, same("s", "c"), "left").select("s.doc_id", "s.text", "c.codes").mapInArrow(remove, T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType()),
    ]))


def digest(found):
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
