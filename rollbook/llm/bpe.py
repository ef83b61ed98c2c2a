"""Byte-level BPE encoding and decoding with one global shuffle of distinct words.

1. Tasks cut their texts into pre-tokens and number the distinct ones of each block of texts. A block keeps, for every document,
   the numbers of its pre-tokens in their order: these are the positions, packed.
2. The distinct (word, block, number) rows are shuffled by word; there each word is encoded once, however many blocks hold it.
3. The ids go back to their block, where documents are put together by position; decoding looks ids up in the table of token
   bytes, which has the fixed size of the vocabulary.

A word is once per block in the shuffle, so a hot word has as many rows as there are blocks. The blocks are made twice (for the
words and for the positions) instead of being stored; each carries a checksum of its words in its key, so an input that does not
repeat itself is noticed, never mixed up.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.kernels import BYTE_VALUES, distinct, mix, ranges, rolling, span_hash, text_chunks
from rollbook.llm.shared import texts

BLOCK_BYTES = 32 << 20
GROUP_TOKENS = 1 << 18
ENCODE_ROWS = 1 << 19
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def read_ranks(path):
    """Token bytes in the order of their ranks, from a file of base64 tokens and ranks (at most some 100,000 lines)."""
    with open(path, "rb") as f:
        found = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if sorted(found.values()) != list(range(len(found))):
        raise ValueError("ranks must count from 0 without gaps")
    return sorted(found, key=found.get)


@functools.lru_cache(maxsize=4)
def character_classes(pattern):
    """For each code point whether the pattern takes it for a letter, number, space or other, as the installed library does.

    Versions of Unicode differ between libraries, so the library that sets the standard is asked: a probe letter, digit or sign and
    the code point merge only if the pattern keeps them in one piece.
    """
    import tiktoken

    probes = b"x1!"
    ranks = {bytes([b]): b for b in range(256)} | {bytes([p, b]): 256 * (k + 1) + b for k, p in enumerate(probes) for b in range(256)}
    library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    classes = np.full(0x110000, SPACE, np.uint8)
    for low in range(0, 0x110000, 0x10000):
        points = [c for c in range(low, low + 0x10000) if not 0xD800 <= c < 0xE000 and c >= 128]
        for k, (p, kind) in enumerate(zip(probes, (LETTER, NUMBER, OTHER))):
            ids = np.array(library.encode_ordinary("\n".join(chr(p) + chr(c) for c in points)), np.int64)
            first = ids[(ids == p) | (ids >= 256)]
            classes[np.array(points)[first >= 256]] = kind
    for c in range(128):
        for k, (p, kind) in enumerate(zip(probes, (LETTER, NUMBER, OTHER))):
            if library.encode_ordinary(chr(p) + chr(c))[0] >= 256:
                classes[c] = kind
    return classes


def split(data, offsets, classes):
    """Byte starts and ends of the pre-tokens of rows that lie behind each other, and the position of each row's first (n+1).

    Same pieces as 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ finds in each row.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at_byte = np.zeros(n + 1, np.int64)
    np.cumsum(width, out=at_byte[1:])
    rows = np.searchsorted(at_byte, offsets)
    if not n:
        return at_byte[:0], at_byte[:0], np.zeros(len(offsets), np.int64)
    kind = classes[points]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[0] = run[n] = True
    begins = np.flatnonzero(run[:n])
    stops = np.append(begins[1:], n)

    start = run[:n].copy()
    spaces = (kind[begins] == SPACE) & ~edge[stops]  # runs of space with text behind them
    a, b = begins[spaces], stops[spaces]
    start[b[b - a > 1] - 1] = True
    start[b[points[b - 1] == 32]] = False  # one blank goes with what follows; where the run was only that blank, it starts there

    single = (kind[begins] == OTHER) & (stops - begins == 1) & (points[begins] == 39) & start[begins] & ~edge[stops]
    p = begins[single]
    p = p[kind[p + 1] == LETTER]
    if len(p):
        end = stops[np.searchsorted(stops, p + 1, side="right")]  # of the run of letters behind the apostrophe
        one = points[p + 1]
        two = np.where(p + 2 < end, points[np.minimum(p + 2, n - 1)], 0)
        taken = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        taken = np.where(pair, 2, taken)
        p, end, taken = p[taken > 0], end[taken > 0], taken[taken > 0]
        start[p + 1] = False
        rest = p + 1 + taken
        start[rest[rest < end]] = True
    places = np.flatnonzero(start)
    return at_byte[places], at_byte[np.append(places[1:], n)], np.searchsorted(places, rows)


def merge(word, ranks):
    """Token ids of one pre-token: the adjacent pair of lowest rank, the leftmost of equals, merges until none is a token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n <= 48:
        parts = [word[i:i + 1] for i in range(n)]
        score = [ranks.get(word[i:i + 2]) for i in range(n - 1)]
        while True:
            best, at = None, -1
            for i, s in enumerate(score):
                if s is not None and (best is None or s < best):
                    best, at = s, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del score[at]
            if at < len(score):
                score[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                score[at - 1] = ranks.get(parts[at - 1] + parts[at])
    end = list(range(1, n + 1))  # end of the part that starts here; 0 for no part
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i:
            j = before[i]
            if (r := ranks.get(word[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
    return [ranks[word[i:e]] for i, e in enumerate(end) if e]


def packed(*arrays):
    """Arrays of 32-bit numbers as one compressed value: byte planes, since high bytes are mostly zero."""
    body = b"".join(np.ascontiguousarray(np.asarray(a, np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    head = np.array([len(arrays), *map(len, arrays)], np.uint32).tobytes()
    return head + pa.compress(body, codec="zstd", asbytes=True) if body else head


def unpacked(value):
    k = int(np.frombuffer(value, np.uint32, 1)[0])
    sizes = np.frombuffer(value, np.uint32, k, 4).tolist()
    total = sum(sizes)
    body = np.frombuffer(pa.decompress(value[4 + 4 * k:], 4 * total, codec="zstd"), np.uint8) if total else np.zeros(0, np.uint8)
    out, at = [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(body[at:at + 4 * n].reshape(4, n).T).view(np.uint32).ravel() if n else np.zeros(0, np.uint32))
        at += 4 * n
    return out


class Block:
    """Texts gathered until BLOCK_BYTES: their distinct pre-tokens in order of appearance and, by document, their numbers."""

    def __init__(self, serial):
        self.serial, self.numbers, self.words, self.codes, self.counts, self.ids, self.size = serial, {}, [], [], [], [], 0

    def add(self, ids, data, offsets, classes):
        starts, ends, first = split(data, offsets, classes)
        lengths = ends - starts
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        body = data if bounds[-1] == len(data) else data[ranges(starts, lengths)]
        inverse, found = distinct(np.ascontiguousarray(body), bounds)
        local = np.empty(len(found), np.uint32)
        for k, word in enumerate(found.to_pylist()):
            number = self.numbers.get(word)
            if number is None:
                number = self.numbers[word] = len(self.words)
                self.words.append(word)
            local[k] = number
        self.codes.append(local[inverse])
        self.counts.append(np.diff(first))
        self.ids.append(ids)
        self.size += len(data)

    def key(self):
        """Serial number of the block and a checksum of its words, mixed."""
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        ends = np.cumsum(lengths)
        body = np.frombuffer(b"".join(self.words), np.uint8)
        total = 0
        for i in range(0, len(lengths), 1 << 16):
            e = ends[i:i + (1 << 16)]
            s = e - lengths[i:i + (1 << 16)]
            h = span_hash(rolling(BYTE_VALUES[body[s[0]:e[-1]]]), s - s[0], e - s[0])
            total ^= int(np.bitwise_xor.reduce(mix(h + np.arange(i, i + len(h), dtype=np.uint64))))
        return int(mix(np.array([(self.serial + total) & (2**64 - 1)], np.uint64)).view(np.int64)[0])


def blocks(batches, classes, limit):
    from pyspark import TaskContext

    context = TaskContext.get()
    serial = itertools.count(context.partitionId() << 24 if context else 0)
    block = Block(next(serial))
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            if block.size and block.size + len(data) > limit:
                yield block
                block = Block(next(serial))
            block.add(batch.column(0).slice(i, j - i), data, offsets, classes)
    if block.ids:
        yield block


def encode_texts(docs, path, id_col="doc_id", text_col="text", pattern=None, block_bytes=BLOCK_BYTES):
    """One row per input row: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), decoded (bytes of the decoded ids).

    path is a file of base64 tokens and ranks. Special tokens are ordinary text. Null and empty texts have no tokens; repeated rows
    give repeated rows; an empty table gives no rows. Texts are encoded whole, whatever their length. Other columns are not read.
    The input must give the same rows in each task when read twice, as files do; otherwise the job fails.
    """
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    context = docs.sparkSession.sparkContext
    vocabulary = read_ranks(path)
    shared = context.broadcast((vocabulary, character_classes(pattern)))  # the size of the vocabulary and of Unicode
    source = texts(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType

    def words_of(batches):
        for block in blocks(batches, shared.value[1], block_bytes):
            key, n = block.key(), len(block.words)
            for i in range(0, n, 1 << 16):
                part = block.words[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array(np.full(len(part), key)), pa.array(np.arange(i, i + len(part), dtype=np.int32))],
                    names=["word", "block", "number"],
                )

    def positions_of(batches):
        for block in blocks(batches, shared.value[1], block_bytes):
            ids = pa.concat_arrays(block.ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block.key()]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([packed(np.concatenate(block.counts), np.concatenate(block.codes))], pa.binary()),
                    pa.array([len(block.words)], pa.int64()),
                ],
                names=["block", "ids", "codes", "n_words"],
            )

    def encoded(batches):
        """Words come in order, so equal ones are neighbours. Ids leave in parcels, one for each block and ENCODE_ROWS words."""
        ranks = {t: k for k, t in enumerate(shared.value[0])}
        last, ids = None, []
        keys, numbers, lengths, flat, held = [], [], [], [], 0

        def parcels():
            key, number, length = np.concatenate(keys), np.concatenate(numbers), np.array(lengths, np.int64)
            order = np.argsort(key, kind="stable")
            tokens = np.array(flat, np.uint32)[ranges((np.cumsum(length) - length)[order], length[order])]
            key, number, length = key[order], number[order], length[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            bounds = np.append(first, len(key))
            at = np.concatenate([[0], np.cumsum(length)])
            values = [packed(number[a:z], length[a:z], tokens[at[a]:at[z]]) for a, z in zip(bounds[:-1], bounds[1:])]
            for i in range(0, len(first), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(key[first[i:i + 4096]]), pa.array(values[i:i + 4096], pa.binary())], names=["block", "parcel"])

        for batch in batches:
            keys.append(batch.column(1).to_numpy())
            numbers.append(batch.column(2).to_numpy())
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, ids = word, merge(word, ranks)
                lengths.append(len(ids))
                flat.extend(ids)
            held += batch.num_rows
            if held >= ENCODE_ROWS:
                yield from parcels()
                keys, numbers, lengths, flat, held = [], [], [], [], 0
        if held:
            yield from parcels()

    out_schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType()),
    ])

    def assembled(left, right):
        vocabulary = shared.value[0]
        if left.num_rows != 1:
            raise RuntimeError("The input changed between two reads; write it to a table first.")
        n_words = left["n_words"][0].as_py()
        lengths, seen, pieces = np.zeros(n_words, np.int64), np.zeros(n_words, bool), []
        for value in right["parcel"].to_pylist():
            number, length, tokens = unpacked(value)
            lengths[number] = length
            seen[number] = True
            pieces.append((number, length, tokens))
        if not seen.all():
            raise RuntimeError("The input changed between two reads; write it to a table first.")
        begin = np.cumsum(lengths) - lengths
        table = np.empty(int(lengths.sum()), np.uint32)
        for number, length, tokens in pieces:
            table[ranges(begin[number], length.astype(np.int64))] = tokens
        counts, codes = unpacked(left["codes"][0].as_py())
        ids = left["ids"].combine_chunks().flatten()
        return decoded_documents(ids, counts.astype(np.int64), codes, table, begin, lengths, vocabulary)

    found = (
        source.mapInArrow(words_of, "word binary, block long, number int").repartition("word").sortWithinPartitions("word")
        .mapInArrow(encoded, "block long, parcel binary")
    )
    positions = source.mapInArrow(positions_of, T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("codes", T.BinaryType()), T.StructField("n_words", T.LongType()),
    ]))
    return positions.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(assembled, out_schema)


def token_table(vocabulary):
    """All token bytes behind each other, and where each begins (one more)."""
    at = np.zeros(len(vocabulary) + 1, np.int64)
    np.cumsum([len(t) for t in vocabulary], out=at[1:])
    return np.frombuffer(b"".join(vocabulary), np.uint8), at


def decode(ids, body, at):
    """Bytes of an array of token ids."""
    ids = ids.astype(np.int64)
    return body[ranges(at[ids], at[ids + 1] - at[ids])]


def decoded_documents(doc_ids, counts, codes, table, begin, lengths, vocabulary):
    """Documents put together from the numbers of their words, a bounded number of tokens at a time."""
    body, at = token_table(vocabulary)
    row_start = np.concatenate([[0], np.cumsum(counts)])
    n_tokens, ids_out, text_out = [], [], []
    row = 0
    while row < len(counts):
        stop = max(row + 1, int(np.searchsorted(row_start, row_start[row] + GROUP_TOKENS, side="right")) - 1)
        code = codes[row_start[row]:row_start[stop]].astype(np.int64)
        size = lengths[code]
        ids = table[ranges(begin[code], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[row_start[row:stop + 1] - row_start[row]]
        raw = decode(ids, body, at).tobytes()
        bytes_at = np.concatenate([[0], np.cumsum((at[1:] - at[:-1])[ids])])[ends]
        flat = ids.astype("<u4").tobytes()
        for k in range(stop - row):
            n_tokens.append(int(ends[k + 1] - ends[k]))
            ids_out.append(flat[4 * ends[k]:4 * ends[k + 1]])
            text_out.append(raw[bytes_at[k]:bytes_at[k + 1]])
        row = stop
    return pa.table({
        "doc_id": doc_ids, "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(ids_out, pa.binary()), "decoded": pa.array(text_out, pa.binary()),
    })


def digest(found):
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
