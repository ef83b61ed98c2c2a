"""Vector kernels over the byte buffers of Arrow text columns, used inside tasks.

A word is a maximal run of the bytes 0-9, A-Z, a-z and 0x80-0xFF, lower-cased for A-Z only; in UTF-8 this is the same as the
pattern [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ over the lower-cased text. Word hashes are polynomials modulo the prime 2**61 - 1 and the
same in every task. The cheaper span_hash() is one modulo 2**64, for which texts of 1,024 bytes can be made that collide; it is for
spans shorter than that, and where a collision does no harm. Where equal words must be told by their bytes, coded() does that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True


def mix(x):
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n):
    """Powers 0..n-1 of the hash base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)

        def table(base):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            return out

        made = (table(_BASE), table(inverse))
        if n > CHUNK_BYTES + 1:
            return made  # for one long text only; not kept
        _powers = made
    return _powers


def rolling(values):
    """Prefix sums of values times powers, and the inverse powers: span_hash() takes hashes of spans from them."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return sums, down


def span_hash(prefix, starts, ends):
    sums, down = prefix
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


PRIME = np.uint64((1 << 61) - 1)
_PRIME_BASE = 0x0B7E151628AED2A6 % int(PRIME)
_BLOCK = 1 << 20
_31, _30, _61 = np.uint64(31), np.uint64(30), np.uint64(61)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_LOWER_NUMBERS = LOWER.astype(np.uint64) + np.uint64(1)
_prime_powers = None


def reduced(x):
    """x modulo the prime, for any x of 64 bits."""
    x = (x & PRIME) + (x >> _61)
    return np.where(x >= PRIME, x - PRIME, x)


def product(a, b):
    """a times b modulo the prime, for numbers below it."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return reduced(reduced(np.uint64(2) * a1 * b1 + (middle >> _30) + ((middle & _LOW30) << _31)) + a0 * b0)


def prime_powers():
    """Powers 0.._BLOCK-1 of the base as low 31 and high 30 bits, and those of its inverse; made once in a process."""
    global _prime_powers
    if _prime_powers is None:
        def table(base):
            out = np.ones(_BLOCK, np.uint64)
            done = 1
            while done < _BLOCK:
                out[done:2 * done] = product(out[:done], np.uint64(pow(base, done, int(PRIME))))
                done *= 2
            return out

        up = table(_PRIME_BASE)
        _prime_powers = up & _LOW31, up >> _31, table(pow(_PRIME_BASE, -1, int(PRIME)))
    return _prime_powers


def prime_hashes(numbers, starts, ends):
    """Hashes of spans of small numbers (1 to 256), mixed. The powers begin anew every _BLOCK places, so tables stay small."""
    low, high, down = prime_powers()
    sums = [np.zeros(len(numbers) + 1, np.uint64) for _ in range(2)]
    for i in range(0, len(numbers), _BLOCK):
        part = numbers[i:i + _BLOCK]
        for total, power in zip(sums, (low, high)):
            np.cumsum(part * power[:len(part)], out=total[i + 1:i + 1 + len(part)])
            total[i + 1:i + 1 + len(part)] += total[i]

    def within(s, e):
        """Values of spans that lie in one block each; differences of the sums are right although the sums may wrap around."""
        h = reduced(sums[1][e] - sums[1][s])
        h = reduced((h >> _30) + ((h & _LOW30) << _31) + reduced(sums[0][e] - sums[0][s]))
        return product(h, down[s % _BLOCK])

    out = within(starts, np.minimum(ends, (starts // _BLOCK + 1) * _BLOCK))
    for k in np.flatnonzero((ends - 1) // _BLOCK > starts // _BLOCK):
        value, at, step = int(out[k]), (int(starts[k]) // _BLOCK + 1) * _BLOCK, 0
        while at < ends[k]:
            piece = int(within(np.array([at]), np.array([min(int(ends[k]), at + _BLOCK)]))[0])
            value = (value + piece * pow(_PRIME_BASE, at - int(starts[k]), int(PRIME))) % int(PRIME)
            at += _BLOCK
        out[k] = value
    return mix(out)


def text_buffers(column):
    """The bytes of a text or binary column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) else column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    if not pa.types.is_large_string(column.type):
        column = column.cast(wide)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets, limit=CHUNK_BYTES):
    """Row ranges (i, j) that hold at most limit bytes, or a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data, offsets, mask=IS_WORD):
    """Starts and ends of the runs of bytes in mask, of rows that lie behind each other in data; offsets are relative to data."""
    inside = mask[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data, offsets):
    """Word starts, ends, hashes, and for each row the position of its first word (n+1 values)."""
    starts, ends = word_spans(data, offsets)
    hashes = prime_hashes(_LOWER_NUMBERS[data], starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def distinct(body, bounds):
    """Numbers of the pieces of body between bounds, and the distinct pieces; they are told apart by their bytes."""
    bounds = np.ascontiguousarray(bounds, np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def coded(data, offsets, mask=IS_WORD):
    """Numbers of the words, the distinct words (A-Z lower-cased), and for each row the position of its first word (n+1 values)."""
    starts, ends = word_spans(data, offsets, mask)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    numbers, words_ = distinct(np.ascontiguousarray(LOWER[data[mask[data]]]), bounds)
    return numbers, words_, np.searchsorted(starts, offsets)


def counted(numbers, first, size):
    """Row, number and count of each number of a row that has it; numbers are below size."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys, counts = np.unique(row * size + numbers, return_counts=True)
    return keys // max(size, 1), keys % max(size, 1), counts

def text_chunks(column, limit=CHUNK_BYTES):
    """For each chunk of a column: first row, last row, its bytes and its own offsets from 0."""
    data, offsets = text_buffers(column)
    for i, j in chunks(offsets, limit):
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]


def window_hashes(hashes, first, size):
    """Hashes of runs of `size` words; a row with fewer words, but not none, is one run. Returns hashes, their first word, row."""
    n = len(hashes)
    rows = len(first) - 1
    counts = np.diff(first)
    odd = [np.uint64(v) for v in (mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1))]
    out, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(rows), counts)
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total += hashes[k:n - size + 1 + k] * odd[k]
        where = np.flatnonzero(owner[:n - size + 1] == owner[size - 1:])
        out = mix(total[where])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += hashes[first[short[has]] + k] * odd[k]
        out = np.concatenate([out, mix(extra + counts[short].astype(np.uint64))])
        where = np.concatenate([where, first[short]])
        order = np.argsort(where, kind="stable")
        out, where = out[order], where[order]
    return out, where, owner[where] if n else where


def ranges(starts, counts):
    """The numbers starts[i] .. starts[i]+counts[i]-1 of all i, one range after another."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(np.asarray(starts, np.int64) - ends + counts, counts)
