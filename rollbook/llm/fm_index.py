"""An FM-index over a sequence of symbols in numpy: suffix array by refinement, wavelet matrix, backward search, sampled locate."""

from __future__ import annotations

import numpy as np


def suffix_array(seq):
    """Order of all suffixes of a sequence of non-negative integers (a suffix that ends is smaller).

    Ranks are first taken over as many symbols as fit into 63 bits, then doubled; only groups that are still equal are sorted
    again, in the places they hold already.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    seq = seq.astype(np.int64) + 1
    bits = max(1, int(seq.max()).bit_length())
    depth = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        key[:n - k] |= seq[k:] if k < n else 0
    slots = np.arange(n)
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    members = sa
    sorted_key = key[sa]
    while True:
        new = np.empty(len(members), bool)
        new[0] = True
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
        first = np.flatnonzero(new)
        sizes = np.diff(first, append=len(members))
        rank[members] = np.repeat(slots[first], sizes)
        left = np.repeat(sizes > 1, sizes)
        if not left.any():
            return sa
        slots, members = slots[left], members[left]
        after = members + depth
        key = rank[members] * (n + 1)
        inside = after < n
        key[inside] += rank[after[inside]] + 1
        order = np.argsort(key, kind="stable")
        members, sorted_key = members[order], key[order]
        sa[slots] = members
        depth *= 2


class Bits:
    """A bit vector with rank: ones before a position, by counts per 64 bits."""

    def __init__(self, bits):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at):
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, at):
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Count and locate patterns in a sequence of symbols below `size`; `sample` is the distance of kept suffix positions."""

    def __init__(self, seq, size, sample=16):
        # Symbol 0 is the end mark; it makes the suffixes of the text those of one closed rotation.
        seq = np.append(np.asarray(seq, np.int64) + 1, 0)
        self.n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]
        counts = np.bincount(seq, minlength=size + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.depth = max(1, int(size).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            ones = (bwt >> level) & 1 == 1
            self.levels.append(Bits(ones))
            self.zeros.append(int(self.n - ones.sum()))
            bwt = np.concatenate([bwt[~ones], bwt[ones]])
        self.bottom = self._descend(np.arange(size + 1), np.zeros(size + 1, np.int64))
        kept = sa % sample == 0
        self.kept, self.positions = Bits(kept), sa[kept]

    def _descend(self, symbols, at):
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbols >> (self.depth - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def step(self, symbols, at):
        """Rows before which suffixes stand that begin with the symbol and go on with a suffix before row `at`."""
        return self.before[symbols] + self._descend(symbols, at) - self.bottom[symbols]

    def search(self, patterns):
        """Row ranges [low, high) of patterns, one a line, right-aligned; a negative symbol stands left of a shorter pattern."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            now = alive[patterns[alive, k] >= 0]
            if not len(now):
                break
            symbols = patterns[now, k].astype(np.int64) + 1
            both = self.step(np.concatenate([symbols, symbols]), np.concatenate([low[now], high[now]]))
            low[now], high[now] = both[:len(now)], both[len(now):]
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(high, low)

    def locate(self, rows):
        """Positions in the text of the suffixes in these rows: steps back to the next kept position."""
        rows = rows.astype(np.int64)
        out = np.zeros(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            found = self.kept.get(at)
            out[open_[found]] = self.positions[self.kept.rank(at[found])] + steps
            open_, at = open_[~found], at[~found]
            symbols = np.zeros(len(at), np.int64)
            for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
                one, ones = bits.get(at), bits.rank(at)
                symbols = symbols << 1 | one
                at = np.where(one, zeros + ones, at - ones)
            at = self.before[symbols] + at - self.bottom[symbols]
            steps += 1
        return out
