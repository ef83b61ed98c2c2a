"""Kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from rollbook.llm import bpe, suffix_dedup
from rollbook.llm.fm_index import FMIndex, suffix_array
from rollbook.llm.kernels import text_chunks, window_hashes, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def samples(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("aAbZz09 .-é日😀\n'") for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", None, "word", "A" * 5000]


def test_words_are_those_of_the_pattern():
    texts = samples()
    seen = {}
    for i, j, data, offsets in text_chunks(pa.array(texts), 64):
        starts, ends, hashes, first = words(data, offsets)
        raw = data.tobytes()
        for k in range(j - i):
            found = [raw[a:z].decode().translate(LOWER) for a, z in zip(starts[first[k]:first[k + 1]], ends[first[k]:first[k + 1]])]
            assert found == plain_words(texts[i + k])
            for word, h in zip(found, hashes[first[k]:first[k + 1]]):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_are_told_apart_by_their_words():
    texts = ["a b c d e f", "b c d e f", "a b", "b a", "", "a", "A b"]
    _, _, hashes, first = words(*next((d, o) for _, _, d, o in text_chunks(pa.array(texts))))
    out, where, row = window_hashes(hashes, first, 3)
    got = {r: [int(h) for h in out[row == r]] for r in range(len(texts))}
    assert [len(got[r]) for r in range(len(texts))] == [4, 3, 1, 1, 0, 1, 1]
    assert got[0][1:] == got[1] and got[2] == got[6] and got[2] != got[3]
    assert (np.diff(where) >= 0).all()


def test_suffix_array_and_backward_search():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 64, 300):
        for size in (1, 2, 7):
            seq = rng.integers(0, size, n)
            assert suffix_array(seq).tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())
            index = FMIndex(seq, size, 4)
            patterns = np.full((40, 5), -1)
            for k in range(40):
                m = rng.integers(1, 6)
                patterns[k, 5 - m:] = rng.integers(0, size, m)
            low, high = index.search(patterns)
            for k in range(40):
                p = patterns[k][patterns[k] >= 0].tolist()
                want = [i for i in range(n - len(p) + 1) if seq[i:i + len(p)].tolist() == p]
                assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_byte_suffixes_and_common_prefixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[300:700] = data[:400]
    data[800:] = 97
    raw = data.tobytes()
    order = suffix_dedup.suffix_order(data)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    common = suffix_dedup.common_prefixes(data, order, 50)
    for k in range(1, len(raw)):
        a, b = raw[order[k - 1]:order[k - 1] + 50], raw[order[k]:order[k] + 50]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_pre_tokens_and_merges_are_those_of_the_library():
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: k for k, t in enumerate(bpe.read_ranks(path))}
    assert ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    classes = bpe.character_classes(public_tokenizers.PATTERN)
    rng = random.Random(5)
    alphabet = [*"ab'sstmdrevell  \n\t1.2! é日́😀՘'\x1c\x85", "'s", "'re", " '", "\r\n", "   "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 500, "ab" * 1500, " " * 100, "x'll'll's", "'" * 9, "<|endoftext|>"]
    for i, j, data, offsets in text_chunks(pa.array(texts)):
        starts, ends, first = bpe.split(data, offsets, classes)
        raw = data.tobytes()
        for k in range(j - i):
            ids = [t for a, z in zip(starts[first[k]:first[k + 1]], ends[first[k]:first[k + 1]]) for t in bpe.merge(raw[a:z], ranks)]
            assert ids == library.encode_ordinary(texts[i + k])
