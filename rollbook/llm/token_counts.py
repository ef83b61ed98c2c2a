"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic programming carries the best score and the
number of pieces, and no segmentation. Where no piece but the space mark's own crosses a blank, a text falls apart into words at
blanks, and each task counts a distinct word once. Rows are counted where they lie; nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from rollbook.llm.kernels import distinct, text_chunks
from rollbook.llm.shared import texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: below the lowest score of a piece
MEMO_WORDS = 500_000


def read_pieces(path):
    """Pieces with their scores from a sentencepiece model; their number is that of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces of texts. Unknown characters are their bytes if the vocabulary has all byte pieces, else one piece a run."""

    def __init__(self, pieces):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in names)
        self.memo = {}

    def count(self, text):
        """Pieces of the best segmentation. Of equal scores the longest last piece wins, as an earlier start is seen first."""
        n = len(text)
        ends = [[] for _ in range(n)]
        for end, (size, score) in self.automaton.iter(text):
            ends[end].append((size, score))
        best, pieces, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(n):
            top, number, unknown, single = None, 0, False, False
            for size, score in sorted(ends[e], reverse=True):
                single |= size == 1
                found = best[e + 1 - size] + score
                if top is None or found > top:
                    top, number, unknown = found, pieces[e + 1 - size] + 1, False
            if not single:
                found = best[e] + self.unknown
                if top is None or found > top:
                    more = len(text[e].encode()) if self.bytes else 0 if run[e] else 1
                    top, number, unknown = found, pieces[e] + more, True
            best[e + 1], pieces[e + 1], run[e + 1] = top, number, unknown
        return pieces[n]

    def rows(self, data, offsets):
        """Piece counts of rows; each text is read with a blank before it, and blanks as the space mark."""
        raw = data.tobytes()
        if not self.splits:
            texts_ = (raw[a:z].decode() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            return np.array([self.count((MARK + t).replace(" ", MARK)) if t else 0 for t in texts_], np.int64)
        # A word begins at a blank that follows no blank, and where a row begins; the mark itself counts as a blank.
        blank = data == 32
        if MARK.encode() in raw:
            at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            blank[at] = blank[at + 1] = blank[at + 2] = True
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        row_begin = offsets[:-1][np.diff(offsets) > 0]
        begin[row_begin] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(data))
        first = np.zeros(len(data), bool)
        first[row_begin] = True
        first = first[starts]
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        words, _ = distinct(np.ascontiguousarray(data), np.append(starts, len(data)))
        _, where, inverse = np.unique(2 * words.astype(np.int64) + first, return_index=True, return_inverse=True)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        counts = np.empty(len(where), np.int64)
        for k, (s, e, f) in enumerate(zip(starts[where].tolist(), ends[where].tolist(), first[where].tolist())):
            word = (MARK if f else "") + raw[s:e].decode().replace(" ", MARK)
            number = self.memo.get(word)
            if number is None:
                number = self.memo[word] = self.count(word)
            counts[k] = number
        total = np.concatenate([[0], np.cumsum(counts[inverse])])
        return np.diff(total[np.searchsorted(starts, offsets)])


def count_tokens(docs, pieces, id_col="doc_id", text_col="text"):
    """One row per input row: doc_id, n_tokens.

    pieces are (text, score) pairs, a vocabulary's worth. Null and empty texts have no tokens; repeated rows give repeated rows;
    an empty table gives no rows. Texts are counted whole. Other columns are not read. Control pieces count as ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(pieces))

    def run(batches):
        counter = Counter(shared.value)
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counter.rows(data, offsets))], names=["doc_id", "n_tokens"])

    source = texts(docs, id_col, text_col)
    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType())]))
