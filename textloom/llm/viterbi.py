"""Token counts of a unigram vocabulary, without the tokens: count-only Viterbi.

For each distinct chunk an Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and the number of pieces of its segmentation. The
tie rules are those of the `tokenizers` Unigram model: a candidate replaces the best one of its end only
if it scores more, and candidates come by ascending start, a character without a piece of its own last,
at the least score of the vocabulary less 10; with byte fallback it counts its UTF-8 bytes.

A space becomes the mark U+2581 and one mark precedes the text. No piece holds a mark after another
character or a line end, so segmentations never cross the places before a run of spaces or around a line
end: chunks between them are counted once each (a vocabulary without that property is refused).

Defined cases: a null or empty text has no tokens; very long texts are counted whole, chunk by chunk;
repeated rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import pieces, text_buffers, word_hashes
from ._worker import in_batches

MARK = "▁"
_PENALTY = 10.0
#: Distinct chunks remembered by a worker; beyond that it begins anew.
REMEMBERED = 1 << 21


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Normal pieces and scores of a sentencepiece file, and whether all byte pieces are there."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    normal = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return normal, sum(sp.is_byte(i) for i in ids) == 256


class Counter:
    """Pieces of the best segmentation of a chunk."""

    def __init__(self, normal: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        crossing = [p for p, _ in normal if MARK in p.lstrip(MARK) or "\n" in p and p != "\n"]
        if crossing:
            raise ValueError(f"pieces cross chunk ends: {crossing[:3]}")
        self.automaton = ahocorasick.Automaton()
        for piece, score in normal:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.byte_fallback = byte_fallback
        self.unknown = min((s for _, s in normal), default=0.0) - _PENALTY

    def __call__(self, chunk: str) -> int:
        n = len(chunk)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = bytearray(n)
        for end, found in self.automaton.iter(chunk):
            ends[end].append(found)
            if found[0] == 1:
                single[end] = 1
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            best = None
            many = 0
            bad = False
            found = ends[end]
            if len(found) > 1:
                found.sort(reverse=True)  # longest first: ascending start
            for length, s in found:
                s += score[end + 1 - length]
                if best is None or s > best:
                    best, many = s, count[end + 1 - length] + 1
            if not single[end]:
                s = score[end] + self.unknown
                if best is None or s > best:
                    best, bad = s, True
                    # unknown neighbours are one token, unless bytes stand for them
                    many = count[end] + (len(chunk[end].encode("utf-8", "surrogatepass")) if self.byte_fallback else not unknown[end])
            score[end + 1], count[end + 1], unknown[end + 1] = best, many, bad
        return count[n]


class _Counts:
    def __init__(self, path: str):
        self.path, self.count = path, Counter(*vocabulary(path))
        self.reset()

    def reset(self) -> None:
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]

    def _find(self, u: np.ndarray) -> np.ndarray:
        out = np.full(len(u), -1, np.int64)
        for keys, counts in self.tables:
            if len(keys):
                i = np.searchsorted(keys, u)
                i[i == len(keys)] = 0
                ok = keys[i] == u
                out[ok] = counts[i[ok]]
        return out

    def rows(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        full = np.diff(offs) > 0
        text = np.insert(data, offs[:-1][full], 0x20)
        own = np.concatenate([[0], np.cumsum(np.diff(offs) + full)])
        if not len(text):
            return np.zeros(len(offs) - 1, np.int64)
        space, line = text == 0x20, text == 0x0A
        first = space.copy()
        first[1:] &= ~space[:-1]
        first |= line
        first[1:] |= line[:-1]
        first[own[:-1][full]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(text))
        u, at, inv = np.unique(word_hashes(text, starts, ends), return_index=True, return_inverse=True)
        counts = self._find(u)
        new = np.flatnonzero(counts < 0)
        if len(new):
            if sum(len(t[0]) for t in self.tables) + len(new) > REMEMBERED:
                self.reset()
            raw = text.tobytes()
            for k in new.tolist():
                i = at[k]
                counts[k] = self.count(raw[starts[i] : ends[i]].decode("utf-8", "replace").replace(" ", MARK))
            self.tables[1] = _merged(self.tables[1], (u[new], counts[new].astype(np.int32)))
            if len(self.tables[1][0]) > 1 << 16:
                self.tables = [_merged(*self.tables), (np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        total = np.concatenate([[0], np.cumsum(counts[inv])])
        return np.diff(total[np.searchsorted(starts, own)])


def _merged(a: tuple, b: tuple) -> tuple:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]


_open: dict[str, _Counts] = {}


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens under the pieces of the sentencepiece file `model`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        if model not in _open:
            _open.clear()
            _open[model] = _Counts(model)
        counts = _open[model]
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j in pieces(offs):
                n = counts.rows(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(np.diff(offs[i : j + 1])), pa.array(n.astype(np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    return in_batches(rows, run, "doc_id long, n_bytes long, n_tokens long")
