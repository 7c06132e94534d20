"""Token ids of whole texts by a word-level file of the `tokenizers` library, each distinct chunk encoded once.

White space ends every piece of the word-level pre-tokenizer and is dropped; so does the change between
letters (ASCII and the letters of Latin-1) and other ASCII characters, and every ASCII digit is a piece of its
own. Only apostrophes (of contractions) and other bytes over 0x7F keep their neighbours. The ids of a text are
those of its chunks between such places, one after another. Case is dropped too, so these letters are folded
(but not where a mark may follow that composes with them). Chunks are found in the Arrow buffer, looked up by a
64-bit hash and gathered; only new ones reach the tokenizer: chunks of letters alone, which are one piece each and which normalisation leaves
alone, go to its model; others pass the whole tokenizer, joined by a piece that no chunk holds.

A file with another normaliser or pre-tokenizer is refused.
"""

from __future__ import annotations

import codecs
import json
import os

import numpy as np

from ._text import FOLD, word_hashes

#: Kinds of bytes: 0 white space, 1 bytes that keep their neighbours, 2 letters, 3 other characters, 4 digits.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = 0
_KIND[0x80:] = 1
_KIND[ord("'")] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[0x30:0x3A] = 4
#: Second bytes of the letters of Latin-1 after 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: A control character, as a piece between chunks; chunks that hold it are encoded each for itself.
_SEPARATOR = 1
#: Distinct chunks remembered by a worker; beyond that it begins anew.
REMEMBERED = 1 << 19
_DELTA = 1 << 15
#: Bytes of joined chunks that are encoded at once, and joined texts.
_JOINED, _TEXTS = 1 << 11, 64

# The normaliser and the pre-tokenizer that chunks rest on.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_END = "</w>"


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[_LATIN[data[at + 1]]]
    kind[at] = 2
    kind[at + 1] = 2
    return kind


def chunk_bounds(kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every chunk, and the n + 1 chunk offsets of the rows; chunks end with their row."""
    n = len(kind)
    # cut[i]: a chunk ends before byte i, if it did not already
    cut = np.ones(n + 1, bool)
    if n:
        a, b = kind[:-1], kind[1:]
        cut[1:-1] = (a != b) & (a != 1) & (b != 1) | (a == 0) | (b == 0) | (a == 4) & (b == 4)
        cut[offs] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    black = kind[starts] > 0 if n else np.zeros(0, bool)
    starts, ends = starts[black], ends[black]
    return starts, ends, np.searchsorted(starts, offs)


def folded(data: np.ndarray, kind: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Letters of kind 2 in lower case, but for one before a byte of kind 1 of its row."""
    out = FOLD[data]
    if len(data):
        latin = np.flatnonzero((data >= 0x80) & (data <= 0x9E) & (kind == 2))
        out[latin] += 0x20
        mark = (kind == 1) & (data > 0x7F)
        mark[offs[:-1][offs[:-1] < len(data)]] = False
        marked = np.flatnonzero(mark[1:])
        out[marked] = data[marked]
    return out


def _byte_level() -> str:
    """The pre-tokenizer's characters for bytes: printable ones (and the space) stand for themselves, the others follow U+0100 in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    found = [chr(b if b in own else next(other)) for b in range(256)]
    found[0x20] = " "
    return "".join(found)


class Chunks:
    """ids of chunks by hash: a large and a small sorted table over one flat array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        _refuse_others(path, self.tokenizer)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.path = path
        (self.separator,) = self._ids(self.tokenizer, [chr(_SEPARATOR)])[0]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(_WORD_END)]] = True
        self.characters = _byte_level()
        self.reset()

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def reset(self) -> None:
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.tables = [empty, empty]
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, count = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        for keys, at, n in self.tables:
            if len(keys):
                i = np.searchsorted(keys, u)
                i[i == len(keys)] = 0
                ok = keys[i] == u
                start[ok], count[ok] = at[i[ok]], n[i[ok]]
        return start, count

    def _joined(self, tokenizer, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: bytes, text_of) -> np.ndarray:
        """ids of the chunks, each followed by gap."""
        size = ends - starts + len(gap)
        at = np.cumsum(size) - size
        text = np.empty(int(size.sum()), np.uint8)
        own = np.repeat(starts - at, size - len(gap))
        to = np.arange(len(own)) + len(gap) * np.repeat(np.arange(len(size)), size - len(gap))
        text[to] = data[to + own]
        for k, b in enumerate(gap):
            text[at + size - len(gap) + k] = b
        cut = np.unique(np.append(np.searchsorted(at, np.arange(0, len(text), _JOINED)), len(at)))
        edge = np.append(at, len(text))[cut].tolist()
        raw = text.tobytes()
        texts = [text_of(raw[i:j]) for i, j in zip(edge[:-1], edge[1:])]
        out = [np.array(ids, np.int32) for k in range(0, len(texts), _TEXTS) for ids in self._ids(tokenizer, texts[k : k + _TEXTS])]
        return np.concatenate(out)

    def _add(self, keys: np.ndarray, data: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        letters, odd = ~_holds(kind != 2, starts, ends), _holds(data == _SEPARATOR, starts, ends)
        if letters.any():
            ids = self._joined(self.model, data, starts[letters], ends[letters], b" ", lambda b: codecs.charmap_decode(b, "strict", self.characters)[0])
            self._store(keys[letters], ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        if odd.any():
            raw = data.tobytes()
            ids = self._ids(self.tokenizer, [raw[i:j].decode("utf-8", "replace") for i, j in zip(starts[odd].tolist(), ends[odd].tolist())])
            self._store(keys[odd], np.array([x for own in ids for x in own], np.int32), np.array([len(x) for x in ids]))
        rest = ~(letters | odd)
        if rest.any():
            ids = self._joined(self.tokenizer, data, starts[rest], ends[rest], bytes([0x20, _SEPARATOR, 0x20]), lambda b: b.decode("utf-8", "replace"))
            last = ids == self.separator
            self._store(keys[rest], ids[~last], np.diff(np.flatnonzero(last), prepend=-1) - 1)

    def _store(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        if len(keys) != len(count) or count.sum() != len(ids):
            raise ValueError("the tokenizer does not end pieces where chunks end")
        total = len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        at = self.used + np.cumsum(count, dtype=np.int64) - count
        self.used += total
        self.tables[1] = _merged(self.tables[1], (keys, at, count.astype(np.int32)))
        if len(self.tables[1][0]) > _DELTA:
            self.tables = [_merged(self.tables[0], self.tables[1]), (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and the n + 1 id offsets of the rows."""
        kind = _kinds(data)
        s, e, woffs = chunk_bounds(kind, offs)
        data = folded(data, kind, offs)
        u, first, inv = np.unique(word_hashes(data, s, e), return_index=True, return_inverse=True)
        start, count = self._find(u)
        new = np.flatnonzero(start < 0)
        if len(new):
            if sum(len(t[0]) for t in self.tables) + len(new) > REMEMBERED:
                self.reset()
                new = np.arange(len(u))
            self._add(u[new], data, kind, s[first[new]], e[first[new]])
            start, count = self._find(u)
        each = count[inv]
        at = np.concatenate([[0], np.cumsum(each)])
        src = np.repeat(start[inv] - at[:-1], each) + np.arange(at[-1])
        return self.flat[src], at[woffs]


def _holds(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether mask is set anywhere from start to end."""
    at = np.flatnonzero(mask)
    return np.searchsorted(at, ends) > np.searchsorted(at, starts)


def _refuse_others(path: str, tokenizer) -> None:
    spec = json.loads(tokenizer.to_str())
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    known = (
        (spec["normalizer"] or {}).get("normalizers") == _NORMALIZER and len(steps) == 2
        and steps[0].get("pattern") == {"Regex": _PATTERN} and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
        and spec["model"].get("end_of_word_suffix") == _WORD_END
    )
    if not known:
        raise ValueError(f"{path}: not a word-level tokenizer of the kind that chunks rest on")


def _merged(a: tuple, b: tuple) -> tuple:
    """b, in any order, put into the sorted a."""
    order = np.argsort(b[0], kind="stable")
    at = np.searchsorted(a[0], b[0][order])
    return tuple(np.insert(x, at, y[order]) for x, y in zip(a, b))


_open: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    """One table in each Python worker."""
    if path not in _open:
        _open.clear()
        _open[path] = Chunks(path)
    return _open[path]
