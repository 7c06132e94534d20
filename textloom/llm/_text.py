"""Whole-column text kernels: Arrow buffers seen as numpy arrays, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
SLICE = 1 << 18

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, down: bool = False) -> np.ndarray:
    """R**i (or R**-i) modulo 2**64 for i < n."""
    key = "down" if down else "up"
    if len(_powers[key]) < n:
        size = 1 << (max(n, 2) - 1).bit_length()
        base = np.full(size, _RINV if down else _R, np.uint64)
        base[0] = 1
        _powers[key] = np.cumprod(base, dtype=np.uint64)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place on a fresh array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.large_binary() if pa.types.is_large_binary(col.type) else pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(at, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most `limit` bytes together (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_table(keep) -> np.ndarray:
    """256 booleans: keep(byte)."""
    return np.array([bool(keep(b)) for b in range(256)])


#: A-Z to a-z, other bytes as they are.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Word bytes of [^\x20\x09-\x0D]+.
NON_SPACE = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after folding (UTF-8 bytes over 0x7F belong to words).
LETTERS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)


def words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the rows; words end with their row."""
    w = is_word[data]
    n = len(w)
    first, last = w.copy(), w.copy()
    if n:
        inner = ~w
        first[1:] &= inner[:-1]
        last[:-1] &= inner[1:]
        at = offs[:-1][offs[:-1] < n]
        first[at] = w[at]
        at = offs[1:][offs[1:] > 0] - 1
        last[at] = w[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, the same wherever it stands."""
    n = len(b)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(n + 1, True)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LANES = np.array([0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that begin at each of the first len(h) - n + 1 words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = out * _LANES[7] + (h[k : k + m] ^ (h[k : k + m] >> np.uint64(29))) * _LANES[k % 7]
    return mix(out)
