"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of `window` consecutive words of a benchmark item (a shorter item is one
pattern of its own length). For each pattern length m, tables of the two-word blocks give how far a
scan may skip from a block that ends at a position: blocks that no pattern holds skip m - 1 words.
Where the shift is 0 the block's bucket holds the patterns that end so; the window's hash selects
the test strings and their bytes are compared.

Defined cases: a null or empty text has no words and no hits; items without words (null, empty,
punctuation) have no window; equal windows of several items count for each item; repeated rows are
judged each for itself; an empty benchmark contaminates nothing; columns of `docs` pass through a
filter unchanged, whatever their names. Item ids that are null are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import keep
from ._text import FOLD, LETTERS, gram_hashes, pieces, text_buffers, word_hashes, words
from ._worker import in_batches

WINDOW = 8
#: Bytes of benchmark text whose tables one broadcast may hold; a larger benchmark is searched in blocks.
BLOCK_BYTES = 16 << 20
#: Words whose window ends one lane of the scan covers.
_LANE = 256

DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_PARTS = "doc_id long, part long, n_words long, runs array<long>, items array<long>"


class Patterns:
    """Shift tables, suffix buckets and test strings of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        found: dict[tuple[int, bytes], set[int]] = {}
        for item, text in items:
            if item is None or not text:
                continue
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            s, e, _ = words(data, np.array([0, len(data)]), LETTERS)
            b = FOLD[data].tobytes()
            each = [b[i:j] for i, j in zip(s, e)]
            m = min(window, len(each))
            for i in range(len(each) - m + 1 if m else 0):
                found.setdefault((m, b" ".join(each[i : i + m])), set()).add(item)
        self.by_length: dict[int, tuple] = {}
        self.tests: list[bytes] = []
        self.items: list[list[int]] = []
        for m in sorted({m for m, _ in found}):
            first = len(self.tests)
            for (k, text), items_of in sorted(found.items()):
                if k == m:
                    self.tests.append(text)
                    self.items.append(sorted(items_of))
            blob = b" ".join(self.tests[first:])
            data = np.frombuffer(blob, np.uint8)
            s, e, _ = words(data, np.array([0, len(data)]), LETTERS)
            h = word_hashes(data, s, e)
            n = len(self.tests) - first
            block = min(2, m)
            keys, shifts = [], []
            rows = h.reshape(n, m)
            for end in range(block - 1, m):
                keys.append(gram_hashes(np.ascontiguousarray(rows[:, end - block + 1 : end + 1]).ravel(), block)[::block])
                shifts.append(np.full(n, m - 1 - end, np.int64))
            keys, shifts = np.concatenate(keys), np.concatenate(shifts)
            order = np.lexsort((shifts, keys))
            keys, at = np.unique(keys[order], return_index=True)
            whole = gram_hashes(h, m)[::m]
            by = np.argsort(whole, kind="stable")
            self.by_length[m] = (block, keys, shifts[order][at], whole[by], by + first)


def _lookup(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return at, keys[at] == x


def _scan(p: Patterns, h: np.ndarray, woffs: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends (word indexes) and tests whose window hash is equal there."""
    block, keys, shifts, whole, test = p.by_length[m]
    n = len(h)
    if n < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blocks = gram_hashes(h, block)
    pos = np.arange(m - 1, n, _LANE)
    stop = np.minimum(pos + _LANE, n)
    ends = []
    while len(pos):
        at, known = _lookup(keys, blocks[pos - block + 1])
        shift = np.where(known, shifts[at], m - block + 1)
        ends.append(pos[shift == 0])
        pos = pos + np.maximum(shift, 1)
        on = pos < stop
        if not on.all():
            pos, stop = pos[on], stop[on]
    ends = np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
    row = np.searchsorted(woffs, ends, "right") - 1
    ends = ends[ends - m + 1 >= woffs[row]]
    if not len(ends):
        return ends, ends
    value = gram_hashes(h, m)[ends - m + 1]
    left, right = np.searchsorted(whole, value, "left"), np.searchsorted(whole, value, "right")
    many = right - left
    each = np.repeat(ends, many)
    at = np.repeat(left, many) + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    return each, test[at] if len(each) else at


def search(p: Patterns, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Words of each row, a hit mark for every word with the word offsets, and (row, first byte, item) of the hits."""
    s, e, woffs = words(data, offs, LETTERS)
    folded = FOLD[data]
    h = word_hashes(folded, s, e)
    hit = np.zeros(len(h) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(len(offs) - 1)]
    compact = None
    for m in p.by_length:
        ends, tests = _scan(p, h, woffs, m)
        if not len(ends):
            continue
        if compact is None:
            lens = e - s
            at = np.concatenate([[0], np.cumsum(lens + 1)])
            src = np.repeat(s - at[:-1], lens + 1) + np.arange(at[-1])
            compact = np.append(folded, np.uint8(0))[src]
            compact[at[1:] - 1] = 32
            compact = compact.tobytes()
        rows = np.searchsorted(woffs, ends, "right") - 1
        for end, test, row in zip(ends.tolist(), tests.tolist(), rows.tolist()):
            if compact[at[end - m + 1] : at[end + 1] - 1] == p.tests[test]:
                hit[end - m + 1] += 1
                hit[end + 1] -= 1
                items[row].update(p.items[test])
    return woffs, np.cumsum(hit[:-1]) > 0, items


def _digests(ids: list, n_words, n_hit, items: list[list[int]], min_items: int) -> pa.RecordBatch:
    shas = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
    n = [len(x) for x in items]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array([k >= min_items for k in n], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


_tables: list[tuple[list, Patterns]] = []


def _patterns(shared, window: int) -> Patterns:
    """Built once in each Python worker."""
    if not _tables or _tables[0][0] is not shared.value:
        _tables[:] = [(shared.value, Patterns(shared.value, window))]
    return _tables[0][1]


def _searched(batch: pa.RecordBatch, p: Patterns) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[set[int]]]]:
    data, offs = text_buffers(batch.column("text"))
    for i, j in pieces(offs):
        woffs, hit, items = search(p, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield i, j, woffs, hit, items


def _blocks(benchmark: DataFrame) -> list:
    """The items in broadcasts of a bounded size each."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and length(text) > 0")
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        out.append(spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()]))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = 2) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= min_items)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark)
    if len(blocks) == 1:
        shared = blocks[0]

        def run(batches):
            p = _patterns(shared, window)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for i, j, woffs, hit, items in _searched(batch, p):
                    total = np.concatenate([[0], np.cumsum(hit)])
                    yield _digests(ids[i:j], np.diff(woffs), np.diff(total[woffs]), items, min_items)

        return in_batches(rows, run, DIGEST)
    return _in_blocks(rows, blocks, window, min_items)


def _found(rows: DataFrame, blocks: list, window: int) -> DataFrame:
    """Hits of rows (doc_id, text, part) in each block; all items of an id are in one block."""
    out = None
    for shared in blocks:

        def run(batches, shared=shared):
            p = _patterns(shared, window)
            for batch in batches:
                ids, parts = batch.column("doc_id"), batch.column("part")
                for i, j, woffs, hit, items in _searched(batch, p):
                    runs = []
                    for r in range(j - i):
                        own = hit[woffs[r] : woffs[r + 1]].astype(np.int8)
                        edge = np.diff(np.concatenate([[0], own, [0]]))
                        runs.append(np.flatnonzero(edge).tolist())
                    yield pa.RecordBatch.from_arrays([ids[i:j], parts[i:j], pa.array(np.diff(woffs), pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))], ["doc_id", "part", "n_words", "runs", "items"])

        found = in_batches(rows, run, _PARTS)
        out = found if out is None else out.unionByName(found)
    return out


def _in_blocks(rows: DataFrame, blocks: list, window: int, min_items: int) -> DataFrame:
    """As contamination(), with a scan for each block; hits of a row meet by its id and place."""
    out = _found(rows.withColumn("part", F.monotonically_increasing_id()), blocks, window)
    met = out.groupBy("doc_id", "part", "n_words").agg(F.collect_list("runs").alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def merge(batches):
        for batch in batches:
            n_hit = []
            for n, runs in zip(batch.column("n_words").to_pylist(), batch.column("runs").to_pylist()):
                edge = np.zeros(n + 1, np.int64)
                for r in runs:
                    np.add.at(edge, r[::2], 1)
                    np.add.at(edge, r[1::2], -1)
                n_hit.append(int((np.cumsum(edge[:-1]) > 0).sum()))
            yield _digests(batch.column("doc_id").to_pylist(), batch.column("n_words").to_numpy(), n_hit, batch.column("items").to_pylist(), min_items)

    return in_batches(met, merge, DIGEST)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_items: int = 2) -> DataFrame:
    """The rows of docs that hold windows of fewer than min_items items, with all their columns."""
    blocks = _blocks(benchmark)
    if len(blocks) > 1:  # the items of one document may fall in several blocks
        # rows are told apart by their place, not by doc_id, which may be null or repeated; kept, as both sides must see the same place
        placed = keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("part")), "placed")
        found = _found(placed.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"), "part"), blocks, window)
        drop = found.groupBy("part").agg(F.sum(F.size("items")).alias("n")).where(F.col("n") >= min_items).select("part")
        return placed.join(drop, "part", "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))
    shared = blocks[0]

    def run(batches):
        p = _patterns(shared, window)
        for batch in batches:
            mask = [len(x) < min_items for _, _, _, _, items in _searched(batch, p) for x in items]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return in_batches(docs, run, docs.schema)
