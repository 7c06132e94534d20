"""Removal of repeated byte strings, by bucket-pointer refinement over distributed candidates.

Every byte covered by a string of `length` bytes that also starts earlier (smaller doc_id, or earlier in
the same document) is removed; strings are judged on the input.

1. Documents with equal texts form groups; all but the first are repeats as a whole.
2. Of the q-grams inside a string, the leftmost of least hash is its anchor, so equal strings have equal
   anchors at equal places; neighbouring strings mostly share theirs. Anchors are dealt by their hash; a
   string whose anchor occurs once does not repeat. Repeats seen inside one slice of a task are known at once and do not
   meet in the shuffle, so a passage that a third of all documents share brings one row from each slice.
3. Strings whose anchor repeats are candidates. A task refines its own candidates: initial buckets of
   25-byte grams; a bucket is refined by sorting on the bucket identifiers of its members' later offsets
   (25, then 50), each level reusing the identifiers of the one before and leaving out strings that are
   alone already. Repeats of a string in the same task are settled there.
4. What is first in its task goes on, dealt by its anchor, and is refined once more against the
   others. Matches are compared byte by byte.
5. An anchor with over HOT runs (a passage in many surroundings) is not gathered: its strings are dealt singly
   by a 128-bit digest of their bytes, equal digests count as equal strings, and the first of each is
   found as they stream by in order. Hot anchors are known by a filter of a fixed size; one that is
   taken for hot by mistake is dealt so everywhere, with the same result.

Defined cases: a null or empty text, or one shorter than `length`, loses nothing (its digest is that of
its bytes); repeated rows (same doc_id and text) count as one document and get equal results; rows of one
doc_id with different texts are separate documents in the order of their SHA-256; a row with a null
doc_id is compared with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._store import keep
from ._text import mix, pieces, text_buffers
from ._worker import in_batches

LENGTH = 100
_Q = 36  # bytes of an anchor
_GRAM = 25  # bytes of an initial bucket: LENGTH / 4
#: Bytes of text in which repeats are seen before any shuffle.
_SLICE = 1 << 20
#: Candidate bytes that a task refines together.
_BATCH = 2 << 20

#: Runs of an anchor that a task may gather, and bits of the filter that tells hot anchors (2 MB, whatever the corpus).
HOT, FILTER_BITS = 1 << 13, 1 << 24

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position, as an integer; zeros follow the end."""
    padded = np.zeros(len(data) + 64, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 48,), "<u8", padded, strides=(1,))


def _hash(x: np.ndarray, n: int, at: tuple[int, ...]) -> np.ndarray:
    h = np.zeros(n, np.uint64)
    for k, c in zip(at, _C):
        h += x[k : k + n]
        h *= c
        h ^= h >> np.uint64(31)
    return h


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: row, first and last start in the row, and the anchor's hash, in order."""
    n, w = len(data), length - _Q + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    low = mix(_hash(_words(data), n, (0, 8, 16, 24, 28)))
    at = np.arange(n, dtype=np.int32)
    size = 1
    while size < w:  # the leftmost least hash from each place on, over twice as many places each time
        step = min(size, w - size)
        less = low[step:] < low[: n - step]
        low[: n - step] = np.where(less, low[step:], low[: n - step])
        at[: n - step] = np.where(less, at[step:], at[: n - step])
        size += step
    # strings that end in their own row only
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    start = np.flatnonzero(np.arange(n) + length <= offs[1:][row])
    new = np.ones(len(start), bool)
    new[1:] = (at[start[1:]] != at[start[:-1]]) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    row = row[start[first]]
    return row, start[first] - offs[row], start[last] - offs[row], low[start[first]]


def repeats(buf: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each start in buf: does an equal string of `length` bytes with a smaller order start there too?"""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    x = _words(buf)
    n = len(buf)
    g = length // 4
    grams = _hash(x, n, (0, 8, g - 9, g - 8))
    _, bucket, many = np.unique(grams, return_inverse=True, return_counts=True)
    alone = many[bucket] == 1
    on = np.flatnonzero(~(alone[starts] | alone[starts + g] | alone[starts + 2 * g] | alone[starts + 3 * g]))
    if len(on) < 2:
        return out
    s = starts[on]
    # second level: positions s and s + 2g, by the identifiers at 0 and g
    need = np.zeros(n, bool)
    need[s] = True
    need[s + 2 * g] = True
    at = np.flatnonzero(need)
    key = (bucket[at].astype(np.uint64) << np.uint64(32)) | bucket[at + g].astype(np.uint64)
    _, finer, many = np.unique(key, return_inverse=True, return_counts=True)
    bucket = np.zeros(n, np.int64)
    bucket[at] = finer
    alone = np.zeros(n, bool)
    alone[at] = many[finer] == 1
    left = ~(alone[s] | alone[s + 2 * g])
    on, s = on[left], s[left]
    if len(on) < 2:
        return out
    key = (bucket[s].astype(np.uint64) << np.uint64(32)) | bucket[s + 2 * g].astype(np.uint64)
    by = np.lexsort((order[on], key))
    key = key[by]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    head = s[by][np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    again = ~first
    a, b = s[by][again], head[again]
    same = np.ones(len(a), bool)
    for k in (*range(0, length - 7, 8), length - 8):
        same &= x[a + k] == x[b + k]
    out[on[by[again]]] = same
    return out


def _covered(starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that strings from sorted starts cover, for each group: group, from, to."""
    if not len(starts):
        return group, starts, starts
    cut = np.ones(len(starts), bool)
    cut[1:] = (group[1:] != group[:-1]) | (starts[1:] > starts[:-1] + length)
    i = np.flatnonzero(cut)
    j = np.append(i[1:], len(starts)) - 1
    return group[i], starts[i], starts[j] + length


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[k] .. first[k] + count[k] - 1 for every k, and k."""
    k = np.repeat(np.arange(len(first)), count)
    return np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count) + first[k], k


#: `at` packs a run of starts: the first, how many follow it (7 bits), and what is known of its anchor (2 bits):
#: 0 nothing yet, 1 that it repeats, 2 that it does and need not meet the others.
_ANCHORS = "h long, doc long, tie int, at long"
#: hi is -1 where bytes is the digest of the single string that starts at lo.
_SETTLED = "route long, doc long, tie int, lo int, hi int, bytes binary"
_RANGES = "doc long, tie int, lo int, hi int"


def _emit_anchors(length: int):
    def run(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for i, j in pieces(offs, _SLICE):
                own = offs[i : j + 1] - offs[i]
                row, lo, hi, h = anchors(data[offs[i] : offs[j]], own, length)
                if not len(row):
                    continue
                _, first, inv, many = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known = many[inv] > 1
                state = known.astype(np.int64) + (known & (first[inv] != np.arange(len(h))))
                at = (lo.astype(np.int64) << 9) | ((hi - lo).astype(np.int64) << 2) | state
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[i:j][row]), pa.array(tie[i:j][row].astype(np.int32)), pa.array(at)], ["h", "doc", "tie", "at"])

    return run


def _only_repeated(batches):
    """Rows, sorted by h, that are known to repeat or have the hash of a neighbour."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h, at = batch.column("h").to_numpy(), batch.column("at").to_numpy().copy()
        equal = h[1:] == h[:-1]
        found = at & 3 > 0
        found[1:] |= equal
        found[:-1] |= equal
        n = len(h) - 1
        # the last row waits for its successor
        at[n] |= found[n]
        held = batch.slice(n, 1).set_column(3, batch.schema.field(3), pa.array(at[n:]))
        out = batch.slice(0, n).filter(pa.array(found[:n]))
        if out.num_rows:
            yield out
    if held is not None and held.column("at")[0].as_py() & 3:
        yield held


def _binary(buf: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf))])


def _settle(length: int, hot):
    """Candidates of whole documents -> byte runs settled here, and strings that are first here."""

    def solve(data: np.ndarray, offs: np.ndarray, doc: np.ndarray, tie: np.ndarray, row: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        if not len(row):
            return
        by = np.lexsort((lo, row))
        row, h, lo, hi = row[by], h[by], lo[by], hi[by]
        # runs that touch share their bytes
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (lo[1:] != hi[:-1] + 1)
        k = np.cumsum(new) - 1
        a = np.flatnonzero(new)
        first, ends = lo[a], hi[np.append(a[1:], len(row)) - 1] + length
        idx, _ = _expand(offs[row[a]] + first, ends - first)
        buf = data[idx]
        seg_at = np.concatenate([[0], np.cumsum(ends - first)])[:-1]
        start, which = _expand(lo, hi - lo + 1)
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((tie, doc))] = np.arange(len(doc))
        again = repeats(buf, start - first[k[which]] + seg_at[k[which]], (rank[row[which]] << 32) | start, length)
        g, x, y = _covered(start[again], row[which][again], length)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array(mix(doc[g].astype(np.uint64)).view(np.int64)), pa.array(doc[g]), pa.array(tie[g]), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.nulls(len(g), pa.binary())], ["route", "doc", "tie", "lo", "hi", "bytes"])
        fresh = ~again
        if len(hot.value):
            bit = h.view(np.uint64) % np.uint64(FILTER_BITS)
            single = fresh & ((hot.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1)[which]
            if single.any():
                fresh &= ~single
                r, f = row[which][single], start[single]
                raw = data.tobytes()
                digests = [hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in (offs[r] + f).tolist()]
                route = np.frombuffer(b"".join(digests), np.int64)[::2]
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(doc[r]), pa.array(tie[r]), pa.array(f.astype(np.int32)), pa.array(np.full(len(f), -1, np.int32)), pa.array(digests, pa.binary())], ["route", "doc", "tie", "lo", "hi", "bytes"])
        if fresh.any():
            w, f = which[fresh], start[fresh]
            cut = np.ones(len(w), bool)
            cut[1:] = w[1:] != w[:-1]
            i = np.flatnonzero(cut)
            j = np.append(i[1:], len(w)) - 1
            w, f0, f1 = w[i], f[i], f[j]
            idx, _ = _expand(offs[row[w]] + f0, f1 - f0 + length)
            yield pa.RecordBatch.from_arrays([pa.array(h[w]), pa.array(doc[row[w]]), pa.array(tie[row[w]]), pa.array(f0.astype(np.int32)), pa.array((f1 + 1).astype(np.int32)), _binary(data[idx], f1 - f0 + length)], ["route", "doc", "tie", "lo", "hi", "bytes"])

    def run(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            found = batch.column("found")
            at = np.asarray(found.offsets.to_numpy(), np.int64)
            flat = found.values
            packed = flat.field("at").to_numpy()
            lo = packed >> 9
            cols = (flat.field("h").to_numpy(), lo, lo + ((packed >> 2) & 127))
            for i, j in pieces(offs, _BATCH):
                a, b = at[i], at[j]
                rows = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                yield from solve(data, offs[i : j + 1], doc[i:j], tie[i:j], rows, *(c[a:b] for c in cols))

    return run


def _refine(length: int):
    """Rows sorted by route and place: runs pass, strings are refined against those of their anchor, single ones by their digest."""
    names = ["doc", "tie", "lo", "hi"]

    def later(batch: pa.RecordBatch, seen: dict[int, set[bytes]]) -> pa.RecordBatch:
        """Single strings whose digest came before. seen: the digests of the last route."""
        mask = []
        for route, digest in zip(batch.column("route").to_pylist(), batch.column("bytes").to_pylist()):
            if route not in seen:
                seen.clear()
                seen[route] = set()
            mask.append(digest in seen[route])
            seen[route].add(digest)
        found = batch.filter(pa.array(mask, pa.bool_()))
        lo = found.column("lo").to_numpy()
        return pa.RecordBatch.from_arrays([found.column("doc"), found.column("tie"), pa.array(lo), pa.array((lo + length).astype(np.int32))], names)

    def solve(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held).combine_chunks()
        buf, at = text_buffers(t.column("bytes"))
        doc, tie, lo, hi = (t.column(c).to_numpy() for c in names)
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        start, which = _expand(lo, hi - lo)
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((lo, tie, doc))] = np.arange(len(doc))
        again = repeats(buf, at[which] + start - lo[which], (rank[which] << 32) | start, length)
        g, x, y = _covered(start[again], which[again], length)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array(doc[g]), pa.array(tie[g]), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], names)

    def run(batches):
        held, size, last, seen = [], 0, None, {}
        for batch in batches:
            single = batch.filter(pa.array(batch.column("hi").to_numpy() < 0))
            if single.num_rows:
                yield later(single, seen)
                batch = batch.filter(pa.array(batch.column("hi").to_numpy() >= 0))
            settled = batch.filter(batch.column("bytes").is_null())
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([settled.column(c) for c in names], names)
            batch = batch.filter(batch.column("bytes").is_valid())
            while batch.num_rows:
                route = batch.column("route").to_numpy()
                # cut where the route changes, once enough is held
                change = np.flatnonzero(route[1:] != route[:-1]) + 1
                if held and route[0] != last and size >= _BATCH:
                    yield from solve(held)
                    held, size = [], 0
                each = text_buffers(batch.column("bytes"))[1][1:]
                fits = change[each[change - 1] + size >= _BATCH] if len(change) else change
                n = int(fits[0]) if len(fits) else len(route)
                held.append(batch.slice(0, n))
                size += int(each[n - 1])
                last = route[n - 1]
                batch = batch.slice(n)
        if held:
            yield from solve(held)

    return run


def _final(length: int):
    def run(batches):
        for batch in batches:
            out = ([], [], [], [])
            texts, shas, ties, found = (batch.column(c).to_pylist() for c in ("text", "sha", "tie", "ranges"))
            for text, sha, tie, runs in zip(texts, shas, ties, found):
                n = len(text)
                own = sorted((r["lo"], r["hi"]) for r in runs or () if r["tie"] == tie)
                if tie is None:  # equal to an earlier document
                    whole = n >= length
                    removed, spans_n, kept = (n, 1, hashlib.sha256(b"").hexdigest()) if whole else (0, 0, sha)
                elif not own:
                    removed, spans_n, kept = 0, 0, sha
                else:
                    left, at, removed, spans_n, until = hashlib.sha256(), 0, 0, 0, -1
                    for r in own:
                        if r[0] > until:
                            left.update(text[at : r[0]])
                            spans_n += 1
                            removed += r[1] - r[0]
                            at = until = r[1]
                        elif r[1] > until:
                            removed += r[1] - until
                            at = until = r[1]
                    left.update(text[at:])
                    kept = left.hexdigest()
                for column, value in zip(out, (n, removed, spans_n, kept)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _hot(repeated: DataFrame):
    """Broadcast of the filter of anchors with over HOT runs; empty without any."""
    bit = F.pmod(F.col("h"), F.lit(FILTER_BITS))  # a power of two: as the unsigned remainder
    hot = repeated.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(bit.alias("b"))
    words = hot.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    some = False
    for r in words.toLocalIterator():  # FILTER_BITS / 64 rows at most
        bits[r[0]] = np.int64(r[1]).astype(np.uint64)
        some = True
    return repeated.sparkSession.sparkContext.broadcast(bits if some else bits[:0])


def removal(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if length % 4 or length < 2 * _Q:
        raise ValueError(f"length must be a multiple of 4 from {2 * _Q}")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    all_rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    rows = all_rows.where("doc is not null")
    each = rows.select("doc", F.sha2("text", 256).alias("sha")).groupBy("sha", "doc").agg(F.count("*").alias("n"))
    distinct = each.groupBy("sha").agg(F.min(F.struct("doc", "n")).alias("head")).select("sha", "head.doc", "head.n")
    heads = keep(distinct.withColumn("tie", (F.row_number().over(Window.partitionBy("doc").orderBy("sha")) - 1).cast("int")), "heads")
    once = rows
    if (heads.agg(F.max("n")).first()[0] or 0) > 1:  # rows are repeated: each document takes part once
        once = rows.dropDuplicates(["doc", "text"])
    # one row for each doc_id, so that everything meets by doc alone: the texts are shuffled once, and the joins read that exchange
    of_doc = heads.groupBy("doc").agg(F.collect_list(F.struct("sha", "tie")).alias("heads"))
    mine = F.filter("heads", lambda x: x["sha"] == F.sha2("text", 256))
    tie = F.get(mine, F.lit(0))["tie"]
    known = once.join(of_doc, "doc").select("doc", tie.alias("tie"), "text").where("tie is not null")
    emitted = in_batches(known, _emit_anchors(length), _ANCHORS)
    deal = F.when(F.col("at") % 4 == 2, F.xxhash64("doc", "at")).otherwise(F.col("h"))
    repeated = in_batches(emitted.repartition(deal).sortWithinPartitions("h"), _only_repeated, _ANCHORS)
    repeated = keep(repeated, "anchors")
    per_doc = repeated.groupBy("doc").agg(F.collect_list(F.struct("tie", "h", "at")).alias("found"))
    met = once.join(per_doc, "doc").join(of_doc, "doc").select("doc", tie.alias("tie"), "text", "found", F.size("heads").alias("n")).where("tie is not null")
    met = met.withColumn("found", F.when(F.col("n") == 1, F.col("found")).otherwise(F.filter("found", lambda x: x["tie"] == F.col("tie")))).where(F.size("found") > 0)
    settled = in_batches(met.select("doc", "tie", "text", "found"), _settle(length, _hot(repeated)), _SETTLED)
    ranges = in_batches(settled.repartition("route").sortWithinPartitions("route", "doc", "tie", "lo"), _refine(length), _RANGES)
    found = ranges.groupBy("doc").agg(F.collect_list(F.struct("tie", "lo", "hi")).alias("ranges"))
    last = rows.join(of_doc.join(found, "doc", "left"), "doc", "left").select("doc", "text", F.sha2("text", 256).alias("sha"), tie.alias("tie"), "ranges")
    out = in_batches(last, _final(length), RESULT)
    alone = all_rows.where("doc is null").select(F.col("doc").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return out.unionByName(alone)
