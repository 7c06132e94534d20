"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles. Its sketch is the k smallest
of them; a document with fewer keeps its whole set.

1. Documents with the same set (size and 128-bit digest) form one class; only its representative
   goes on, so copies are never expanded.
2. Inverted lists of retained values: values of one representative alone are dropped, the others are
   ordered by how many representatives retain them. Two sets of similarity t share about t * k of the
   k smallest values of their union, so among the k - o + 1 rarest values of both sketches there is a
   common one, where o is the overlap that a pair over the threshold keeps but for a chance below
   1e-9 (union-sketch estimation; exact where one sketch is the whole set, less what a larger
   partner's sketch leaves out).
3. Values link documents into families of possible partners (components of the lists). Only texts of
   families are shuffled (a filter of a fixed size holds back most of the others).
4. In a family all exact intersections are counted at once on full sets, as products of blocks of the
   document-by-shingle matrix; a large family is dealt in pairs of blocks. A block pair returns a
   spanning forest of its confirmed links, so no list of pairs grows with the square of a family, and
   links of every pair in the family are looked at.

Defined cases: without words or text the set is empty and linked with nothing (each such row is its
own component); fewer words than a shingle form one shingle; repeated rows are equal sets and share a
component; an empty table gives no rows; rows with a null doc_id keep null results apart from
n_shingles; other columns are ignored here and pass through `deduplicated` unchanged.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._store import keep
from ._text import FOLD, NON_SPACE, gram_hashes, pieces, text_buffers, word_hashes, words
from ._worker import in_batches
from .components import components

SHINGLE = 5
PERCENT = 80
SKETCH = 64
#: Documents of a family that one side of a block holds, and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 4 << 20
_MISS = 1e-9


def least_overlap(k: int, percent: int) -> int:
    """The most o with P(Binomial(k, percent / 100) < o) <= 1e-9: overlap that a linked pair keeps."""
    p, total, o = percent / 100, 0.0, 0
    while o < k:
        total += math.comb(k, o) * p**o * (1 - p) ** (k - o)
        if total > _MISS:
            break
        o += 1
    return max(1, o)


def least_shared(size: int, k: int, percent: int) -> int:
    """The least values that the sketch of a set of `size` shingles (k of them at most) shares with that of a linked partner."""
    if size >= k:
        return least_overlap(k, percent)
    # a partner of at most k shingles is whole; a larger one leaves out n - k values, all of them common ones at worst
    larger = range(k + 1, 100 * size // percent + 1)
    return max(1, min([-(-size * percent // 100), *(-(-percent * (size + n) // (100 + percent)) - (n - k) for n in larger)]))


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int):
    """The sorted distinct shingle hashes of each row."""
    s, e, woffs = words(data, offs, NON_SPACE)
    h = word_hashes(FOLD[data], s, e)
    g = gram_hashes(h, n)
    for a, b in zip(woffs[:-1].tolist(), woffs[1:].tolist()):
        if b - a >= n:
            own = g[a : b - n + 1].copy()
            own.sort()
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        elif b > a:
            yield gram_hashes(h[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketched(docs: DataFrame, *, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, digest of the whole set, sketch."""

    def run(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column("text"))
            for i, j in pieces(offs):
                n, digests, heads = [], [], []
                for own in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle):
                    n.append(len(own))
                    digests.append(hashlib.blake2b(own, digest_size=16).digest())
                    heads.append(own[:k])
                at = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
                flat = np.concatenate(heads).view(np.int64) if heads else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "n_shingles", "digest", "sketch"])

    return in_batches(_rows(docs), run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def _families(sketches: DataFrame, percent: int, k: int) -> DataFrame:
    """(doc_id, family) of the representatives that share one of their rarest values with another."""
    values = sketches.select("doc_id", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    known = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(known, "value")
    need = [least_shared(size, k, percent) for size in range(k + 1)]
    overlap = F.element_at(F.array(*[F.lit(x) for x in need]), F.col("k") + 1)
    prefix = F.col("k") - overlap + 1
    own = shared.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
    # values of one document alone come first in the order, and take places
    alone = F.col("k") - F.size("own")
    rare = own.where(F.size("own") >= overlap).select("doc_id", F.explode(F.slice("own", F.lit(1), F.greatest(F.lit(0), prefix - alone))).alias("e")).select("doc_id", "e.value")
    rare = keep(rare, "lists")
    first = rare.groupBy("value").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = rare.join(first, "value").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    return components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))


def _forest(n: int, links: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(links[0].tolist(), links[1].tolist()):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _intersections(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Exact intersection sizes of every set on the left with every one on the right (None: the left again)."""
    sets = left if right is None else [*left, *right]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, inv, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = many > 1
    column = np.cumsum(shared) - 1
    on = shared[inv]
    column, owner = column[inv[on]], owner[on]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n, width = int(shared.sum()), 2048
    m = len(left)
    out = np.zeros((m, m if right is None else len(right)), np.float32)
    cut = np.searchsorted(column, np.arange(0, n + width, width))
    for c, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        if a == b:
            continue
        matrix = np.zeros((len(sets), min(width, n - c * width)), np.float32)
        matrix[owner[a:b], column[a:b] - c * width] = 1
        out += matrix[:m] @ (matrix[:m] if right is None else matrix[m:]).T
    return out


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (indexes into left + right) with 100 * intersection >= percent * union."""
    both = _intersections(left, right).astype(np.int64)
    a = np.array([len(x) for x in left], np.int64)[:, None]
    b = np.array([len(x) for x in (left if right is None else right)], np.int64)[None, :]
    ok = (100 * both >= percent * (a + b - both)) & (both > 0)
    i, j = np.nonzero(np.triu(ok, 1) if right is None else ok)
    return (i, j) if right is None else (i, j + len(left))


def _confirmed(sets: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links of each family. sets: node, digest, family, block_a, block_b, side, text."""
    dealt = sets.repartition("family", "block_a", "block_b").sortWithinPartitions("family", "block_a", "block_b", "side", "node")

    def solve(ids: list[int], sides: list[int], texts: list, digests: list[bytes]) -> list[tuple[int, int]]:
        data, offs = text_buffers(pa.array(texts, pa.string()))
        own = []
        for i, j in pieces(offs):
            own.extend(shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle))
        seen: dict[int, int] = {}  # one row of each node, with its own set
        for at, (node, x, digest) in enumerate(zip(ids, own, digests)):
            if node not in seen and hashlib.blake2b(x, digest_size=16).digest() == digest:
                seen[node] = at
        ids, sides, own = ([x[at] for at in seen.values()] for x in (ids, sides, own))
        if len(ids) < 2:
            return []
        m = sides.index(1) if 1 in sides else len(own)
        alone = m == len(own) or m == 0
        found = links(own, None, percent) if alone else links(own[:m], own[m:], percent)
        return [(ids[a], ids[b]) for a, b in _forest(len(own), found)]

    def run(batches):
        key, ids, sides, texts, digests, out = None, [], [], [], [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("family", "block_a", "block_b", "node", "side", "text", "digest")]
            for f, x, y, node, side, text, digest in zip(*cols):
                if (f, x, y) != key:
                    if len(ids) > 1:
                        out += solve(ids, sides, texts, digests)
                    key, ids, sides, texts, digests = (f, x, y), [], [], [], []
                ids.append(node)
                digests.append(digest)
                sides.append(side)
                texts.append(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])
                out = []
        if len(ids) > 1:
            out += solve(ids, sides, texts, digests)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return in_batches(dealt, run, "a long, b long")


#: Bits of the filter of document ids that is broadcast, whatever the corpus (2 MB).
FILTER_BITS = 1 << 24


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of a superset of the wanted documents, so that the other texts need not be shuffled.

    A filter of FILTER_BITS bits, one hash, with false positives; the join with `wanted` decides.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words_of = wanted.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words_of.toLocalIterator():  # FILTER_BITS / 64 rows at most
        bits[r[0]] = r[1]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = shared.value
        for batch in batches:
            b = batch.column("b").to_numpy()
            yield batch.filter(pa.array((known[b >> 6] >> (b & 63)) & 1 == 1)).select(["doc_id", "text"])

    return in_batches(_rows(docs).where("doc_id is not null").withColumn("b", bit), run, "doc_id long, text string")


def _assigned(docs: DataFrame, percent: int, shingle: int, k: int) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, digest, component_id, and the digest of the component's one head.

    The nodes are classes of equal sets, not doc_ids: rows of one doc_id with different sets are judged each for itself.
    """
    sketches = keep(sketched(docs, shingle=shingle, k=k), "sketches")
    classes = sketches.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("rep"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = sketches.join(classes.withColumnRenamed("rep", "doc_id"), ["n_shingles", "digest", "doc_id"]).select("node", "doc_id", "n_shingles", "digest", "sketch").dropDuplicates(["node"])
    heads = keep(heads, "heads")
    families = _families(heads.select(F.col("node").alias("doc_id"), "sketch"), percent, k).withColumnRenamed("doc_id", "node")
    families = keep(families.join(heads.select("node", "doc_id", "n_shingles", "digest"), "node"), "families")
    sizes = families.groupBy("family").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    # blocks by hash: half the bound on average, as hashes deal unevenly
    blocks = F.when((F.col("m") <= BLOCK_DOCS) & (F.col("w") <= BLOCK_SHINGLES), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("m") * 2 / BLOCK_DOCS), F.ceil(F.col("w") * 2 / BLOCK_SHINGLES)).cast("int"))
    dealt = families.join(sizes.select("family", blocks.alias("n")), "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    # a doc_id may have several texts; _confirmed leaves those of another digest out
    texts = _likely(docs, families).join(dealt.select("doc_id", "node", "digest", "family", "n", "block"), "doc_id")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    sets = texts.select("*", other.alias("other")).select("node", "digest", "text", "family", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    edges = keep(_confirmed(sets, percent, shingle), "links")
    joined = components(edges).join(classes.select("node", "rep", "digest"), "node")
    tops = joined.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("top"))
    joined = joined.join(tops, "component").select("node", F.col("top.rep").alias("component_id"), F.col("top.digest").alias("head"))
    found = classes.join(joined, "node", "left").select("n_shingles", "digest", F.coalesce("component_id", "rep").alias("component"), F.coalesce("head", "digest").alias("head"))
    return (
        sketches.select("doc_id", "n_shingles", "digest")
        .join(found, ["n_shingles", "digest"], "left")
        .select("doc_id", "n_shingles", "digest", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("head", "digest").alias("head"))
    )


def clusters(docs: DataFrame, *, percent: int = PERCENT, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id of its component), kept."""
    rows = _assigned(docs, percent, shingle, k)
    return rows.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _digested(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, _id, _set): rows of docs as structs, the doc_id as a long and the digest of the set."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    schema = StructType([f for f in rows.schema.fields if f.name != "_text"] + [StructField("_set", BinaryType())])

    def run(batches):
        for batch in batches:
            data, offs = text_buffers(batch.column("_text"))
            digests = []
            for i, j in pieces(offs):
                digests += [hashlib.blake2b(own, digest_size=16).digest() for own in shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("_id"), pa.array(digests, pa.binary())], ["row", "_id", "_set"])

    return in_batches(rows, run, schema)


def deduplicated(docs: DataFrame, *, percent: int = PERCENT, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """One row of each component, all columns as they were: that with the smallest doc_id, then digest, then text and other columns.

    Repeated rows (doc_id and set alike, rows without words too) leave one. Rows with a null doc_id stay.
    """
    rows = _assigned(docs, percent, shingle, k).where("doc_id is not null")
    drop = rows.where("doc_id <> component_id or digest <> head").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_set")).distinct()
    known = F.col("doc_id").cast("long").isNotNull()
    # partial aggregates first, so that rows repeated many times meet as one of each task
    plain = not any(x in f.dataType.simpleString() for f in docs.schema.fields for x in ("map<", "variant"))
    order = [F.col("row.text"), *(F.col(f"row.`{c}`") for c in docs.columns if c != "text")] if plain else []
    one = F.min(F.struct(*order)) if plain else F.first("row")
    left = _digested(docs.where(known), shingle).groupBy("_id", "_set").agg(one.alias("row")).join(drop, ["_id", "_set"], "left_anti")
    return left.select(*(F.col(f"row.`{c}`") for c in docs.columns)).unionByName(docs.where(~known))
