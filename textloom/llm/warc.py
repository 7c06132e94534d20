"""WARC archives: written and read by Spark's own text reader and writer, verified by boundary chains.

A record is the value of one row and the blank line that ends it the line separator, so archives are
written and committed like any table, in any store that Spark reaches, and read in splits.

Reading, the magic `WARC/1.1` after a blank line only marks a candidate: payloads may hold it. Each
task emits, for the candidates of its split, the offset of the successor that the declared lengths claim,
and where a chain from each candidate leaves the split (pointer jumping over the task's own offsets).
Those few exits are chased from the start of each file; inside a split, candidates that the chain does
not reach are rejected. Rows of the chase grow with splits, not with records.

Payloads are hashed as they stream by, each byte once at most: a task follows the chain from its first
candidate, and begins anew at the next one where a chain breaks. `verified` tells whether that hash is the one that
the record's header claims; it is null where the payload does not end in the split of its header, where the
split's chain began inside a payload, and for revisits. Then payload_digest is the header's.

Payloads that equal that of another page are not written again: among pages with equal payload digests
(of payloads of at least `least_bytes` bytes) that with the largest page_id is the response, the others
are revisit records that refer to it.

Defined cases: a null html is an empty payload; a null url is left out; rows with a null page_id are
responses unless a numbered page has the same payload; repeated rows of the largest page_id are all
responses; line ends in a url are percent-encoded; an empty table gives an archive without records; a
chain that breaks off (truncated file) keeps the records before the break; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._store import keep, new_path
from ._worker import in_batches

_MAGIC = "WARC/1.1"
_BLANK = "\r\n\r\n"
#: Revisits up to which their table is broadcast, under 100 bytes a row; beyond, pages and revisits meet by a shuffle.
BROADCAST_ROWS = 500_000
_B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, 40 bits at a time."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), *_B32)


def write_archive(pages: DataFrame, path: str, *, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC record for each row of pages (page_id, url, html), in files below path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html"))})
    ids = keep(rows.select("page_id", "bytes", "digest"), "digests")
    heads = ids.where(F.col("bytes") >= least_bytes).groupBy("bytes", "digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null")
    revisits = ids.join(heads.drop("n"), ["bytes", "digest"]).where("page_id is null or page_id < head").select("page_id", "bytes", "digest", "head").distinct()
    revisits = keep(revisits, "revisits")
    small = revisits.count() <= BROADCAST_ROWS
    other = (F.broadcast(revisits) if small else revisits).select(F.col("page_id").alias("_id"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"), "head")
    met = rows.join(other, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("bytes") == F.col("_bytes")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("head").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    record = F.concat_ws(
        "\r\n",
        F.lit(_MAGIC),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.when(again, line("WARC-Refers-To", urn(F.col("head")))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(""),
        F.when(again, F.lit("")).otherwise(F.col("html")),
    )
    met.select(record.alias("value")).write.option("lineSep", _BLANK).text(path)


_CANDIDATES = "file string, block long, seq long, off long, succ long, leaves long, size long, type string, page_id long, refers_to long, payload_bytes long, digest string, verified boolean"


def _field(head: bytes, name: bytes) -> bytes | None:
    at = head.find(b"\r\n" + name + b": ")
    if at < 0:
        return None
    at += len(name) + 4
    end = head.find(b"\r\n", at)
    return head[at : end if end >= 0 else len(head)]


def _page(value: bytes | None) -> int | None:
    digits = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits.lstrip(b"-").isdigit() else None


_SEPARATOR = (_BLANK + _MAGIC).encode()


class _Split:
    """Candidates of one split, in order, and the record that is being hashed."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.at, self.rows = file, block, 0, []
        self.until, self.open, self.skip, self.left, self.sha = 0, 0, 0, 0, None

    def feed(self, chunk: bytes) -> None:
        """The next bytes of the record that is being hashed, behind its magic line."""
        part = memoryview(chunk)[min(self.skip, len(chunk)) :]
        self.skip -= len(chunk) - len(part)
        part = part[: self.left]
        self.sha.update(part)
        self.left -= len(part)
        if not self.left:
            own = base64.b32encode(self.sha.digest()).decode()
            row = self.rows[self.open]
            row[7], row[8], self.sha = own, own == row[7], None

    def add(self, parts: list[bytes]) -> None:
        """parts: the text between magic lines, in order."""
        for part in parts:
            size = len(_MAGIC) + len(part) + len(_BLANK)
            # the blank line after the header may lie in the separator, where the payload begins like one
            cut = (part + _BLANK.encode()).find(_BLANK.encode())
            head = part[:cut]
            length = _field(head, b"Content-Length") if head.startswith(b"\r\n") else None
            if length is None or not length.isdigit():
                self.rows.append([self.at, -1, size, None, None, None, None, None, None])
            else:
                n = int(length)
                kind = (_field(head, b"WARC-Type") or b"").decode("utf-8", "replace")
                claimed = (_field(head, b"WARC-Payload-Digest") or b"").decode("ascii", "replace").removeprefix("sha1:")
                full = _field(head, b"X-Payload-Length")
                end = self.at + len(_MAGIC) + len(head) + 4 + n + len(_BLANK)
                self.rows.append([self.at, end, size, kind, _page(_field(head, b"WARC-Record-ID")), _page(_field(head, b"WARC-Refers-To")), int(full) if kind == "revisit" and full and full.isdigit() else n, claimed, None])
            if self.at < self.until:  # inside a payload
                if self.sha:
                    self.feed(_SEPARATOR + part)
            elif self.rows[-1][1] >= 0:
                self.until, self.sha = self.rows[-1][1], None
                if self.rows[-1][3] == "response":
                    self.open, self.skip, self.left, self.sha = len(self.rows) - 1, cut + 4, n, hashlib.sha1()
                    self.feed(part)
            self.at += size

    def batch(self) -> pa.RecordBatch:
        n = len(self.rows)
        cols = list(zip(*self.rows))
        off, succ = np.array(cols[0], np.int64), np.array(cols[1], np.int64)
        at = np.searchsorted(off, succ)
        inside = (at < n) & (off[np.minimum(at, n - 1)] == succ)
        out = succ >= self.at - len(_BLANK)
        jump = np.where(inside, at, np.arange(n))
        for _ in range(max(1, n.bit_length())):
            jump = jump[jump]
        leaves = np.where(out[jump], succ[jump], -1)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * n, pa.string()), pa.array([self.block] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(off), pa.array(succ), pa.array(leaves, pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), *(pa.array(cols[k], pa.int64()) for k in (4, 5, 6)), pa.array(cols[7], pa.string()), pa.array(cols[8], pa.bool_())],
            ["file", "block", "seq", "off", "succ", "leaves", "size", "type", "page_id", "refers_to", "payload_bytes", "digest", "verified"],
        )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic line of the archives with the successor it claims; offsets count from the first candidate of the split."""
    text = spark.read.option("lineSep", _BLANK + _MAGIC).text(path)
    rows = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches):
        split = None
        for batch in batches:
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            values = batch.column("value").cast(pa.binary()).to_pylist()
            i = 0
            while i < len(values):
                j = i
                while j < len(values) and blocks[j] == blocks[i] and files[j] == files[i]:
                    j += 1
                if split is None or (split.file, split.block) != (files[i], blocks[i]):
                    if split and split.rows:
                        yield split.batch()
                    split = _Split(files[i], blocks[i])
                parts = values[i:j]
                if split.block == 0 and not split.rows:
                    if not parts[0].startswith(_MAGIC.encode()):
                        raise ValueError(f"{split.file} is no WARC archive")
                    parts[0] = parts[0][len(_MAGIC) :]
                split.add(parts)
                i = j
        if split and split.rows:
            yield split.batch()

    return in_batches(rows, run, _CANDIDATES)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records reachable from the start of their file: page_id, payload_bytes, payload_digest, record_type, refers_to, verified."""
    found = keep(candidates(spark, path), "candidates")
    # where each split begins in its file: the sizes of the splits before
    splits = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    base = splits.select("file", "block", (F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("base"))
    placed = found.join(base, ["file", "block"])
    exits = placed.where("leaves >= 0").select("file", (F.col("base") + F.col("leaves")).alias("at")).distinct()
    starts = placed.groupBy("file").agg(F.lit(0).cast("long").alias("at"))
    # at most a few rows for each split: the candidates that an exit or the file start points to
    doors = placed.select("file", "block", (F.col("base") + F.col("off")).alias("at"), F.col("off"), F.when(F.col("leaves") >= 0, F.col("base") + F.col("leaves")).alias("to")).join(exits.unionByName(starts).distinct(), ["file", "at"])

    def from_start(frame):
        import pandas as pd

        by = {int(a): (int(b), int(o), None if pd.isna(t) else int(t)) for a, b, o, t in zip(frame["at"], frame["block"], frame["off"], frame["to"])}
        at, out = 0, []
        while at is not None and at in by:
            block, off, to = by.pop(at)
            out.append((block, off))
            at = to
        return pd.DataFrame({"file": [frame["file"].iloc[0]] * len(out), "block": [b for b, _ in out], "entry": [o for _, o in out]})

    entries = doors.groupBy("file").applyInPandas(from_start, "file string, block long, entry long")
    dealt = found.join(entries, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "off")
    result = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"

    def reachable(batches):
        key, want = None, 0
        for batch in batches:
            mask = []
            for file, block, off, succ, entry in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "off", "succ", "entry"))):
                if (file, block) != key:
                    key, want = (file, block), entry
                mask.append(off == want)
                if off == want:
                    want = succ
            kept = batch.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("page_id", "payload_bytes", "digest", "type", "refers_to", "verified")], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"])

    return in_batches(dealt, reachable, result)


def round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """pages written as archives in the shared folder, and what reading them back gives."""
    spark = pages.sparkSession
    path = new_path(spark, "archive")
    write_archive(pages, path, least_bytes=least_bytes)
    return read_archive(spark, path)
