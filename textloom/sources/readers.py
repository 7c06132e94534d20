"""Readers of translation files, reports and progress. Files are rows (path, text); lines carry their place.

A translation file may also come in pieces (path, piece, head, text), cut between entries; head is the first line of the
block that a piece goes on with. Then n counts the lines of a piece, and no file is gathered.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.batching import bounded
from ..functions.text import decode_quoted, decode_say, trimmed, unescape_report

_HEAD = r"^translate\s+(\w+)\s+(\w+)\s*:"


def _place(rows: DataFrame) -> list[str]:
    return ["path", "piece"] if "piece" in rows.columns else ["path"]


def lines_of(files: DataFrame) -> DataFrame:
    """(path, n, line) with 1-based n."""
    own = [c for c in ("piece", "head") if c in files.columns]
    rows = files.select("path", *own, F.posexplode(F.split(F.regexp_replace("text", "^﻿", ""), "\r?\n")).alias("n", "line"))
    return rows.withColumn("n", F.col("n") + 1)


def blocks(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """lines_of() inside translation blocks, with the block's language, id and number; of the lines only those that match `wanted`."""
    place = _place(files)
    w = Window.partitionBy(*place).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    key = lambda s: F.when(F.rlike(s, F.lit(_HEAD)), F.struct(F.regexp_extract(s, _HEAD, 1).alias("language"), F.regexp_extract(s, _HEAD, 2).alias("id")))
    before = key(trimmed(F.col("head"))) if "head" in files.columns else F.lit(None)
    s = trimmed(F.col("line"))
    rows = lines_of(files).select(*place, "n", "line", s.alias("s"), key(s).alias("own"), before.alias("before"))
    if wanted:
        rows = rows.where(F.col("own").isNotNull() | F.rlike("s", F.lit(wanted)))
    rows = rows.withColumn("block", F.count("own").over(w)).withColumn("key", F.coalesce(F.last("own", ignorenulls=True).over(w), "before"))
    return rows.where("key is not null and own is null").select(*place, "n", "line", "s", "block", "key.language", "key.id")


def dialogue_rows(files: DataFrame) -> DataFrame:
    """(path, n, language, identifier, who, original, translation): the first line of a block that is no comment, and the comment's text."""
    place = _place(files)
    rows = blocks(files).where("id <> 'strings' and s <> ''")
    quoted = lambda s: F.regexp_extract(s, r'^[^"]*"(.*)"', 1)
    comment = F.startswith("s", F.lit("#"))
    first = F.min(F.when(~comment, F.struct("n", "s")))
    source = F.max(F.when(comment, F.struct("n", "s")))
    got = rows.groupBy(*place, "block", "language", "id").agg(first.alias("t"), source.alias("o")).where("t is not null and instr(t.s, '\"') > 0")
    who = trimmed(F.regexp_extract("t.s", r'^([^"]*)"', 1))
    return got.select(*place, F.col("t.n").alias("n"), "language", F.col("id").alias("identifier"), F.when(who != "", who).alias("who"), decode_say(quoted(F.col("o.s"))).alias("original"), decode_say(quoted(F.col("t.s"))).alias("translation"))


def string_rows(files: DataFrame) -> DataFrame:
    """(path, n, language, original, translation) of old/new pairs."""
    place = _place(files)
    rows = blocks(files, r"^(old|new)\s").where("id = 'strings'")
    part = lambda word: F.when(F.rlike("s", F.lit(rf'^{word}\s+".*"\s*$')), F.regexp_extract("s", rf'^{word}\s+"(.*)"\s*$', 1))
    rows = rows.withColumn("old", part("old")).withColumn("new", part("new")).where("old is not null or new is not null")
    # an old line is used by the next new line of its block alone
    prev = F.lag(F.struct("block", "old")).over(Window.partitionBy(*place).orderBy("n"))
    rows = rows.withColumn("prev", prev).withColumn("original", F.when(F.col("prev.block") == F.col("block"), F.col("prev.old")))
    return rows.where("new is not null and original is not null").select(*place, "n", "language", decode_say(F.col("original")).alias("original"), decode_say(F.col("new")).alias("translation"))


def last_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, translation): the last file's last row wins."""
    return rows.groupBy(key).agg(F.max_by("translation", F.struct(F.lower("path"), "path", "n")).alias("translation"))


def untranslated_report(files: DataFrame) -> DataFrame:
    """(path, n, text) of rows `file:line  text`."""
    s = trimmed(F.col("line"))
    rows = lines_of(files).where(~F.startswith(s, F.lit("==")) & F.rlike(s, F.lit(r"^.+:\d+\s{2,}(.+)$")))
    return rows.select("path", "n", unescape_report(trimmed(F.regexp_extract(s, r"^.+:\d+\s{2,}(.+)$", 1))).alias("text"))


def audit_report(files: DataFrame, *, original: str = "原文", translation: str = "译文") -> DataFrame:
    """(path, n, text): what follows an original mark, up to the translation mark."""
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    start, stop = F.rlike("line", F.lit(rf"^\s*{original}[:：]")), F.rlike("line", F.lit(rf"^\s*{translation}[:：]"))
    rows = lines_of(files).withColumn("e", F.count(F.when(start, 1)).over(w)).where("e > 0")
    rows = rows.withColumn("stop", F.max(stop.cast("int")).over(Window.partitionBy("path", "e").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).where("stop = 0")
    body = F.regexp_replace("line", rf"^\s*{original}[:：]\s*", "")
    got = rows.groupBy("path", "e").agg(F.min("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.when(start, body).otherwise(F.col("line")).alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return got.select("path", "n", trimmed(F.col("text")).alias("text")).where("text <> ''")


def any_report(files: DataFrame) -> DataFrame:
    """(path, n, text, kind): a file with audit entries is an audit report, else an untranslated report; other files give no rows."""
    audit = audit_report(files).withColumn("kind", F.lit("audit"))
    rest = untranslated_report(files).join(audit.select("path").distinct(), "path", "left_anti").withColumn("kind", F.lit("untranslated"))
    return audit.unionByName(rest.select("path", "n", "text", "kind"))


def missing_report(files: DataFrame, *, title_rows: int = 3) -> DataFrame:
    """(path, n, filename, line, who, what, identifier, node_type) of tab-separated rows; tabs inside the text stay."""
    p = F.split("line", "\t")
    rows = lines_of(files).where(F.col("n") > title_rows).where(F.size(p) >= 5).withColumn("p", p)
    at = lambda k: F.element_at("p", k)
    kind = trimmed(at(-1))
    return rows.select(
        "path", "n", F.split_part(at(1), F.lit(":"), F.lit(1)).alias("filename"),
        F.coalesce(F.expr("try_cast(regexp_extract(p[0], '^[^:]*:(.*)$', 1) as int)"), F.lit(0)).alias("line"),
        F.regexp_replace(at(2), r"^[\[\]]+|[\[\]]+$", "").alias("who"),
        F.replace(F.array_join(F.slice("p", F.lit(3), F.size("p") - 4), "\t"), F.lit("\\n"), F.lit("\n")).alias("what"),
        at(-2).alias("identifier"), F.when(kind == "", "TranslateSay").otherwise(kind).alias("node_type"),
    )


def key_values(files: DataFrame) -> DataFrame:
    """(path, key, value) of `key: value` lines, the last of a key."""
    rows = lines_of(files).where(F.contains("line", F.lit(":")))
    kv = rows.select("path", "n", trimmed(F.split_part("line", F.lit(":"), F.lit(1))).alias("key"), trimmed(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    return kv.groupBy("path", "key").agg(F.max_by("value", "n").alias("value"))


def progress(files: DataFrame) -> DataFrame:
    """(path, fp, kind, text, translation) of JSON progress files; malformed ones give no rows.

    Texts are names of members there, and Spark's own parser gives up a file for a name of over 50000 characters.
    """
    bounded(files.sparkSession)
    return files.select("path", "text").mapInArrow(_progress_rows, _PROGRESS)


_PROGRESS = "path string, fp string, kind string, text string, translation string"


def _progress_rows(batches):
    names = [part.split()[0] for part in _PROGRESS.split(", ")]
    schema = pa.schema([(n, pa.string()) for n in names])
    for batch in batches:
        for path, text in zip(batch.column("path"), batch.column("text")):
            try:
                found = json.loads(text.as_py())
            except (TypeError, ValueError, RecursionError):
                continue
            if not isinstance(found, dict):
                continue
            for kind in ("dialogue", "string"):
                pairs = found.get(f"{kind}s")
                if isinstance(pairs, dict) and pairs:
                    n = len(pairs)
                    columns = [[path.as_py()] * n, [_as_text(found.get("__fp__"))] * n, [kind] * n, [_as_text(k) for k in pairs], [_as_text(x) for x in pairs.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=schema)


def _as_text(value) -> str | None:
    """A value as Spark's parser gives it for a string; half a surrogate pair, which no UTF-8 holds, is a question mark."""
    if value is None:
        return None
    value = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return value.encode("utf-8", "replace").decode()


def quoted(text):
    """The text between a line's matching quotes."""
    return decode_quoted(text)
