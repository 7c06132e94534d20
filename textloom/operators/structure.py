"""Structure of line-oriented text: lines, scopes, blocks and islands."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.batching import bounded
from ..functions.text import indent


def text_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line (1-based) with its indent; a BOM is stripped."""
    lines = F.posexplode(F.split(F.regexp_replace(F.col(text), "^﻿", ""), "\n"))
    return df.select(key, lines.alias("pos", "text")).select(key, (F.col("pos") + 1).cast("int").alias("line"), "text", indent(F.col("text")).cast("int").alias("indent"))


def scope_carry(df: DataFrame, key: str, order: Sequence[str], opens: str, out: str = "scope") -> DataFrame:
    """Labels carried to the rows below them. `opens` is null or a name: `.s` hangs below the last global name's first segment; `_x` opens nothing."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    name = F.col(opens)
    base = F.last(F.when(~name.startswith("."), F.split_part(name, F.lit("."), F.lit(1))), ignorenulls=True).over(w)
    rows = df.withColumn("_base", base)
    full = F.when(name.startswith("."), F.concat(F.coalesce(F.col("_base"), F.lit("")), F.when(F.col("_base").isNull(), F.substr(name, F.lit(2))).otherwise(name))).otherwise(name)
    full = F.when(~full.startswith("_"), full)
    return rows.withColumn("_full", full).withColumn(out, F.last("_full", ignorenulls=True).over(w)).drop("_base", "_full")


def innermost_block(df: DataFrame, key: str) -> DataFrame:
    """df (key, line, indent, is_header) with `block`: the line of the nearest header above with a smaller indent and no line of that indent or less between.

    The lines of one document are walked once, with a stack of open headers; a document is one row.
    """
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line", "indent", "is_header"))).alias("l"))
    bounded(df.sparkSession)
    found = F.arrays_zip(F.col("l.line").alias("line"), _blocks("l.line", "l.indent", "l.is_header").alias("block"))
    return rows.select(key, F.explode(found).alias("r")).select(key, "r.line", "r.block")


@F.pandas_udf(ArrayType(IntegerType()))
def _blocks(lines: pd.Series, indents: pd.Series, headers: pd.Series) -> pd.Series:
    def walk(line, indent, header):
        above: list[tuple[int, int]] = []
        out = []
        for n, i, h in zip(line.tolist(), indent.tolist(), header.tolist()):
            while above and above[-1][1] >= i:
                above.pop()
            out.append(above[-1][0] if above else None)
            if h:
                above.append((n, i))
        return out

    return pd.Series([walk(*doc) for doc in zip(lines, indents, headers)], dtype=object)


def islands(df: DataFrame, key: Sequence[str], order: Sequence[str], level: str, text: str) -> DataFrame:
    """Neighbouring rows of one level merged, texts joined in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.coalesce((F.lag(level).over(w) != F.col(level)).cast("int"), F.lit(1))
    rows = df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    item = F.struct(*[F.col(c) for c in order], F.col(text).alias("_t"))
    return rows.groupBy(*key, "island", level).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_t"]), "").alias(text))


def named_block(df: DataFrame, key: str, header: str) -> DataFrame:
    """Lines from the first that matches header until one, not blank, of its indent or less."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.rlike(F.trim("text"), F.lit(header))
    rows = df.withColumn("_start", F.min(F.when(hit, F.struct("line", "indent"))).over(w)).where("_start is not null")
    out = (F.col("line") > F.col("_start.line")) & (F.trim("text") != "") & (F.col("indent") <= F.col("_start.indent"))
    return rows.withColumn("_out", F.max(out.cast("int")).over(w)).where("_out = 0").drop("_start", "_out")


def deduped_blocks(df: DataFrame, key: str, header: str) -> DataFrame:
    """Lines without those of repeated blocks: a block runs from a header line to the next, and the first of its header stays."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.rlike("text", F.lit(header)), F.regexp_extract("text", header, 0))
    rows = df.withColumn("_name", name).withColumn("block", F.count("_name").over(w)).withColumn("_name", F.last("_name", ignorenulls=True).over(w))
    first = F.min("block").over(Window.partitionBy(key, "_name"))
    return rows.withColumn("_first", first).where("block = 0 or block = _first").drop("_name", "_first")


def packed_chunks(df: DataFrame, key: str, order: Sequence[str], size: str, *, most: int = 1200, items: int = 40) -> DataFrame:
    """Greedy chunks in order: a new one where the sizes would pass `most` or `items` are reached. A group is one row, walked once."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def chunks(sizes: pd.Series) -> pd.Series:
        def walk(group):
            chunk = used = n = 0
            out = []
            for s in group.tolist():
                if n and (used + s > most or n >= items):
                    chunk, used, n = chunk + 1, 0, 0
                used, n = used + s, n + 1
                out.append(chunk)
            return out

        return pd.Series([walk(g) for g in sizes], dtype=object)

    item = F.struct(*[F.col(c) for c in order], F.col(size).cast("int").alias("_s"))
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("l"))
    bounded(df.sparkSession)
    found = F.arrays_zip(F.col("l").alias("x"), chunks("l._s").alias("chunk"))
    return rows.select(key, F.explode(found).alias("r")).select(key, *[F.col(f"r.x.{c}").alias(c) for c in order if c != key], "r.chunk")
