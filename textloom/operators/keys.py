"""Stable keys of text units: canonical codes, digests, identifiers, suffixes, first and last wins."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.batching import bounded
from ..functions.text import encode_say


def say_code(who: Column | None, what: Column, *, attributes: Column | None = None, temporary: Column | None = None, interact: Column | None = None, explicit_id: Column | None = None, arguments: Column | None = None, with_expr: Column | None = None) -> Column:
    """Canonical form of a spoken line; parts that are null or empty are left out."""
    some = lambda c: F.when(c != "", c)
    parts = [some(who)] if who is not None else []
    if attributes is not None:
        parts.append(some(F.array_join(attributes, " ")))
    if temporary is not None:
        parts.append(F.when(F.size(temporary) > 0, F.concat(F.lit("@ "), F.array_join(temporary, " "))))
    parts.append(encode_say(what))
    if interact is not None:
        parts.append(F.when(~interact, F.lit("nointeract")))
    if explicit_id is not None:
        parts.append(F.concat(F.lit("id "), some(explicit_id)))
    if arguments is not None:
        parts.append(some(arguments))
    if with_expr is not None:
        parts.append(F.concat(F.lit("with "), some(with_expr)))
    return F.concat_ws(" ", *parts)


def digest(code: Column) -> Column:
    """First eight hex digits of the MD5 of the code and a line end."""
    return F.left(F.md5(F.concat(code, F.lit("\r\n")).cast("binary")), F.lit(8))


def identifier(label: Column, code: Column) -> Column:
    """Label with underscores for dots, and the digest; without a label the digest alone."""
    return F.concat_ws("_", F.when(label != "", F.replace(label, F.lit("."), F.lit("_"))), digest(code))


def suffixed(df: DataFrame, key: str, order: Sequence[str], *, within: Sequence[str] = (), out: str = "key") -> DataFrame:
    """Second and later rows of a key get _1, _2 ... in order. Filters come after: dropped rows use up suffixes."""
    n = F.row_number().over(Window.partitionBy(*within, key).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(key)).otherwise(F.concat_ws("_", F.col(key), (n - 1).cast("string"))))


def suffixed_across(df: DataFrame, key: str, root: str, order: Sequence[str], out: str = "key") -> DataFrame:
    """Keys that files have suffixed already are made unique once more, greedily in order.

    A taken key k becomes the first free one of k_1, k_2 ...; all collisions share their un-suffixed root,
    so each root is a group of its own. A group holds the uses of one text under one label; its rows pass one
    by one in order, and only its distinct keys are held, each with the last suffix it was given.
    """
    fields = [*df.schema.fields, StructField(out, StringType())]
    names = [f.name for f in fields]
    bounded(df.sparkSession)

    def run(batches):
        group, free = None, _Free()
        for batch in batches:
            made = []
            for r, k in zip(batch.column(root).to_pylist(), batch.column(key).to_pylist()):
                if r != group:
                    group, free = r, _Free()
                made.append(free(k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=names)

    rows = df.repartition(root).sortWithinPartitions(root, *order)
    return rows.mapInArrow(run, StructType(fields))


class _Free:
    """Free names of one group: a key that is new stays, another gets its next free suffix. Every suffix up to the last one given is taken."""

    def __init__(self):
        self.kept: set[str] = set()
        self.last: dict[str, int] = {}

    def _given(self, k: str) -> bool:
        base, _, i = k.rpartition("_")
        return base in self.last and i.isascii() and i.isdigit() and i[0] != "0" and int(i) <= self.last[base]

    def __call__(self, k: str) -> str:
        if k not in self.kept and not self._given(k):
            self.kept.add(k)
            return k
        i = self.last.get(k, 0) + 1
        while f"{k}_{i}" in self.kept:
            i += 1
        self.last[k] = i
        return f"{k}_{i}"


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key, all columns. Each task keeps one row of a key before the shuffle, so a hot key is not moved whole."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) for c in order])


def last_wins(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """(key, value, first_seq): the value of the last row, placed where the key came first. Combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value), F.min(seq).alias("first_seq"))


def inverted_index(df: DataFrame, text: str, seq: str) -> DataFrame:
    """Distinct texts with the sorted places that hold them."""
    return df.groupBy(text).agg(F.min(seq).alias("first_seq"), F.count("*").alias("n"), F.sort_array(F.collect_list(seq)).alias("places"))


def fingerprint(df: DataFrame, seq: str, text: str, prefix: str = "d:") -> DataFrame:
    """One digest of all texts in order.

    Texts are reduced to their own digests first, so what meets in one row is 16 bytes for each text, not
    the corpus; equal() of two fingerprints answers what one over the texts themselves would.
    """
    one = F.unhex(F.md5(F.concat(F.lit(prefix), F.col(text), F.lit("\0")).cast("binary")))
    return df.select(F.struct(F.col(seq), F.hex(one).alias("h")).alias("s")).agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["h"]), "").cast("binary")).alias("fingerprint"))
