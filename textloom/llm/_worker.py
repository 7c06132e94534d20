"""Arrow batches of bounded size to Python workers that give freed memory back.

A worker outlives its task and serves other operators, so what an allocator keeps for itself adds up
beside the JVM. Batches are bounded in bytes, not in rows alone, as texts may be long.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of a batch, where the session does not say otherwise (one row at least).
BATCH_BYTES = "4m"
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Returns free memory of this process to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run with buffers from the system's allocator, which keeps no pool, and what is free given back at the end."""

    def wrapped(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of bounded size, in lean workers."""
    conf = df.sparkSession.conf
    if conf.get(_SETTING, None) is None:
        conf.set(_SETTING, BATCH_BYTES)
    return df.mapInArrow(lean(run), schema)
