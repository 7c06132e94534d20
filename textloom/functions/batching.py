"""Arrow batches bounded in bytes: texts may be long, and what a Python worker holds is to follow from a batch, not from the input."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch, where the session does not say otherwise (one row at least).
BATCH_BYTES = "4m"
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession | None = None) -> None:
    """Bounds the batches of the session, or of the active one."""
    spark = spark or SparkSession.active()
    if spark.conf.get(_SETTING, None) is None:
        spark.conf.set(_SETTING, BATCH_BYTES)
