"""Incremental refresh: new files are read once, and only keys that are not there yet are worked on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


#: Rows of a batch whose hashes are sent to every task (16 bytes each or so); a larger batch meets the table by a shuffle.
SENT_ROWS = 1_000_000


def upsert_new(target: str, key: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows whose key the table at `target` lacks go through `work` and are written under their batch.

    A batch that runs again after a failure overwrites its own rows and looks only at other batches, so it adds nothing twice.
    The table is read for each batch but not moved: of its keys only those that share a hash with the batch are compared.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        new = batch.dropDuplicates([key])
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            known = spark.read.parquet(target).where(F.col("batch_id") < batch_id).select(key)
            new = new.join(_alike(known, batch, key), key, "left_anti")
            if not known.where(F.col(key).isNull()).isEmpty():
                new = new.where(F.col(key).isNotNull())
        work(new).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return run


def _alike(known: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Keys of known whose hash a key of the batch has."""
    hashed = F.xxhash64(key).alias("_h")
    hashes = batch.select(hashed)
    if batch.count() <= SENT_ROWS:
        hashes = F.broadcast(hashes)
    return known.select(key, hashed).join(hashes, "_h", "left_semi").select(key)


def refresh(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str, work: Callable[[DataFrame], DataFrame], *, files_per_batch: int = 1) -> DataFrame:
    """Works off the Parquet files that have come to `source` since the checkpoint, and returns the table at `target`."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(upsert_new(target, key, work)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)
