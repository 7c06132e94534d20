"""Tables that cut lineage: written once in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_kept: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (one machine, tests) a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = tempfile.mkdtemp(prefix="textloom-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/textloom/{uuid.uuid4().hex}/{name}"
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read from there; a lost executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many tables this application has written and not released; a place for release()."""
    return len(_kept.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, first: int = 0, last: int | None = None) -> None:
    """Deletes the tables that keep() wrote in this application, or those from place `first` on and before `last`. Call it when results that read them are no longer needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _kept.get(spark.sparkContext.applicationId, [])
    gone, paths[first:last] = paths[first:last], []
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        at.getFileSystem(conf).delete(at, True)
