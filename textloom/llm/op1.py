"""Query op1: repeated 100-byte strings of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .suffix_dedup import removal

NAME = "op1_suffix_dedup"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
