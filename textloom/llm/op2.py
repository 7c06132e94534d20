"""Query op2: quality scores of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .quality import fit, scored

NAME = "op2_quality_classifier"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
