"""Query op4: secrets in all documents."""

from pyspark.sql import DataFrame, SparkSession

from .secrets import scanned

NAME = "op4_secret_scan"
ORACLE = None


def words_path() -> str:
    """The vocabulary file whose words production knows."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=words_path())
