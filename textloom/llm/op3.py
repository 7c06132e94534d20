"""Query op3: all documents packed into sequences of 2048 ids."""

from pyspark.sql import DataFrame, SparkSession

from .packing import packed

NAME = "op3_best_fit_packing"
ORACLE = None


def tokenizer_path() -> str:
    """The vocabulary file that production uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
