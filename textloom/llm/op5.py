"""Query op5: token counts of all documents.

The vocabulary is a file of pieces with scores that was made for merging; read as a unigram vocabulary, as the
method asks, it gives other counts than its own library: over the 200 documents of sf0.001, 218524 tokens
against 191304. The public files hold no unigram vocabulary; a path to one can be given to token_counts().
"""

from pyspark.sql import DataFrame, SparkSession

from .viterbi import token_counts

NAME = "op5_token_counts"
ORACLE = None


def model_path() -> str:
    """The vocabulary file that production uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
