"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's rows as Parquet in the folder that driver and executors share and
reads them again for the next. Stages work on any docs with doc_id and text, nulls and repeated rows as
the operators define them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, neardup, op3, op4, packing, quality, secrets
from textloom.llm._store import keep, release, written


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the compression classifier rejects.

    Null and empty texts get the score of a text that neither dictionary favours; repeated rows are judged alike.
    """
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    The smallest doc_id of a group stays; of rows with one doc_id and one set of shingles one stays. Texts without words,
    nulls too, are linked with nothing, and rows with a null doc_id stay.
    """
    return neardup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of any benchmark item (op7 alone calls two items contamination).

    Texts without words stay; repeated rows are judged each for itself.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets replaced in the texts. Every row stays; null and empty texts stay as they are."""
    return secrets.redacted(docs, words=op4.words_path())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 ids. A null or empty text is one piece of its end id; repeated rows are packed each."""
    return packing.packed(docs, op3.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", of_quality),
    ("near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that remain of sf_dir's documents, packed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = written(spark)
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        release(spark, before, -1)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
