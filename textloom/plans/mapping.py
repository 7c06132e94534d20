"""Maps over distinct texts with deterministic clients in place of a remote service."""

from pyspark.sql import functions as F

from ..operators import classify, mapper, relate
from . import views as V
from .registry import query


def shout(texts: list[str]) -> list[str]:
    """Doubles every text; answers long batches badly, as a weak service does."""
    if len(texts) > 25:
        return texts[:-1]
    return [t + t if "@@" not in t else t for t in texts]


def picky(texts: list[str]) -> list[str]:
    """Changes only texts of even length."""
    return ["x" + t if len(t) % 2 == 0 else t for t in texts]


@query("SELECT doc_id, CASE WHEN contains(text, chr(10)) OR trim(text) = '' THEN text ELSE text || text END AS translation FROM documents")
def map_distinct_double(spark, d):
    return mapper.map_distinct(V.table(spark, d, "documents").select("doc_id", "text"), "text", shout).select("doc_id", "translation")


@query("SELECT conv_id, turn, CASE WHEN length(t) % 2 = 0 THEN 'x' || t ELSE t END AS translation, CASE WHEN length(t) % 2 = 0 THEN 1 ELSE 2 END AS round FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS t FROM conversations)")
def unchanged_rounds(spark, d):
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    return mapper.in_rounds(rows, "t", picky, rounds=2).select("conv_id", "turn", "translation", "round")


@query(V.sql("SELECT conv_id, turn, turn % 4 = 3 AS accepted FROM tl_entries", "tl_entries"))
def validate_gates(spark, d):
    m = F.col("turn") % 4
    tr = F.when(m == 0, F.concat("original", F.lit(" @@p9@@"))).when(m == 1, F.concat("original", F.lit(" </think>"))).when(m == 2, F.lit("请提供原文")).otherwise(F.col("original"))
    return classify.validated(V.tl_entries(spark, d).withColumn("translation", tr)).select("conv_id", "turn", "accepted")


@query("SELECT conv_id, turn, 't:' || left(text, 8) AS translation FROM conversations WHERE text IN (SELECT text FROM conversations WHERE conv_id % 7 = 0)")
def retry_then_fan_out(spark, d):
    rows = V.table(spark, d, "conversations")
    wanted = relate.retry_only(rows, rows.where("conv_id % 7 = 0"), "text")
    answers = wanted.select("text").distinct().withColumn("translation", F.concat(F.lit("t:"), F.left("text", F.lit(8))))
    return relate.fan_out(wanted, answers, "text").select("conv_id", "turn", "translation")
