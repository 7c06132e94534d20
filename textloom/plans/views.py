"""Projections of the tables that the queries run over, as Spark frames and as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import keys, structure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def say_units(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", F.col("role").alias("who"), F.col("text").alias("what"), F.concat(F.lit("c."), F.col("conv_id").cast("string")).alias("label"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("filename"), (F.col("turn") + 1).alias("line"))


def keyed_units(spark, d):
    """say_units with identifiers."""
    return say_units(spark, d).withColumn("identifier", keys.identifier(F.col("label"), keys.say_code(F.col("who"), F.col("what"))))


def tl_entries(spark, d):
    m = F.col("turn") % 6
    what = F.col("what")
    tr = F.when(m == 0, what).when(m == 1, F.concat(F.lit("這是"), F.left(what, F.lit(1)))).when(m == 2, F.concat(F.lit("中文 "), what)).when(m == 3, F.concat(what, F.lit(" "), what)).when(m == 4, F.lit("привет мир")).otherwise(F.lit("好"))
    return say_units(spark, d).select("conv_id", "turn", what.alias("original"), tr.alias("translation"), (F.col("conv_id") % 2 == 0).alias("is_string"))


def doc_lines(spark, d):
    return structure.text_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def string_units(spark, d):
    """Lines of documents, then benchmark items: part, id, line, text, context."""
    lines = doc_lines(spark, d).select(F.lit(0).alias("part"), F.col("doc_id").alias("id"), F.col("line").cast("long").alias("line"), "text")
    items = table(spark, d, "benchmark").select(F.lit(1).alias("part"), F.col("item_id").alias("id"), F.lit(1).cast("long").alias("line"), "text")
    m = (F.col("id") + F.col("line")) % 4
    context = F.when(m == 0, "menu").when(m == 1, "screen").when(m == 2, "define").otherwise("character")
    return lines.unionByName(items).withColumn("context", context)


def existing_tl(spark, d):
    """Every third conversation translated already, some identifiers twice: the later value counts."""
    u = keyed_units(spark, d).where("conv_id % 3 = 0")
    seq = F.col("conv_id") * 1000 + F.col("turn")
    once = u.select("identifier", F.concat(F.lit("t:"), F.left("what", F.lit(5))).alias("translation"), seq.alias("seq"))
    again = u.where("turn % 2 = 0").select("identifier", F.concat(F.lit("u:"), F.left("what", F.lit(5))).alias("translation"), (seq + 100_000_000).alias("seq"))
    return once.unionByName(again)


def marked(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" {b}["), "source", F.lit("]")).alias("text"))


_ENCODED = "'\"' || replace(replace(replace(replace(replace({0}, '\\', '\\\\'), chr(10), '\\n'), '\"', '\\\"'), '  ', ' \\ '), '  ', ' \\ ') || '\"'"


def encoded(c: str) -> str:
    return _ENCODED.format(c)


SQL = {
    "say_units": "SELECT conv_id, turn, role AS who, text AS what, 'c.' || conv_id AS label, 'conv/' || conv_id AS filename, turn + 1 AS line FROM conversations",
    "keyed_units": f"SELECT *, replace(label, '.', '_') || '_' || left(md5(who || ' ' || {encoded('what')} || chr(13) || chr(10)), 8) AS identifier FROM say_units",
    "tl_entries": "SELECT conv_id, turn, what AS original, CASE turn % 6 WHEN 0 THEN what WHEN 1 THEN '這是' || left(what, 1) WHEN 2 THEN '中文 ' || what WHEN 3 THEN what || ' ' || what WHEN 4 THEN 'привет мир' ELSE '好' END AS translation, conv_id % 2 = 0 AS is_string FROM say_units",
    "doc_lines": "SELECT doc_id, line::INT AS line, text, (length(text) - length(ltrim(text, ' ' || chr(9))))::INT AS indent FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "string_units": "SELECT *, CASE (id + line) % 4 WHEN 0 THEN 'menu' WHEN 1 THEN 'screen' WHEN 2 THEN 'define' ELSE 'character' END AS context FROM (SELECT 0 AS part, doc_id AS id, line::BIGINT AS line, text FROM doc_lines UNION ALL SELECT 1, item_id, 1, text FROM benchmark)",
    "existing_tl": "SELECT identifier, 't:' || left(what, 5) AS translation, conv_id * 1000 + turn AS seq FROM keyed_units WHERE conv_id % 3 = 0 UNION ALL SELECT identifier, 'u:' || left(what, 5), conv_id * 1000 + turn + 100000000 FROM keyed_units WHERE conv_id % 3 = 0 AND turn % 2 = 0",
    "latest_tl": "SELECT identifier, arg_max(translation, seq) AS translation, min(seq) AS first_seq FROM existing_tl GROUP BY identifier",
    "fallback_tl": "SELECT string_split(identifier, '_')[-1] AS digest, arg_min(translation, first_seq) AS translation FROM latest_tl WHERE regexp_full_match(string_split(identifier, '_')[-1], '[0-9a-f]{8}') GROUP BY 1",
    "marked": "SELECT doc_id, text || ' {b}[' || source || ']' AS text FROM documents",
}
_NEEDS = {"keyed_units": ["say_units"], "tl_entries": ["say_units"], "string_units": ["doc_lines"], "existing_tl": ["keyed_units"], "latest_tl": ["existing_tl"], "fallback_tl": ["latest_tl"]}


def sql(body: str, *views: str) -> str:
    """body with the views it names, and those that they name, before it."""
    order: list[str] = []

    def add(v: str) -> None:
        for w in _NEEDS.get(v, ()):
            add(w)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in order)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
