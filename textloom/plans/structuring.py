"""Lines, scopes, blocks, islands and chunks."""

from pyspark.sql import functions as F

from ..operators import structure
from . import views as V
from .registry import query


@query(V.sql("SELECT doc_id, line, text, indent FROM doc_lines", "doc_lines"))
def text_lines(spark, d):
    return V.doc_lines(spark, d)


_OPENS = "CASE turn % 7 WHEN 0 THEN 'g' || conv_id || '.a' WHEN 2 THEN '.s' || turn WHEN 3 THEN '_hidden' WHEN 5 THEN 'h' || turn END"


@query(V.sql(f"""SELECT conv_id, turn, last_value(f IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS scope FROM (
 SELECT conv_id, turn, CASE WHEN left(o, 1) = '_' THEN NULL WHEN left(o, 1) = '.' THEN CASE WHEN b IS NULL THEN substr(o, 2) ELSE b || o END ELSE o END AS f FROM (
 SELECT *, last_value(CASE WHEN left(o, 1) <> '.' THEN split_part(o, '.', 1) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, {_OPENS} AS o FROM conversations)))"""))
def scope_carry(spark, d):
    m = F.col("turn") % 7
    opens = F.when(m == 0, F.concat(F.lit("g"), F.col("conv_id").cast("string"), F.lit(".a"))).when(m == 2, F.concat(F.lit(".s"), F.col("turn").cast("string"))).when(m == 3, "_hidden").when(m == 5, F.concat(F.lit("h"), F.col("turn").cast("string")))
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", opens.alias("o"))
    return structure.scope_carry(rows, "conv_id", ["turn"], "o").select("conv_id", "turn", "scope")


def _indented(spark, d):
    return V.doc_lines(spark, d).select("doc_id", "line", (F.length("text") % 5).cast("int").alias("indent"), (F.length("text") % 3 == 0).alias("is_header"))


@query(V.sql("""WITH l AS (SELECT doc_id, line, length(text) % 5 AS indent, length(text) % 3 = 0 AS h FROM doc_lines),
 c AS (SELECT a.doc_id, a.line, max(b.line) AS below FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.line < a.line AND b.h AND b.indent < a.indent
   AND NOT EXISTS (SELECT 1 FROM l m WHERE m.doc_id = a.doc_id AND m.line > b.line AND m.line <= a.line AND m.indent <= b.indent) GROUP BY 1, 2)
 SELECT l.doc_id, l.line, c.below AS block FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.line = c.line""", "doc_lines"))
def block_membership(spark, d):
    return structure.innermost_block(_indented(spark, d), "doc_id")


@query("""SELECT user_id, island, level, count(*) AS n, string_agg(event_id::VARCHAR, '' ORDER BY ts, event_id) AS text FROM (
 SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
 SELECT user_id, ts, event_id, event_type AS level, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS b FROM events)) GROUP BY 1, 2, 3""")
def islands_merge(spark, d):
    log = V.table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("level"), F.col("event_id").cast("string").alias("text"))
    return structure.islands(log, ["user_id"], ["ts", "event_id"], "level", "text").select("user_id", "island", "level", "n", "text")


@query(V.sql(r"""SELECT doc_id, line, text FROM (SELECT *, CASE WHEN nm IS NULL THEN NULL ELSE min(block) OVER (PARTITION BY doc_id, nm) END AS first FROM (
 SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS nm, count(hd) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM (
 SELECT doc_id, line, text, CASE WHEN regexp_matches(text, '^[A-Z]') THEN regexp_extract(text, '^[A-Z]') END AS hd FROM doc_lines))) WHERE block = 0 OR block = first""", "doc_lines"))
def dedupe_blocks(spark, d):
    return structure.deduped_blocks(V.doc_lines(spark, d).select("doc_id", "line", "text"), "doc_id", "^[A-Z]").select("doc_id", "line", "text")


@query(V.sql("""WITH s AS (SELECT doc_id, min(line) AS a FROM doc_lines WHERE regexp_matches(trim(text), '^[A-M]') GROUP BY 1)
 SELECT doc_id, line FROM (SELECT *, max(CASE WHEN line > a AND trim(text) <> '' AND ind <= i0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS o FROM (
 SELECT l.doc_id, l.line, l.text, length(l.text) % 5 AS ind, s.a, first_value(length(l.text) % 5) OVER (PARTITION BY l.doc_id ORDER BY l.line) AS i0 FROM doc_lines l JOIN s ON l.doc_id = s.doc_id AND l.line >= s.a)) WHERE o = 0""", "doc_lines"))
def named_block(spark, d):
    rows = V.doc_lines(spark, d).withColumn("indent", (F.length("text") % 5).cast("int"))
    return structure.named_block(rows, "doc_id", "^[A-M]").select("doc_id", "line")


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
 f AS (SELECT conv_id, turn, k, s AS used, 1 AS items, 0 AS chunk FROM n WHERE k = 1 UNION ALL
 SELECT n.conv_id, n.turn, n.k, CASE WHEN f.used + n.s > 1200 OR f.items >= 40 THEN n.s ELSE f.used + n.s END, CASE WHEN f.used + n.s > 1200 OR f.items >= 40 THEN 1 ELSE f.items + 1 END,
 CASE WHEN f.used + n.s > 1200 OR f.items >= 40 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1)
 SELECT conv_id, turn, chunk FROM f""")
def chunk_pack(spark, d):
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("s"))
    return structure.packed_chunks(rows, "conv_id", ["turn"], "s").select("conv_id", "turn", "chunk")
