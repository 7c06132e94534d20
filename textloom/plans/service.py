"""Answers, endpoints, catalogs, progress and the remaining small operators."""

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import progress, relate
from ..sources import catalog
from . import views as V
from .registry import query


@query("SELECT conv_id, turn, text FROM conversations")
def unwrap_answers(spark, d):
    """Texts in four wrappers come out as they were."""
    m, t = F.col("turn") % 4, F.trim("text")
    j = F.to_json(F.array(t))
    w = F.when(m == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(m == 1, j).when(m == 2, F.to_json(F.struct(t.alias("translation")))).otherwise(F.concat(F.lit("「"), t, F.lit("」")))
    return V.table(spark, d, "conversations").select("conv_id", "turn", A.unwrapped(w).alias("text"))


@query("SELECT conv_id, turn, text AS a, role AS b FROM conversations")
def parse_arrays(spark, d):
    """The array of the expected length, after a shorter one and prose."""
    t = F.concat(F.lit('Here: ["one"] then '), F.to_json(F.array("text", "role")), F.lit(" done [1]"))
    got = A.parsed_array(t, F.lit(2))
    return V.table(spark, d, "conversations").select("conv_id", "turn", got.alias("g")).select("conv_id", "turn", F.get("g", F.lit(0)).alias("a"), F.get("g", F.lit(1)).alias("b"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, page_id % 3 = 0 AS is_local FROM pages")
def endpoints(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, "http://127.0.0.1:8080/v1").otherwise(F.col("url"))
    return V.table(spark, d, "pages").select("page_id", A.endpoint_host(F.col("url")).alias("host"), A.is_local(url).alias("is_local"))


@query("SELECT event_id, ['credentials', 'rate', 'model', 'timeout', 'connection', 'other'][event_id % 6 + 1] AS hint FROM events")
def error_hints(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("HTTP 401", "Rate limit", "404 Not Found", "read timed out", "Connection refused", "odd"))), (F.col("event_id") % 6 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", A.error_hint(said).alias("hint"))


@query("SELECT event_id, event_id % 2 = 0 AS third FROM events")
def model_names(spark, d):
    name = F.when(F.col("event_id") % 2 == 0, "Qwen_3:8b").otherwise(F.lit("qwen2.5:7b"))
    return V.table(spark, d, "events").select("event_id", A.third_generation(name).alias("third"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS shown FROM (SELECT event_id, event_id * 7 AS s FROM events)")
def durations(spark, d):
    return V.table(spark, d, "events").select("event_id", A.duration(F.col("event_id") * 7).alias("shown"))


@query("SELECT page_id, 'fonts/' || page_id || '.ttf' AS font, page_id || '.4' AS version FROM pages")
def style_facts(spark, d):
    i = F.col("page_id").cast("string")
    return V.table(spark, d, "pages").select("page_id", A.font_path(F.concat(F.lit('style x: font "fonts/'), i, F.lit('.ttf" size 3'))).alias("font"), catalog.version(F.concat(F.lit('config.version = "'), i, F.lit('.4"'))).alias("version"))


_REL = "CASE page_id % 5 WHEN 0 THEN 'game/a' || page_id || '.rpy' WHEN 1 THEN 'game/tl/lang' || page_id % 3 || '/b' || page_id || '.rpyc' WHEN 2 THEN 'game/cache/c' || page_id || '.rpy' WHEN 3 THEN 'game/zz_' || page_id || '.rpy' ELSE 'game/d' || page_id || '.png' END"


def _tree(spark, d):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 5
    rel = F.when(m == 0, F.concat(F.lit("game/a"), i, F.lit(".rpy"))).when(m == 1, F.concat(F.lit("game/tl/lang"), (F.col("page_id") % 3).cast("string"), F.lit("/b"), i, F.lit(".rpyc"))).when(m == 2, F.concat(F.lit("game/cache/c"), i, F.lit(".rpy"))).when(m == 3, F.concat(F.lit("game/zz_"), i, F.lit(".rpy"))).otherwise(F.concat(F.lit("game/d"), i, F.lit(".png")))
    return V.table(spark, d, "pages").select(rel.alias("rel"))


@query(f"SELECT rel, CASE WHEN rel LIKE '%c' THEN 'compiled' ELSE 'source' END AS kind FROM (SELECT page_id, {_REL} AS rel FROM pages) WHERE page_id % 5 = 0")
def script_scan(spark, d):
    return catalog.scripts(_tree(spark, d)).select("rel", "kind")


@query(f"SELECT DISTINCT string_split(rel, '/')[3] AS language FROM (SELECT page_id, {_REL} AS rel FROM pages) WHERE page_id % 5 = 1")
def script_languages(spark, d):
    return catalog.languages(_tree(spark, d))


@query("SELECT '/game' AS root")
def script_root(spark, d):
    return catalog.root_of(_tree(spark, d))


@query("SELECT event_id // 250 AS tick, count(*) AS n, arg_max(value, event_id) AS latest FROM events GROUP BY 1")
def progress_ticks(spark, d):
    """Messages drained 250 at a time; of each tick the latest progress."""
    return progress.drained(V.table(spark, d, "events"), "event_id", "value")


@query(V.sql("SELECT DISTINCT 'm' || identifier AS old_id, identifier AS new_id FROM keyed_units", "keyed_units"))
def identifier_drift(spark, d):
    """Keys that changed while their text did not: rewritten without asking for a translation."""
    u = V.keyed_units(spark, d).select("identifier", F.right("identifier", F.lit(8)).alias("digest")).distinct()
    old = u.select(F.concat(F.lit("m"), "identifier").alias("old_id"), "digest", F.col("identifier").alias("is"))
    return old.join(u.withColumnRenamed("identifier", "new_id"), "digest").where("is = new_id").select("old_id", "new_id")


@query(V.sql("SELECT w AS name, min(doc_id) AS doc_id FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+)\\.', 1)) AS w FROM doc_lines) WHERE w IN (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+),', 1)) FROM doc_lines) GROUP BY w", "doc_lines"))
def reachable_definitions(spark, d):
    """Names that a pattern finds in use, with the first document that defines them."""
    lines = V.doc_lines(spark, d)
    used = relate.matches(lines, "text", "([A-Z][a-z]+),", "name")
    return relate.reachable(relate.matches(lines, "text", r"([A-Z][a-z]+)\.", "name", "doc_id"), used, "name", "doc_id")


@query(V.sql("SELECT doc_id, count(*) AS n FROM doc_lines WHERE regexp_matches(text, '^[A-Z][a-z]+ ') GROUP BY doc_id", "doc_lines"))
def count_definitions(spark, d):
    return V.doc_lines(spark, d).where(F.rlike("text", F.lit("^[A-Z][a-z]+ "))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(V.sql("SELECT conv_id, turn, coalesce(g.t, a.t, what) AS text FROM keyed_units u LEFT JOIN (SELECT identifier, min('T ' || what) AS t FROM keyed_units WHERE conv_id % 2 = 0 GROUP BY 1) g USING (identifier) LEFT JOIN (SELECT what, min('A ' || what) AS t FROM keyed_units WHERE conv_id % 3 = 0 GROUP BY 1) a USING (what)", "keyed_units"))
def substitute_translations(spark, d):
    """Two passes: translations gathered over all files, then put in by identifier, else by text."""
    u = V.keyed_units(spark, d)
    by_id = u.where("conv_id % 2 = 0").groupBy("identifier").agg(F.min(F.concat(F.lit("T "), "what")).alias("translation"))
    by_text = u.where("conv_id % 3 = 0").groupBy("what").agg(F.min(F.concat(F.lit("A "), "what")).alias("translation"))
    return relate.substituted(u, by_id, by_text, "identifier", "what").select("conv_id", "turn", F.col("translation").alias("text"))
