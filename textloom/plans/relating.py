"""Precedence, coverage, caches and assembly."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, keys, relate
from . import views as V
from .registry import query

_STEM = "regexp_replace(url, '[#?].*$', '')"


def _files(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[#?].*$", "").alias("stem"))


@query(f"WITH f AS (SELECT page_id, {_STEM} AS stem FROM pages) SELECT page_id, stem, 'compiled' AS kind FROM f WHERE page_id % 3 = 0 UNION ALL SELECT page_id, stem, 'source' FROM f WHERE page_id % 3 <> 0 AND lower(stem) NOT IN (SELECT lower(stem) FROM f WHERE page_id % 3 = 0)")
def source_precedence(spark, d):
    f = _files(spark, d)
    return relate.source_precedence(f.where("page_id % 3 = 0"), f.where("page_id % 3 <> 0"), "stem").select("page_id", "stem", "kind")


@query("SELECT page_id, host FROM (SELECT page_id, lower(split_part(url, '/', 3)) AS host, row_number() OVER (PARTITION BY lower(split_part(url, '/', 3)) ORDER BY page_id DESC) AS k FROM pages) WHERE k = 1")
def archive_overlay(spark, d):
    p = V.table(spark, d, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    return relate.overlay(p, "host", ["page_id"]).select("page_id", F.lower("host").alias("host"))


@query(V.sql("SELECT term, part, id, line FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY part, id, line) AS k FROM (SELECT trim(text) AS term, part, id, line FROM string_units WHERE context = 'character') WHERE length(term) >= 2) WHERE k = 1", "string_units"))
def protect_terms(spark, d):
    _, names = relate.context_split(V.string_units(spark, d))
    return relate.protect_terms(names, "text", ["part", "id", "line"])


@query(V.sql("SELECT context, count(*) AS n FROM string_units WHERE context <> 'character' GROUP BY context", "string_units"))
def context_split(spark, d):
    rest, _ = relate.context_split(V.string_units(spark, d))
    return classify.counts(rest, "context")


@query(V.sql("SELECT doc_id, line, text FROM doc_lines WHERE text IN (SELECT text FROM doc_lines WHERE line = 1)", "doc_lines"))
def retry_semi(spark, d):
    lines = V.doc_lines(spark, d)
    return relate.retry_only(lines, lines.where("line = 1"), "text").select("doc_id", "line", "text")


def _coverage_sql(strict: str) -> str:
    return V.sql(
        f"""WITH e AS (SELECT identifier FROM existing_tl UNION SELECT identifier || '_1' FROM existing_tl WHERE seq % 4 = 0),
 g AS (SELECT DISTINCT string_split(identifier, '_')[-1] AS g FROM e {strict})
 SELECT conv_id, turn, (identifier IN (SELECT identifier FROM e) OR string_split(identifier, '_')[-1] IN (SELECT g FROM g) OR coalesce(string_split(identifier, '_')[-2], '') IN (SELECT g FROM g)) AS covered FROM keyed_units""",
        "existing_tl",
    )


def _coverage(spark, d, strict):
    e = V.existing_tl(spark, d)
    e = e.select("identifier").unionByName(e.where("seq % 4 = 0").select(F.concat("identifier", F.lit("_1")).alias("identifier")))
    return relate.coverage(V.keyed_units(spark, d), e, strict=strict).select("conv_id", "turn", "covered")


@query(_coverage_sql(""))
def coverage_split(spark, d):
    return _coverage(spark, d, False)


@query(_coverage_sql("WHERE regexp_full_match(string_split(identifier, '_')[-1], '[0-9a-f]{8}')"))
def coverage_split_strict(spark, d):
    return _coverage(spark, d, True)


@query(V.sql("SELECT identifier FROM keyed_units EXCEPT SELECT identifier FROM existing_tl", "existing_tl"))
def stale_ids(spark, d):
    return relate.stale(V.keyed_units(spark, d), V.existing_tl(spark, d), "identifier")


@query(V.sql("SELECT identifier, 0 AS part FROM keyed_units WHERE conv_id % 3 = 0 UNION ALL SELECT identifier, 1 FROM keyed_units WHERE conv_id % 2 = 0 AND identifier NOT IN (SELECT identifier FROM keyed_units WHERE conv_id % 3 = 0)", "keyed_units"))
def todo_union(spark, d):
    u = V.keyed_units(spark, d)
    return relate.ordered_union(u.where("conv_id % 3 = 0").select("identifier"), u.where("conv_id % 2 = 0").select("identifier"), "identifier")


_CACHE = "SELECT text, CASE WHEN doc_id % 2 = 0 THEN text ELSE 't:' || left(text, 3) END AS translation FROM (SELECT text, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 <> 1 GROUP BY text)"


def _cache(spark, d):
    c = V.table(spark, d, "documents").where("doc_id % 3 <> 1").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return c.select("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("t:"), F.left("text", F.lit(3)))).alias("translation"))


@query(f"SELECT text, translation FROM ({_CACHE}) WHERE text IN (SELECT text FROM documents WHERE doc_id % 4 = 0)")
def cache_migration(spark, d):
    docs = V.table(spark, d, "documents")
    now = docs.where("doc_id % 4 = 0")
    same = keys.fingerprint(docs, "doc_id", "text").join(keys.fingerprint(now, "doc_id", "text").withColumnRenamed("fingerprint", "other")).select((F.col("fingerprint") == F.col("other")).alias("same"))
    return relate.migrate_cache(_cache(spark, d), now, "text", same_print=same)


@query(f"SELECT doc_id FROM documents d LEFT JOIN ({_CACHE}) c USING (text) WHERE translation IS NULL OR translation = text")
def need_work(spark, d):
    return relate.need_work(V.table(spark, d, "documents"), _cache(spark, d), "text").select("doc_id")


@query(V.sql("SELECT digest, translation FROM fallback_tl", "fallback_tl"))
def digest_fallback(spark, d):
    return relate.digest_fallback(V.existing_tl(spark, d))


_NEW = "SELECT identifier, max('n:' || left(what, 4)) AS translation FROM keyed_units WHERE conv_id % 5 = 0 GROUP BY identifier"
_OLD = "SELECT identifier, translation FROM latest_tl WHERE right(identifier, 1) < '8'"


@query(V.sql(f"WITH u AS (SELECT DISTINCT identifier FROM keyed_units) SELECT u.identifier, coalesce(n.translation, o.translation, f.translation) AS translation, CASE WHEN n.translation IS NOT NULL THEN 'new' WHEN o.translation IS NOT NULL THEN 'existing' WHEN f.translation IS NOT NULL THEN 'fallback' END AS origin FROM u LEFT JOIN ({_NEW}) n USING (identifier) LEFT JOIN ({_OLD}) o USING (identifier) LEFT JOIN fallback_tl f ON f.digest = string_split(u.identifier, '_')[-1]", "fallback_tl"))
def assemble(spark, d):
    u = V.keyed_units(spark, d)
    new = u.where("conv_id % 5 = 0").groupBy("identifier").agg(F.max(F.concat(F.lit("n:"), F.left("what", F.lit(4)))).alias("translation"))
    existing = V.existing_tl(spark, d)
    old = keys.last_wins(existing, "identifier", "translation", "seq").where(F.right("identifier", F.lit(1)) < "8")
    return relate.assemble(u, new, old, relate.digest_fallback(existing))


@query("SELECT doc_id, 't:' || left(text, 6) AS translation FROM documents")
def fanout_back(spark, d):
    docs = V.table(spark, d, "documents")
    results = docs.select("text").distinct().withColumn("translation", F.concat(F.lit("t:"), F.left("text", F.lit(6))))
    return relate.fan_out(docs, results, "text").select("doc_id", "translation")


_MISSING = "SELECT conv_id, turn, identifier, '  ' || what AS text FROM keyed_units WHERE turn % 2 = 0"
_KNOWN = "SELECT what AS text, CASE WHEN length(what) % 2 = 0 THEN what ELSE 'k:' || left(what, 4) END AS translation FROM (SELECT DISTINCT what FROM keyed_units WHERE conv_id % 3 = 0)"


@query(V.sql(f"SELECT conv_id, turn, CASE WHEN k.translation <> k.text THEN '  ' || k.translation END AS translation FROM ({_MISSING}) m LEFT JOIN ({_KNOWN}) k ON k.text = trim(m.text)", "keyed_units"))
def runtime_missing_fix(spark, d):
    u = V.keyed_units(spark, d)
    missing = u.where("turn % 2 = 0").select("conv_id", "turn", "identifier", F.concat(F.lit("  "), "what").alias("text"))
    known = u.where("conv_id % 3 = 0").select(F.col("what").alias("text")).distinct().withColumn("translation", F.when(F.length("text") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("k:"), F.left("text", F.lit(4)))))
    return relate.reuse(missing, known, "text").select("conv_id", "turn", "translation")


@query(V.sql("WITH p AS (SELECT DISTINCT identifier, 'old' AS v FROM keyed_units WHERE conv_id % 2 = 0) SELECT * FROM p UNION ALL SELECT DISTINCT identifier, 'new' FROM keyed_units WHERE conv_id % 3 = 0 AND identifier NOT IN (SELECT identifier FROM p)", "keyed_units"))
def merge_prior_fixes(spark, d):
    u = V.keyed_units(spark, d)
    one = lambda c, v: u.where(c).select("identifier").distinct().withColumn("v", F.lit(v))
    return relate.merge_prior(one("conv_id % 2 = 0", "old"), one("conv_id % 3 = 0", "new"), "identifier")


@query(V.sql("SELECT DISTINCT identifier FROM keyed_units WHERE identifier NOT IN (SELECT identifier FROM keyed_units WHERE conv_id % 3 = 1)", "keyed_units"))
def language_anti(spark, d):
    u = V.keyed_units(spark, d)
    tr = u.where("conv_id % 3 <> 0").withColumn("language", F.when(F.col("conv_id") % 3 == 1, "schinese").otherwise("english"))
    return relate.without_language(u.select("identifier").distinct(), tr, "identifier", "schinese")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT distinct_lang, n FROM (SELECT lang AS distinct_lang, count(*) AS n FROM documents GROUP BY lang)")
def list_languages(spark, d):
    return V.table(spark, d, "documents").groupBy(F.col("lang").alias("distinct_lang")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def probe_join_aggregate(spark, d):
    """A performance probe; not an operator of the domain."""
    return V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(V.sql("SELECT DISTINCT u.identifier, f.translation FROM (SELECT CASE WHEN conv_id % 2 = 0 THEN 'm' || identifier ELSE identifier END AS identifier FROM keyed_units) u JOIN fallback_tl f ON f.digest = right(u.identifier, 8) WHERE u.identifier NOT IN (SELECT identifier FROM existing_tl)", "keyed_units", "fallback_tl"))
def drifted_ids(spark, d):
    """Every other conversation got a new label; their lines keep the translations they have."""
    units = V.keyed_units(spark, d).withColumn("identifier", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("m"), "identifier")).otherwise(F.col("identifier")))
    return relate.drifted(units, V.existing_tl(spark, d))
