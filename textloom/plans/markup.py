"""Markup: stripping, tokens, protection and marked strings."""

from pyspark.sql import functions as F

from ..functions import protect as P, text as T
from . import views as V
from .registry import query

_NAMES = ["the", "Be", "und"]


@query(f"SELECT page_id, regexp_replace(regexp_replace(html, '{T.TAG}', ' ', 'g'), '{T.INSERT}', ' ', 'g') AS text FROM pages")
def strip_markup(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '@@p0@@ @@p1@@' WHEN 1 THEN '@@p0@@' ELSE '' END AS found, turn % 3 = 0 AS same FROM conversations")
def placeholder_sequence(spark, d):
    m = F.col("turn") % 3
    t = F.when(m == 0, F.concat(F.lit("@@p0@@ "), "text", F.lit(" @@p1@@"))).when(m == 1, F.concat(F.lit("@@p0@@"), "text")).otherwise(F.col("text"))
    found = T.tokens(t)
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, " ").alias("found"), (found == F.array(F.lit("@@p0@@"), F.lit("@@p1@@"))).alias("same"))


@query(V.sql("SELECT doc_id, text FROM marked", "marked"))
def protect_restore_roundtrip(spark, d):
    rows = V.marked(spark, d).withColumn("g", P.guarded(F.col("text"), _NAMES))
    return rows.select("doc_id", P.unguarded(F.col("g.text"), F.col("g.p"), F.col("g.n")).alias("text"))


@query(V.sql("SELECT doc_id, 2 + length(text) - length(replace(text, chr(10), '')) AS n_tokens FROM marked", "marked"))
def protect_counts(spark, d):
    rows = V.marked(spark, d).withColumn("p", P.protected(F.col("text")))
    return rows.select("doc_id", F.size(T.tokens(F.col("p.text"))).cast("long").alias("n_tokens"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1, 2")
def marked_strings(spark, d):
    found = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return V.table(spark, d, "pages").select("page_id", found.alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


_CORE = r"list_filter(regexp_extract_all(s, '[\p{L}\p{Nl}\p{No}]+(?:[''’][\p{L}\p{Nl}\p{No}]+)*'), lambda x: lower(x) NOT IN ('a', 'an', 'and', 'at', 'da', 'de', 'del', 'der', 'di', 'du', 'la', 'le', 'of', 'the', 'van', 'von'))"


@query(V.sql(f"SELECT doc_id, line, regexp_matches(s, '[぀-ヿ㐀-鿿豈-﫿가-힯]') OR len({_CORE}) > 0 AND len(list_filter({_CORE}, lambda x: NOT regexp_matches(x, '\\p{{Lu}}'))) = 0 AS proper FROM (SELECT doc_id, line, array_to_string(string_split(text, ' ')[1:3], ' ') AS s FROM doc_lines)", "doc_lines"))
def proper_name_spans(spark, d):
    span = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return V.doc_lines(spark, d).select("doc_id", "line", T.proper_name(span).alias("proper"))


@query("SELECT page_id, length(replace(h, '{', '')) = length(replace(h, '}', '')) AS balanced FROM (SELECT page_id, replace(replace(html, '{{', ''), '}}', '') AS h FROM pages)")
def braces_balanced(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.braces_balanced(F.col("html")).alias("balanced"))
