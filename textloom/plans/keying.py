"""Codes, digests, identifiers, suffixes and fingerprints."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keys
from . import views as V
from .registry import query

_CODE = f"who || ' ' || {V.encoded('what')}"


@query(V.sql(f"SELECT conv_id, turn, {_CODE} AS code FROM say_units", "say_units"))
def say_code(spark, d):
    return V.say_units(spark, d).select("conv_id", "turn", keys.say_code(F.col("who"), F.col("what")).alias("code"))


@query(V.sql(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN who || ' happy @ -sad ' || {V.encoded('what')} || ' nointeract id x1 (a=1) with fade' ELSE {V.encoded('what')} END AS code FROM say_units", "say_units"))
def say_code_full(spark, d):
    even = F.col("turn") % 2 == 0
    opt = lambda x: F.when(even, F.lit(x))
    code = keys.say_code(F.when(even, F.col("who")), F.col("what"), attributes=F.when(even, F.array(F.lit("happy"))), temporary=F.when(even, F.array(F.lit("-sad"))), interact=~even, explicit_id=opt("x1"), arguments=opt("(a=1)"), with_expr=opt("fade"))
    return V.say_units(spark, d).select("conv_id", "turn", code.alias("code"))


@query(V.sql("SELECT conv_id, turn, right(identifier, 8) AS digest, identifier FROM keyed_units", "keyed_units"))
def say_identifier(spark, d):
    code = keys.say_code(F.col("who"), F.col("what"))
    return V.say_units(spark, d).select("conv_id", "turn", keys.digest(code).alias("digest"), keys.identifier(F.col("label"), code).alias("identifier"))


_SUFFIX = """SELECT doc_id, line, CASE WHEN k = 1 THEN d ELSE d || '_' || (k - 1) END AS key FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, d ORDER BY line) AS k FROM (SELECT doc_id, line, left(md5(text), 2) AS d FROM doc_lines)) WHERE line % 2 = 1"""


@query(V.sql(_SUFFIX, "doc_lines"))
def id_suffix(spark, d):
    lines = V.doc_lines(spark, d).select("doc_id", "line", F.left(F.md5(F.col("text").cast("binary")), F.lit(2)).alias("d"))
    return keys.suffixed(lines, "d", ["line"], within=["doc_id"]).where("line % 2 = 1").select("doc_id", "line", "key")


@query()
def id_suffix_cross_file(spark, d):
    lines = V.doc_lines(spark, d).select("doc_id", "line", F.left(F.md5(F.col("text").cast("binary")), F.lit(6)).alias("root"))
    once = keys.suffixed(lines, "root", ["line"], within=["doc_id"])
    return keys.suffixed_across(once, "key", "root", ["doc_id", "line"], out="unique_key").select("doc_id", "line", "key", "unique_key")


@query(V.sql("SELECT identifier, min(conv_id * 1000 + turn) AS seq FROM keyed_units GROUP BY identifier", "keyed_units"))
def keep_first_id(spark, d):
    u = V.keyed_units(spark, d).withColumn("seq", F.col("conv_id") * 1000 + F.col("turn"))
    return keys.keep_first(u, ["identifier"], ["seq"]).select("identifier", "seq")


@query("SELECT text, min(doc_id) AS first_seq, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS places FROM documents GROUP BY text")
def distinct_text_groups(spark, d):
    g = keys.inverted_index(V.table(spark, d, "documents"), "text", "doc_id")
    return g.withColumn("places", F.array_join(F.transform("places", lambda x: x.cast("string")), ","))


@query(V.sql("SELECT text, part, id, line FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY part, id, line) AS k FROM string_units) WHERE k = 1", "string_units"))
def string_first_file(spark, d):
    return keys.keep_first(V.string_units(spark, d), ["text"], ["part", "id", "line"]).select("text", "part", "id", "line")


@query("SELECT md5(string_agg(upper(md5('d:' || text || chr(0))), '' ORDER BY doc_id)) AS fingerprint FROM documents")
def corpus_fingerprint(spark, d):
    return keys.fingerprint(V.table(spark, d, "documents"), "doc_id", "text")


@query(V.sql("SELECT text, arg_max(line, doc_id * 100000 + line) AS line, min(doc_id * 100000 + line) AS first_seq FROM doc_lines GROUP BY text", "doc_lines"))
def last_wins_map(spark, d):
    lines = V.doc_lines(spark, d).withColumn("seq", F.col("doc_id") * 100000 + F.col("line"))
    return keys.last_wins(lines, "text", "line", "seq")


@query("SELECT doc_id, text FROM documents")
def escape_roundtrip(spark, d):
    quoted = T.encode_say(F.col("text"))
    inner = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    rows = V.table(spark, d, "documents").select("doc_id", T.decode_say(inner).alias("a"), T.decode_quoted(quoted).alias("b"), T.unescape_report(T.escape_report(F.col("text"))).alias("c"))
    return rows.select("doc_id", F.when((F.col("a") == F.col("b")) & (F.col("b") == F.col("c")), F.col("a")).alias("text"))
