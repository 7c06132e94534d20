"""Text functions and protection rules over the tables, with SQL that states their values itself."""

from pyspark.sql import functions as F

from ..functions import answers, protect as P, text as T
from ..sources import scripts
from . import views as V
from .registry import query

# backslashes are plain characters in this SQL
_QUOTED = r"""CASE turn % 4 WHEN 0 THEN '  "' || text || '\n \\n \" \x" ' WHEN 1 THEN '''' || text || '\ y''' WHEN 2 THEN '"' || text ELSE text END"""
_UNESCAPED = r"""replace(replace(replace(replace(replace(substr(s, 2, length(s) - 2), '\\', chr(1)), '\n', chr(10)), '\"', '"'), '\ ', ' '), chr(1), '\')"""


def _quoted():
    m, text = F.col("turn") % 4, F.col("text")
    return F.when(m == 0, F.concat(F.lit('  "'), text, F.lit('\\n \\\\n \\" \\x" '))).when(m == 1, F.concat(F.lit("'"), text, F.lit("\\ y'"))).when(m == 2, F.concat(F.lit('"'), text)).otherwise(text)


@query(f"""SELECT conv_id, turn, CASE WHEN length(s) >= 2 AND left(s, 1) = right(s, 1) AND left(s, 1) IN ('"', '''') THEN {_UNESCAPED} ELSE s END AS text
 FROM (SELECT conv_id, turn, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT conv_id, turn, {_QUOTED} AS q FROM conversations))""")
def quoted_decode(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.decode_quoted(_quoted()).alias("text"))


_COMMENTED = """CASE turn % 4 WHEN 0 THEN text || ' # note' WHEN 1 THEN '"#' || text || '" # "x' WHEN 2 THEN 'a ''#'' ' || text || '#' ELSE text END"""


@query(f"""SELECT conv_id, turn, regexp_extract(s, '^((?:[^#"'']|"(?:\\\\.|[^"\\\\])*"|''(?:\\\\.|[^''\\\\])*'')*)', 1) AS code FROM (SELECT conv_id, turn, {_COMMENTED} AS s FROM conversations)""")
def comment_strip(spark, d):
    m, text = F.col("turn") % 4, F.col("text")
    line = F.when(m == 0, F.concat(text, F.lit(" # note"))).when(m == 1, F.concat(F.lit('"#'), text, F.lit('" # "x'))).when(m == 2, F.concat(F.lit("a '#' "), text, F.lit("#"))).otherwise(text)
    return V.table(spark, d, "conversations").select("conv_id", "turn", T.strip_comment(line).alias("code"))


_FOLDER = "CASE doc_id % 6 WHEN 0 THEN 'Simplified' WHEN 1 THEN 'zh_CN' WHEN 2 THEN 'tchinese' WHEN 3 THEN 'ZH-Hans' WHEN 4 THEN lang ELSE source END"


@query(f"SELECT doc_id, folder, lower(folder) IN ('chinese', 'chinese_simplified', 'simplifiedchinese', 'simplified_chinese', 'zh', 'zh_cn', 'zh-hans', 'zh_hans', 'zhs', 'schinese', 'simplified') AS is_chinese FROM (SELECT doc_id, {_FOLDER} AS folder FROM documents)")
def chinese_folders(spark, d):
    m = F.col("doc_id") % 6
    folder = F.when(m == 0, "Simplified").when(m == 1, "zh_CN").when(m == 2, "tchinese").when(m == 3, "ZH-Hans").when(m == 4, F.col("lang")).otherwise(F.col("source"))
    return V.table(spark, d, "documents").select("doc_id", folder.alias("folder")).withColumn("is_chinese", T.is_chinese(F.col("folder")))


_TARGET = "CASE turn % 3 WHEN 0 THEN 'SChinese（简体中文）' WHEN 1 THEN 'Chinese (Simplified)' ELSE 'TChinese（繁體中文）' END"


@query(V.sql(f"SELECT conv_id, turn, CASE WHEN contains(t, '简体') OR contains(lower(t), 'simplified') THEN replace(replace(s, '這', '这'), '說', '说') ELSE s END AS text FROM (SELECT conv_id, turn, {_TARGET} AS t, '這說' || left(original, 20) AS s FROM tl_entries)", "tl_entries"))
def script_of_target(spark, d):
    m = F.col("turn") % 3
    target = F.when(m == 0, "SChinese（简体中文）").when(m == 1, "Chinese (Simplified)").otherwise("TChinese（繁體中文）")
    return V.tl_entries(spark, d).select("conv_id", "turn", T.normalise_script(F.concat(F.lit("這說"), F.left("original", F.lit(20))), target).alias("text"))


# how a reply treats its two tokens: as they were, in another order, one lost, one doubled, glued to a letter
_REPLY = """CASE turn % 5 WHEN 0 THEN '@@p0@@ ' || text || ' @@n1@@' WHEN 1 THEN '@@n1@@ ' || text || ' @@p0@@' WHEN 2 THEN '@@p0@@ ' || text WHEN 3 THEN '@@p0@@ @@p0@@ ' || text || ' @@n1@@' ELSE 'x@@p0@@ ' || text || ' @@n1@@' END"""


@query(f"SELECT conv_id, turn, regexp_extract_all(r, '@@[pn][0-9]+@@') = ['@@p0@@', '@@n1@@'] AND NOT regexp_matches(r, '[A-Za-z0-9]@@p0@@|@@p0@@[A-Za-z0-9]|[A-Za-z0-9]@@n1@@|@@n1@@[A-Za-z0-9]') AS preserved FROM (SELECT conv_id, turn, {_REPLY} AS r FROM conversations)")
def placeholders_preserved(spark, d):
    m, text = F.col("turn") % 5, F.col("text")
    p, n = F.lit("@@p0@@ "), F.lit(" @@n1@@")
    reply = F.when(m == 0, F.concat(p, text, n)).when(m == 1, F.concat(F.lit("@@n1@@ "), text, F.lit(" @@p0@@"))).when(m == 2, F.concat(p, text)).when(m == 3, F.concat(p, p, text, n)).otherwise(F.concat(F.lit("x"), p, text, n))
    source = F.concat(p, text, n)
    return V.table(spark, d, "conversations").select("conv_id", "turn", P.keeps_tokens(source, reply).alias("preserved"))


@query("""SELECT source, string_agg(lang, ',' ORDER BY first) AS names FROM (SELECT source, lang, min(doc_id) AS first FROM documents GROUP BY source, lang) GROUP BY source""")
def name_lists(spark, d):
    """Replies that list languages by document, fenced and nested, back to each name once."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "lang"))), lambda x: x["lang"])
    reply = F.concat(F.lit('```json\n{"names": ['), F.array_join(F.transform(ordered, lambda x: F.concat(F.lit('["'), x, F.lit(' "]'))), ", "), F.lit("]}\n```"))
    replies = V.table(spark, d, "documents").groupBy("source").agg(reply.alias("reply"))
    return replies.select("source", F.array_join(answers.names_listed(F.col("reply")), ",").alias("names"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN -2 ELSE 0 END + CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS balance FROM conversations")
def paren_balance(spark, d):
    m = F.col("turn") % 4
    line = F.when(m == 0, "call(a, (b)").when(m == 1, 'x = ")("').when(m == 2, "))").otherwise("f(g())")
    line = F.concat(F.when(F.col("turn") % 3 == 0, "(").otherwise(""), line, F.lit(" # ("))
    return V.table(spark, d, "conversations").select("conv_id", "turn", scripts.balances(line).alias("balance"))
