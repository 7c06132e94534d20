"""Query op8: quality rules over all documents."""

from pyspark.sql import DataFrame, SparkSession

from .rules import CONFIDENCE, RISK, RULES, judged

NAME = "op8_quality_rules"
_BIN = "CASE WHEN {den} > 0 THEN least({most}, floor({num} * {scale} / {den})) ELSE 0 END"
_BINS = [_BIN.format(num=num, den=den, scale=scale, most=most) for _, num, den, scale, most in RULES]
_P = RISK / len(RULES)
# crc32 of the id decides the holdout; DuckDB has none, so it is folded bit by bit over the id's digits
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)))"""
ORACLE = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
  len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_unique, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_lines - n_unique AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
a AS (SELECT *, [{", ".join(_BINS)}]::INT[] AS bins FROM b),
h AS (SELECT lang, unnest(range({len(RULES)})) AS rule, unnest(bins) AS bin FROM a WHERE NOT base_failed AND xor({_CRC}, 4294967295::UBIGINT) % 5 <> 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT lang, rule, count(*) AS n, unnest(range(1, [{", ".join(str(r[4]) for r in RULES)}][rule + 1] + 1)) AS cut FROM h GROUP BY lang, rule),
q AS (SELECT k.lang, k.rule, k.cut, any_value(k.n) AS n, count(h.bin) AS k FROM k LEFT JOIN h ON h.lang = k.lang AND h.rule = k.rule AND h.bin >= k.cut GROUP BY 1, 2, 3),
p AS (SELECT *, CASE WHEN k < n * {_P} THEN list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n - i + 1) + i * ln({_P}) + (n - i) * ln({1 - _P})))) ELSE 1 END AS p FROM q),
c AS (SELECT lang, rule, min(cut) AS cut FROM p WHERE p <= {1 - CONFIDENCE} / ({len(RULES)} * (SELECT count(DISTINCT lang) FROM h)) GROUP BY lang, rule),
o AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, lang, unnest(range({len(RULES)})) AS rule, unnest(bins) AS bin FROM a) v JOIN c ON v.lang = c.lang AND v.rule = c.rule AND v.bin >= c.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM o) AS kept FROM a
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
