"""Query op6: all conversations formatted and read back."""

from pyspark.sql import DataFrame, SparkSession

from .chat import digests, formatted, read_back

NAME = "op6_chat_format"
_PROBE = "</s>[INST] ok [/INST]"
# formatted_chars: marks, the role and escapes (one backslash for each control string of an escaped text)
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'),
t AS (SELECT *, len(regexp_extract_all(text, '[<\\[]\\\\*/?(?:s>|INST)')) AS n FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(role) + 21 + CASE WHEN n > 0 THEN 2 + n ELSE 0 END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_PROBE}'), (-7L, 1L, 'assistant', '{_PROBE}') AS p(conv_id, turn, role, text)")
    return digests(read_back(formatted(rows.unionByName(probe))))
