"""Query op9: all pages through WARC archives."""

from pyspark.sql import DataFrame, SparkSession

from .warc import round_trip

NAME = "op9_warc"
_GROUP = "to_base(('0x' || substr(s, {}, 10))::BIGINT, 32, 8)"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  translate({" || ".join(_GROUP.format(1 + 10 * k) for k in range(4))}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM d
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
