import base64
import hashlib
import random

from textloom.llm.warc import candidates, read_archive, round_trip, write_archive

PAGES = "page_id long, url string, html string, payload_digest string, file string"
FAKE = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nnot a header"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


def want(rows, least=0):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    heads = {}
    for i, b in body:
        if i is not None:
            heads[b] = max(i, heads.get(b, i))
    out = []
    for i, b in body:
        head = heads.get(b)
        again = len(b) >= least and head is not None and i != head
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", head if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [(0, "http://a/", "x"), (1, None, "x"), (2, "u", None), (3, "u\r\nX: y", ""), (4, "u", FAKE), (5, "u", FAKE * 3), (6, "u", "ends\r\n"), (7, "u", "\r\n\r\n"), (8, "u", "é漢\U0001f600"), (9, "u", "WARC/1.1\r\n"), (10, "u", "y" * 300_000), (11, "u", "\r\n\r\nWARC/1.1\r\n"), (12, "u", "x"), (13, "u", "ab\r\n\r\nWARC/1.1"), (14, "u", "\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\nq"), (15, "u", "\r\n")]


def test_round_trip(spark):
    assert got(round_trip(table(spark, ROWS))) == want(ROWS)
    assert all(r.verified is not False for r in round_trip(table(spark, ROWS)).collect())


def test_small_payloads_are_all_responses(spark):
    assert got(round_trip(table(spark, ROWS), least_bytes=2)) == want(ROWS, 2)


def test_null_and_repeated_rows(spark):
    rows = [(None, "u", "same"), (5, "u", "same"), (5, "u", "same"), (4, "u", "same"), (None, "u", "lone")]
    assert got(round_trip(table(spark, rows))) == want(rows)
    assert got(round_trip(table(spark, []))) == []


def test_chains_cross_splits_and_reject_false_candidates(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, "u", "".join(r.choice(["text ", FAKE, "\r\n\r\n", "WARC/1.1\r\n", "\r\n", "WARC/1.1"]) for _ in range(r.randint(0, 30)))) for i in range(300)]
    path = str(tmp_path / "w")
    write_archive(table(spark, rows).coalesce(2), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        found = candidates(spark, path)
        assert found.select("file", "block").distinct().count() >= 8
        assert found.count() > 300
        assert got(read_archive(spark, path)) == want(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_verification_does_not_depend_on_batches(spark):
    expected = {i for i, kind in ((r[0], r[3]) for r in want(ROWS)) if kind == "response"}
    for setting, value in (("maxRecordsPerBatch", "1"), ("maxRecordsPerBatch", "3"), ("maxRecordsPerBatch", "10000")):
        spark.conf.set(f"spark.sql.execution.arrow.{setting}", value)
        try:
            rows = round_trip(table(spark, ROWS).coalesce(1)).collect()
        finally:
            spark.conf.unset(f"spark.sql.execution.arrow.{setting}")
        assert {r.page_id for r in rows if r.verified} == expected
        assert all(r.verified is None for r in rows if r.record_type == "revisit")
