import os
import threading

import pytest
from pyspark.sql import functions as F

from textloom.functions import answers
from textloom.operators import classify, keys, mapper, progress
from textloom.sources import archives, catalog, sinks


def test_batches_shrink_where_answers_fail_and_grow_where_they_pass():
    sizes = []

    def client(texts):
        sizes.append(len(texts))
        return texts[:-1] if len(texts) > 10 else ["<" + t + ">" for t in texts]

    texts = [f"text {i}" for i in range(200)]
    assert mapper.translate(client, texts) == [f"<{t}>" for t in texts]
    assert sizes[0] == 40 and sizes.count(40) == 1  # never again that large
    assert max(sizes[3:]) <= 20


def test_bad_answers_are_asked_for_again_and_at_last_keep_their_source():
    seen = []

    def client(texts):
        seen.extend(texts)
        return ["" if "never" in t or ("later" in t and len(texts) > 1) else t.upper() for t in texts]

    assert mapper.translate(client, ["a", "never", "later", "b"]) == ["A", "never", "LATER", "B"]
    assert seen.count("a") == 1


def test_failed_requests_are_told_from_mistakes():
    def refused(texts):
        raise mapper.ClientError("no")

    def wrong(texts):
        return texts.missing

    asking = mapper.Asking(refused, tries=2)
    assert asking.all(["a", "b"], lambda t, x: True) == [None, None] and list(asking.errors) == ["no"]
    with pytest.raises(AttributeError):
        mapper.translate(wrong, ["a"])


def test_workers_keep_the_order_and_a_pause_keeps_the_sources():
    meet = threading.Barrier(2, timeout=20)

    def client(texts):
        meet.wait()  # passes only if two batches are under way
        return [t + "!" for t in texts]

    assert mapper.translate(client, [f"t{i}" for i in range(80)], workers=2) == [f"t{i}!" for i in range(80)]
    done = []
    got = mapper.translate(lambda ts: done.append(1) or [t + "!" for t in ts], [f"t{i}" for i in range(80)], paused=lambda: bool(done))
    assert got[:40] == [f"t{i}!" for i in range(40)] and got[40:] == [f"t{i}" for i in range(40, 80)]


def test_chat_client_changes_its_style():
    asked = []

    def send(messages):
        asked.append("@@" in messages[0]["content"])
        return "sorry" if asked[-1] else 'Here: ["A", "B"]'

    client = mapper.ChatClient(send, "French")
    assert client(["a", "b"]) == ["A", "B"] and client(["a", "b"]) == ["A", "B"]
    assert asked == [True, False, False]
    with pytest.raises(ValueError):
        mapper.ChatClient(send, "French", compact=False)(["a", "b"])
    assert "data" in mapper.messages(["x"], "French")[1]["content"] and mapper.messages(["é"], "French")[1]["content"].endswith('["é"]')


def test_names_must_stand_in_their_batch(spark):
    df = spark.createDataFrame([("Anna met Boris",), ("the door",), (None,), ("",)], "text string")
    got = mapper.found_names(df, "text", lambda batch: '["Anna", "Boris", "Carla", "door"]')
    assert sorted(r.name for r in got.collect()) == ["Anna", "Boris"]
    assert mapper.found_names(df, "text", lambda batch: "no list").count() == 0


def test_rounds_ask_once_for_what_was_answered(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def client(texts):
        for t in texts:
            with open(log / t, "a") as f:
                f.write("x")
        return [t + "!" if t == "a" else t for t in texts]

    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    got = mapper.in_rounds(df, "t", client, rounds=3).collect()
    assert sorted((r.t or "", r.translation or "", r.round) for r in got) == [("", "", 3), ("a", "a!", 1), ("b", "b", 3)]
    assert (log / "a").read_text() == "x" and (log / "b").read_text() == "xxx"


def test_files_have_their_names(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [("game/a b.rpy", "one\ntwo"), ("x=1.rpy", "译")]
    sinks.write_files(spark.createDataFrame(rows, "filename string, text string"), out)
    assert open(f"{out}/game/a b.rpy").read() == "one\ntwo\n" and open(f"{out}/x=1.rpy").read() == "译\n"
    sinks.write_files(spark.createDataFrame([("x=1.rpy", "new")], "filename string, text string"), out)
    assert open(f"{out}/x=1.rpy").read() == "new\n" and os.path.exists(f"{out}/game/a b.rpy")
    sinks.write_files(spark.createDataFrame([], "filename string, text string"), out)
    for bad in ("../up", "/root", "a/../b"):
        with pytest.raises(Exception, match="not to be written"):
            sinks.write_files(spark.createDataFrame([(bad, "x")], "filename string, text string"), out)
    with pytest.raises(Exception, match="not to be written"):
        sinks.write_files(spark.createDataFrame([("a", "x"), ("a", "y")], "filename string, text string"), out)


def test_report_without_rows_has_no_headers(spark):
    none = spark.createDataFrame([], "seq long, filename string, line int, text string")
    errors = spark.createDataFrame([(i, f"e{i % 30}") for i in range(90)], "seq long, message string")
    got = sinks.untranslated_report(none, none, errors).orderBy("part", "seq").collect()
    assert [r.report for r in got] == ["== 翻译错误详情（去重） =="] + [f"- e{i}" for i in range(20)]


def test_fix_blocks(spark):
    df = spark.createDataFrame([("id_1", "e", "Hi", "好"), ("id_2", "", 'a "b"', "译"), ("id_3", None, "x", "y")], "identifier string, who string, what string, translation string")
    got = [r.block for r in sinks.fix_blocks(df, "schinese").orderBy("identifier").collect()]
    assert got[0] == 'translate schinese id_1:\n\n    # e "Hi"\n    e "好"'
    assert got[1] == 'translate schinese id_2:\n\n    # "a \\"b\\""\n    "译"' and got[2] == 'translate schinese id_3:\n\n    # "x"\n    "y"'


def test_scan(spark):
    files = spark.createDataFrame([("game/a.rpy",), ("game/tl/Chinese/b.rpy",), ("game/tl/None/b.rpy",), ("x.rpa",)], "rel string")
    r = catalog.scan(files).first()
    assert (r.n_sources, r.n_compiled, r.languages, r.has_chinese, r.n_archives, r.from_archives, r.version, r.note) == (1, 0, ["Chinese"], True, 1, False, "unknown", None)
    r = catalog.scan(files.where("rel in ('x.rpa')")).first()
    assert r.from_archives and r.note is None and r.languages == []
    r = catalog.scan(files.where("rel = ''")).first()
    assert not r.from_archives and r.note == "no scripts"
    assert catalog.root_of(files.where("rel = ''")).count() == 0


def test_byte_counts(spark):
    df = spark.createDataFrame([("a", bytearray(b"aab\x00\xff")), ("b", None), ("c", bytearray())], "path string, content binary")
    got = {r.path: r.counts for r in archives.byte_counts(df).collect()}
    assert got["a"][97] == 2 and got["a"][0] == 1 and got["a"][255] == 1 and sum(got["a"]) == 5
    assert sum(got["b"]) == sum(got["c"]) == 0 and len(got["b"]) == 256


def test_state_of_paused_work(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for given, want in (("/a/b/", "/a/b"), ("\\a\\.\\b", "/a/b"), ("/a//b/.", "/a/b"), ("/", "/"), ("/a/././b", "/a/b")):
        assert one(progress.normal_path(F.lit(given))) == want
    files = spark.createDataFrame([("game/tl/.de.暂停标记.txt",), ("game/.fr.汉化进度.json",)], "rel string")
    assert progress.recoverable(files, "de").first().found and not progress.recoverable(files, "fr").first().found
    assert not progress.recoverable(files.limit(0), "de").first().found
    assert one(progress.follows(F.lit(0.0), F.lit(10.0))) and not one(progress.follows(F.lit(75.0), F.lit(100.0)))
    assert one(answers.same_model(F.lit("A:latest"), F.lit("a "))) and not one(answers.same_model(F.lit(""), F.lit("")))


def test_smoothing_is_the_recursion(spark):
    values = [(k, i, float((i * 7919 + k) % 101)) for k in range(3) for i in range(50 * k + 1)]
    got = {r.k: r.ema for r in progress.smoothed(spark.createDataFrame(values, "k int, i int, v double"), "k", "i", "v").collect()}
    for k in range(3):
        ema = None
        for kk, _, v in values:
            if kk == k:
                ema = v if ema is None else 0.7 * ema + 0.3 * v
        assert abs(got[k] - ema) < 1e-9


def test_audit_run(spark):
    rows = [(1, "The door is locked", "The door is locked", False), (2, "Hello", "這是", False), (3, "Hello", "好", False), (4, "The door is locked", "The door is locked", False)]
    done = classify.audit_run(spark.createDataFrame(rows, "seq int, original string, translation string, is_string boolean"), spark.createDataFrame([], "text string"), ["seq"])
    assert {r.category: r.n for r in done["counts"].collect()} == {"untranslated": 2, "traditional": 1}
    assert [r.translation for r in done["repaired"].collect()] == ["这是"]
    assert [(r.text, r.seq) for r in done["queued"].collect()] == [("The door is locked", 1)]


def test_first_and_last_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    for kept in (keys.keep_first(df, ["k"], ["id"]), keys.keep_last(df, ["k"], ["id"])):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2
