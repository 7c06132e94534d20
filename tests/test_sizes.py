"""What grows with the rows of one key, file or batch."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import protect
from textloom.operators import keys, mapper
from textloom.sources import readers, sinks
from textloom.streaming import incremental


def greedy(rows):
    used, made = set(), []
    for k in rows:
        name, i = k, 0
        while name in used:
            i += 1
            name = f"{k}_{i}"
        used.add(name)
        made.append(name)
    return made


def test_free_names_are_the_greedy_ones():
    rng = random.Random(5)
    pool = ["a", "a_1", "a_2", "a_3", "a_7", "a_1_1", "a_1_2", "a_01", "a_0", "a_", "_1", "", "a_x", "a_²"]
    for n in range(400):
        rows = [rng.choice(pool) for _ in range(n % 40)]
        free = keys._Free()
        assert [free(k) for k in rows] == greedy(rows)


def test_a_hot_key_is_suffixed_in_linear_time(spark):
    n = 60_000
    df = spark.range(n).selectExpr("id", "'r' root", "if(id % 3 = 2, 'r_1', 'r') key")
    start = time.time()
    got = {r.id: r.unique for r in keys.suffixed_across(df, "key", "root", ["id"], out="unique").collect()}
    assert time.time() - start < 60  # each row tried every suffix before
    assert len(set(got.values())) == n
    assert [got[i] for i in range(6)] == ["r", "r_1", "r_1_1", "r_2", "r_3", "r_1_2"] and got[n - 2] == f"r_{2 * n // 3 - 1}"


def test_files_in_pieces_hold_what_whole_ones_do(spark):
    units = spark.createDataFrame([("a.rpy", 1, 1, "i1", "e", "Hi", "H"), ("a.rpy", 2, 2, "i2", "", "No", "N"), ("b.rpy", 1, 3, "i1", "e", "Hi", "H")], "filename string, line int, seq long, identifier string, who string, what string, translation string")
    strings = spark.createDataFrame([("a.rpy", 5, 9, 'x "y"', "X"), ("a.rpy", 6, 8, "z", "Z"), ("c.rpy", 1, 1, "w", "W"), ("c.rpy", 2, 2, "v", None), ("a.rpy", 7, 7, "z", "Y")], "filename string, line int, seq long, text string, translation string")
    cut = sinks.pieces(units, strings, "zh")
    whole = {r.filename: r.text for r in sinks.rendered(units, strings, "zh").collect()}
    want = {}
    for r in sorted(cut.collect(), key=lambda r: (r.part, r.seq)):
        head = f"{r.head}\n\n" if r.head and r.head not in want.get(r.filename, "") else ""
        want[r.filename] = (want[r.filename] + "\n\n" if r.filename in want else "") + head + r.text
    assert whole == want and "c.rpy" in want and '    old "v"' not in want["c.rpy"]
    files = spark.createDataFrame(list(whole.items()), "path string, text string")
    parts = cut.select(F.col("filename").alias("path"), F.struct("part", "seq").alias("piece"), "head", "text")
    for read, gone in ((readers.string_rows, []), (readers.dialogue_rows, ["original"])):
        rows = lambda f: sorted(repr(r) for r in read(f).drop("n", "piece", *gone).collect())  # noqa: B023, E731
        assert rows(files) == rows(parts) and rows(files)


def test_an_old_line_serves_its_own_block_only(spark):
    text = 'translate zh strings:\n    old "a"\ntranslate zh strings:\n    new "b"\n    old "c"\n    new "d"\n'
    got = readers.string_rows(spark.createDataFrame([("p", text)], "path string, text string")).collect()
    assert [(r.n, r.original, r.translation) for r in got] == [(6, "c", "d")]


def test_no_file_of_strings_is_gathered(spark):
    from textloom.plans import registry

    plan = registry.QUERIES["string_blocks_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def documents(spark, monkeypatch, rows, shuffled=False):
    """rows (doc_id, text) as the table of documents, if asked in another order each time they are read."""
    from textloom.plans import views

    def shuffle(frames):
        for frame in frames:
            yield frame.sample(frac=1)

    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(views, "table", lambda s, d, name: df.mapInPandas(shuffle, df.schema) if shuffled else df)


def test_archives_are_the_same_whenever_they_are_made(spark, monkeypatch):
    import hashlib

    from textloom.plans import registry

    rows = [(i, f"text {i}" * (i % 9)) for i in range(200)] + [(5, "another"), (5, None), (-3, "below"), (7, "text 7" * 7)]
    documents(spark, monkeypatch, rows, shuffled=True)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = registry.QUERIES["archive_entries"](spark, "").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    want = [(i, t if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_progress_with_long_texts(spark, monkeypatch):
    from textloom.plans import registry

    rows = [(1, "x" * 60_000), (2, 'a "quoted"\n\\text'), (3, "é中\x01"), (4, ""), (300, "x" * 60_000), (301, "y")]
    documents(spark, monkeypatch, rows)
    got = registry.QUERIES["progress_reader"](spark, "").collect()
    assert sorted((r.text, r.translation) for r in got) == sorted({(t, "t:" + t[:4]) for _, t in rows})


def test_progress_of_odd_files(spark):
    texts = ["", "[]", "nul", '{"dialogues": {"a": "b"}', '{"dialogues": 5, "strings": {"k": null, "n": 1.50, "h": "\\ud800", "i": 7, "b": true, "o": {"x": [1, "é"]}}}', '{"__fp__": "f", "dialogues": {"a": "b"}, "strings": null}']
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, None])], "path string, text string")
    got = sorted(tuple(r) for r in readers.progress(files).collect())
    assert [r[1:] for r in got if r[0] == "5"] == [("f", "dialogue", "a", "b")]
    assert {r[3]: r[4] for r in got if r[0] == "4"} == {"k": None, "n": "1.5", "h": "?", "i": "7", "b": "true", "o": '{"x":[1,"é"]}'}
    assert {r[0] for r in got} == {"4", "5"}

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_protection_takes_batches_of_bounded_bytes(spark):
    spark.conf.unset(SETTING)
    df = spark.createDataFrame([("a [b] {c}\n@@p0@@",), (None,), ("",)], "t string").withColumn("p", protect.protected(F.col("t")))
    rows = df.select("t", "p", protect.restored(F.col("p.text"), F.col("p.held")).alias("u"), protect.keeps_tokens(F.col("t"), F.col("t")).alias("k")).collect()
    assert spark.conf.get(SETTING, None) == "4m"
    assert [r.u for r in rows] == [r.t for r in rows] and [r.k for r in rows] == [True, None, True]
    assert rows[0].p.text == "a @@p1@@ @@p2@@@@p3@@@@p0@@" and rows[0].p.held == {1: "[b]", 2: "{c}", 3: "\n"} and rows[1].p is None


def test_protection_and_restoring_take_one_worker_each(spark):
    from textloom.plans import registry

    df = registry.QUERIES["protect_restore_roundtrip"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    texts = [("the [the] {b}\nBe @@n0@@ @@p1@@ und",), (None,), ("",)]
    g = spark.createDataFrame(texts, "t string").withColumn("g", protect.guarded(F.col("t"), ["the", "Be", "und"]))
    got = g.select("g", protect.unguarded(F.col("g.text"), F.col("g.p"), F.col("g.n")).alias("u")).collect()
    assert [(r.u,) for r in got] == texts and got[0].g.n == {1: "the", 2: "the", 3: "und", 4: "Be"}


def test_batches_of_bytes_share_what_their_task_knows(spark, tmp_path):
    log = tmp_path / "sizes"
    log.mkdir()

    def client(texts):
        import uuid

        (log / f"{len(texts)}-{uuid.uuid4().hex}").touch()
        return texts[:-1] if len(texts) > 25 else [t + "!" for t in texts]

    spark.conf.unset(SETTING)
    df = spark.range(4000).select(F.format_string("text of row number %d", "id").alias("t"))
    mapper.map_distinct(df, "t", client)
    assert spark.conf.get(SETTING, None) == "4m"
    spark.conf.set(SETTING, "4k")
    try:
        got = mapper.map_distinct(df, "t", client).collect()
    finally:
        spark.conf.unset(SETTING)
    assert len(got) == 4000 and all(r.translation == r.t + "!" for r in got)
    # four tasks of the suite's session; each frame of a task asked for 40 again before
    assert 1 <= sum(p.name.startswith("40-") for p in log.iterdir()) <= 4


def shuffled_bytes(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_a_refresh_moves_its_batches_and_not_its_table(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(incremental, "SENT_ROWS", sent)
    source, rng, n = str(tmp_path / "in"), random.Random(3), 12
    text = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3000))
    again, rows = text(), []
    for k in range(n):
        own = [(k, t) for t in [*(text() for _ in range(100)), again, again, None, ""]]
        rows += own
        spark.createDataFrame(own, "k int, text string").coalesce(1).write.mode("append").parquet(source)
    before = shuffled_bytes(spark)
    done = incremental.refresh(spark, source, "k int, text string", f"{tmp_path}/out", f"{tmp_path}/state", "text", lambda new: new)
    assert done.select("batch_id").distinct().count() == n
    moved = shuffled_bytes(spark) - before
    assert sorted(map(repr, (r.text for r in done.collect()))) == sorted(map(repr, {t for _, t in rows}))
    if sent:
        assert moved < 2 * sum(len(t or "") for _, t in rows)
