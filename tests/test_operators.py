from pyspark.sql import functions as F

from textloom.operators import classify, keys, mapper, relate, structure


def test_audit_has_every_category(spark):
    rows = [("The door is locked", "The door is locked", False, "untranslated"), ("SAVE", "SAVE", True, "untranslated"), ("SAVE", "SAVE", False, None), ("Hello you", "привет", False, "wrong_lang"), ("Hello", "Good morning all", False, "wrong_lang"), ("A b", "门 the door is locked", False, "mixed"), ("Hello", "這是", False, "traditional"), ("Hello", "这是", False, None), (" ", "x", False, None), ("已有 text", "text here", False, None)]
    df = spark.createDataFrame(rows, "original string, translation string, is_string boolean, want string")
    assert all(r.category == r.want for r in classify.audited(df).collect())
    kana = spark.createDataFrame([("Hello", "漢字", False), ("Hello", "かな", False)], "original string, translation string, is_string boolean")
    assert [r.category for r in classify.audited(kana, "japanese").orderBy("translation").collect()] == [None, "wrong_lang"]


def test_suffixes(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, 1, "x"), (2, 2, "x")], "file int, line int, root string")
    once = keys.suffixed(df, "root", ["line"], within=["file"])
    got = keys.suffixed_across(once, "key", "root", ["file", "line"], out="u").orderBy("file", "line").collect()
    assert [r.u for r in got] == ["x", "x_1", "x_2", "x_1_1"]


def test_coverage_quirk_and_strict(spark):
    units = spark.createDataFrame([("a_11111111",), ("b_22222222",), ("c_33333333_1",), ("d_44444444",)], "identifier string")
    existing = spark.createDataFrame([("z_11111111",), ("y_99999999_1",)], "identifier string")
    loose = {r.identifier: r.covered for r in relate.coverage(units, existing).collect()}
    strict = {r.identifier: r.covered for r in relate.coverage(units, existing, strict=True).collect()}
    assert loose == {"a_11111111": True, "b_22222222": False, "c_33333333_1": True, "d_44444444": False}
    assert strict == {"a_11111111": True, "b_22222222": False, "c_33333333_1": False, "d_44444444": False}


def test_digest_fallback_takes_the_first_key_with_its_last_value(spark):
    rows = [("a_00000001", "one", 1), ("b_00000001", "two", 2), ("a_00000001", "three", 3), ("c_x", "no", 4)]
    df = spark.createDataFrame(rows, "identifier string, translation string, seq long")
    assert [tuple(r) for r in relate.digest_fallback(df).collect()] == [("00000001", "three")]


def test_packing_example(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([500, 500, 500, 1300, 10])] + [(2, i, 1) for i in range(41)], "k int, i int, s int")
    got = structure.packed_chunks(df, "k", ["i"], "s").orderBy("k", "i").collect()
    assert [r.chunk for r in got if r.k == 1] == [0, 0, 1, 2, 3] and [r.chunk for r in got if r.k == 2] == [0] * 40 + [1]


def test_scopes(spark):
    names = ["a", None, ".s", "a.b", ".s", "_hidden", "c"]
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "f int, line int, opens string")
    assert [r.scope for r in structure.scope_carry(df, "f", ["line"], "opens").orderBy("line").collect()] == ["a", "a", "a.s", "a.b", "a.s", "a.s", "c"]


def test_mapper_recovers_from_bad_answers():
    calls = []

    def client(texts):
        calls.append(len(texts))
        if len(texts) > 1:
            raise ValueError("too many")
        return ["<" + texts[0] + ">"] if texts[0] != "bad" else ["@@p9@@"]

    assert mapper.translate(client, ["a [x]", " ", "bad", "c"], tries=1) == ["<a [x]>", " ", "bad", "<c>"]
    assert max(calls) == 3 and calls.count(1) >= 3
    assert [len(b) for b in mapper.batches(["x"] * 41)] == [40, 1]


def test_queue_append(spark):
    queue = spark.createDataFrame([("old",)], "text string")
    found = spark.createDataFrame([(1, " new ", "mixed"), (2, "new", "mixed"), (3, "old", "mixed"), (4, " ", "mixed"), (5, "t", "traditional")], "seq int, text string, category string")
    assert [(r.text, r.seq) for r in relate.append_queue(queue, found, "text", ["seq"]).collect()] == [("new", 1)]


def test_cache_migration(spark):
    cache = spark.createDataFrame([("a", "1"), ("b", "2")], "text string, translation string")
    texts = spark.createDataFrame([("a",)], "text string")
    assert relate.migrate_cache(cache, texts, "text", same_print=True).count() == 2
    for same, n in ((True, 2), (False, 1)):
        flag = spark.createDataFrame([(same,)], "same boolean")
        assert relate.migrate_cache(cache, texts, "text", same_print=flag).count() == n
    assert relate.need_work(texts, spark.createDataFrame([("a", "a")], "text string, translation string"), "text").count() == 1


def test_deduped_blocks(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["pre", "## a", "x", "## b", "y", "## a", "z"])], "k int, line int, text string")
    assert [r.text for r in structure.deduped_blocks(df, "k", "^## .*").orderBy("line").collect()] == ["pre", "## a", "x", "## b", "y"]


def test_overlay_and_precedence(spark):
    df = spark.createDataFrame([("A", 1), ("a", 2), ("b", 1)], "name string, rank int")
    assert sorted((r.name, r.rank) for r in relate.overlay(df, "name", ["rank"]).collect()) == [("a", 2), ("b", 1)]
    c, s = spark.createDataFrame([("X",)], "stem string"), spark.createDataFrame([("x",), ("y",)], "stem string")
    assert sorted((r.stem, r.kind) for r in relate.source_precedence(c, s, "stem").collect()) == [("X", "compiled"), ("y", "source")]
    assert classify.mode_vote(spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "a", 4), (1, "b", 3)], "k int, c string, s int"), "k", "c", "s").first().c == "b"
    assert keys.fingerprint(df.withColumn("t", F.col("name")), "rank", "t").count() == 1
