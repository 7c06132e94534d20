import pickle
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.plans.stateful import archive
from textloom.sources import archives, readers, scripts, sinks
from textloom.streaming import incremental, switch

SCRIPT = '''\
define e = Character("Eileen", color="#fff")
default title = "A title"
default path = "gui/a.png"
label start:
    e happy @ -sad "Hello [name]!" nointeract with fade  # note
    "Narration" "more"
    "Guest" "I am here." id x1 (a=(1, 2))
    $ x = _("marked")
    call other from back_here
    e "After call"
    play music "x.ogg"
label .sub:
    e """Three
lines # kept
here"""
    e "next"
label _hidden:
    e "still sub"
label gone hide:
    e "same"
menu pick:
    "Choose"
    "Yes":
        e "In choice"
    "No" if cond:
        pass
screen s():
    text "On screen"
    imagebutton tooltip "Tip"
    e "not said"
python:
    e = "code"
init python:
    z = "code"
style x:
    color "#000"
'''


def parsed(**kw):
    return scripts.units_of("f", SCRIPT, **kw)


def test_extraction():
    said = [(r["label"], r["who"], r["text"]) for r in parsed() if r["kind"] == "say"]
    assert said == [
        ("start", "e", "Hello [name]!"), ("start", None, "Narration"[:0] + "more") if False else ("start", '"Narration"', "more"), ("start", '"Guest"', "I am here."),
        ("back_here", "e", "After call"), ("back_here.sub", "e", "Three\nlines # kept\nhere"), ("back_here.sub", "e", "next"), ("back_here.sub", "e", "still sub"), ("back_here.sub", "e", "same"),
        ("pick", None, "Choose"), ("pick", "e", "In choice"),
    ]
    first = next(r for r in parsed() if r["kind"] == "say")
    assert (first["attributes"], first["temporary_attributes"], first["interact"], first["with_expr"]) == (["happy"], ["-sad"], False, "fade")
    strings = [(r["text"], r["context"]) for r in parsed() if r["kind"] == "string"]
    assert strings == [("Eileen", "character"), ("A title", "define"), ("gui/a.png", "define"), ("Yes", "menu"), ("No", "menu"), ("On screen", "screen"), ("Tip", "screen"), ("marked", "_()")]


def test_compat_extraction():
    rows = parsed(compat=True)
    assert "Yes" not in [r["text"] for r in rows] and ("No", "say") in [(r["text"], r["kind"]) for r in rows]
    assert "next" not in [r["text"] for r in rows]


def test_files_to_units(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿" + SCRIPT, encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_text("")
    files = scripts.read_scripts(spark, str(tmp_path), "*.txt")
    rows = scripts.extracted(files).collect()
    assert len(rows) == len(parsed()) and rows[0].text == "Eileen"


TL = '''﻿# src.txt:3
translate zh start_1:

    # e "Hello  \\"you\\""
    e "你好\\n \\ x"

translate zh start_1:

    e "second"

translate fr start_2:

    e "non"

translate zh strings:

    # x:1
    old "Save"
    new "保存"

    old "Load"
    old "Quit"
    new "退出"
'''


@pytest.fixture
def tl(spark):
    return spark.createDataFrame([("b", TL), ("a", "translate zh start_1:\n    e \"early\"\n")], "path string, text string")


def test_translation_files(spark, tl):
    rows = {(r.path, r.n): r for r in readers.dialogue_rows(tl).collect()}
    assert rows[("b", 5)].translation == "你好\n  x" and rows[("b", 5)].original == 'Hello  "you"' and rows[("b", 5)].who == "e"
    zh = readers.dialogue_rows(tl).where("language = 'zh'")
    assert {r.identifier: r.translation for r in readers.last_by(zh, "identifier").collect()} == {"start_1": "second"}
    assert {r.original: r.translation for r in readers.string_rows(tl).collect()} == {"Save": "保存", "Quit": "退出"}


def test_reports(spark):
    untranslated = "== 对话 ==\na.txt:3  Hello\\nyou\nno match\nb:x:12   C\\\\d\n"
    audit = "== t（n 条）==\n[f:1] [e]\n  原文: One\nline two\n  译文: 一\n[f:2]\n  原文: Two\n  译文: 二\n"
    files = spark.createDataFrame([("u", untranslated), ("a", audit), ("n", "nothing")], "path string, text string")
    got = sorted((r.path, r.kind, r.text) for r in readers.any_report(files).collect())
    assert got == [("a", "audit", "One\nline two"), ("a", "audit", "Two"), ("u", "untranslated", "C\\d"), ("u", "untranslated", "Hello\nyou")]
    missing = "a\nb\nc\nf.txt:7\t[e]\thi\\nyou\tid_1\t\nf:x\t[]\ta\tb\tid_2\tSay\nshort\trow\n"
    rows = readers.missing_report(spark.createDataFrame([("m", missing)], "path string, text string")).orderBy("n").collect()
    assert [(r.filename, r.line, r.who, r.what, r.identifier, r.node_type) for r in rows] == [("f.txt", 7, "e", "hi\nyou", "id_1", "TranslateSay"), ("f", 0, "", "a\tb", "id_2", "Say")]
    kv = readers.key_values(spark.createDataFrame([("k", "a: 1\nb:2: 3\na: 4")], "path string, text string"))
    assert {r.key: r.value for r in kv.collect()} == {"a": "4", "b": "2: 3"}
    good, bad = '{"__fp__":"f","dialogues":{"a":"b"},"strings":{"c":"d"}}', "{broken"
    rows = readers.progress(spark.createDataFrame([("p", good), ("q", bad)], "path string, text string")).collect()
    assert sorted((r.path, r.kind, r.text, r.translation) for r in rows if r.text) == [("p", "dialogue", "a", "b"), ("p", "string", "c", "d")]


def test_render_and_repair(spark, tmp_path):
    units = spark.createDataFrame([("game/x.txt", 3, 1, "id_1", "e", "Hi", "嗨"), ("game/x.txt", 4, 2, "id_1", "e", "Hi", "again"), ("game/x.txt", 5, 3, "id_2", None, "No", None)], "filename string, line int, seq long, identifier string, who string, what string, translation string")
    strings = spark.createDataFrame([("game/x.txt", 9, 1, "Save", "保存"), ("game/y.txt", 1, 1, "Save", "其他")], "filename string, line int, seq long, text string, translation string")
    out = {r.filename: r.text for r in sinks.rendered(units, strings, "zh").collect()}
    assert out == {"game/x.txt": '# x.txt:3\ntranslate zh id_1:\n\n    # e "Hi"\n    e "嗨"\n\ntranslate zh strings:\n\n    # x.txt:9\n    old "Save"\n    new "保存"'}
    lines = spark.createDataFrame([("p", 1, '    e "這" x'), ("p", 2, '    old "這"')], "path string, n int, line string")
    fixed = sinks.repaired(lines, spark.createDataFrame([("p", 1, "这"), ("p", 2, "这")], "path string, n int, translation string"))
    assert [r.line for r in fixed.orderBy("n").collect()] == ['    e "这" x', '    old "這"']
    sinks.write_files(sinks.rendered(units, strings, "zh"), str(tmp_path / "o"))
    assert sinks.drop_path(spark, str(tmp_path / "o")) and not sinks.drop_path(spark, str(tmp_path / "o"))
    stale = sinks.stale_compiled(spark.createDataFrame([("a/X.rpyc",), ("a/x.rpy",), ("b.rpyc",)], "path string"))
    assert [r.path for r in stale.collect()] == ["a/X.rpyc"]


def test_archives(spark):
    class Evil:
        def __reduce__(self):
            return (print, ("no",))

    bad = b"RPA-3.0 %016x %08x\n" % (34, 0) + zlib.compress(pickle.dumps({"a": Evil()}))
    names = archive({"a/b.rpy": b"one", "A/B.rpyc": b"two", "../out.rpy": b"x", "c.png": b"y"})
    files = spark.createDataFrame([("good", bytearray(names)), ("bad", bytearray(bad)), ("none", bytearray(b"zip"))], "path string, content binary")
    found = archives.entries(files)
    errors = {r.path: r.error for r in found.where("error is not null").collect()}
    assert set(errors) == {"bad", "none", "good"} and errors["good"] == "unsafe name" and "not allowed" in errors["bad"]
    read = {r.name: bytes(r.content) for r in archives.contents(files, archives.scripts_only(found)).collect()}
    assert read == {"a/b.rpy": b"one", "A/B.rpyc": b"two"}
    assert [r.name for r in archives.preferred(archives.scripts_only(found).where("error is null")).collect()] == ["A/B.rpyc"]


def test_containers(spark):
    import base64
    import struct

    data = zlib.compress(b"script")
    slots = b"M" * 10 + struct.pack("<III", 1, 34, len(data)) + struct.pack("<III", 0, 0, 0) + data
    rows = [("s", slots), ("z", data), ("h", b"junk" + zlib.compress(base64.b64encode(b"layered text!"))), ("e", b"none")]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    got = {r.path: (r.state, bytes(r.content) if r.content else None) for r in archives.decoded(files).collect()}
    assert got == {"s": ("ok", b"script"), "z": ("ok", b"script"), "h": ("ok", b"layered text!"), "e": ("bad_header", None)}


def test_switch_states():
    state, said = (None, 0, None), []
    for current, requested in [("en", "en"), ("en", "zh"), ("en", "zh"), ("en", "zh"), ("en", "zh"), ("zh", "zh"), ("en", "en")]:
        state, s = switch.step(state, current, requested, "zh")
        said.append(s)
    assert said == ["READY", None, None, None, "FAIL", "PASS", None]


def test_incremental_refresh_resumes(spark, tmp_path):
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], "k string, v int").schema
    seen = []

    def work(new):
        seen.append(sorted(r.k for r in new.collect()))
        return new.withColumn("done", F.lit(True))

    spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], schema).coalesce(1).write.parquet(source)
    incremental.refresh(spark, source, schema, out, at, "k", work)
    spark.createDataFrame([("b", 2), ("c", 2)], schema).coalesce(1).write.mode("append").parquet(source)
    done = incremental.refresh(spark, source, schema, out, at, "k", work)
    assert seen == [["a", "b"], ["c"]] and sorted(r.k for r in done.collect()) == ["a", "b", "c"]


def test_answers():
    from textloom.functions import answers as A

    assert [A.unwrap(x) for x in ('```json\n["a"]\n```', '{"translation": "b", "x": "y"}', '{"q": "c"}', '"d"', "「e」", "plain", '["a","b"]', '{"a":"1","b":"2"}')] == ["a", "b", "c", "d", "e", "plain", '["a","b"]', '{"a":"1","b":"2"}']
    assert A.array_of('["x"] ["a","b"] ["c","d"] [1]', 2) == ["c", "d"] and A.array_of('["x"] y', 2) == ["x"] and A.array_of("none [1", 2) is None
    assert A.name_list('```json\n[["Al", " Bo "], "Al", {"n": "Cy"}]\n```') == ["Al", "Bo", "Cy"] and A.name_list("no") == []


def test_catalog(spark):
    from textloom.sources import catalog

    found = spark.createDataFrame([("a", "x/B.rpy", 2, 1), ("b", "X/b.rpyc", 1, 5), ("c", "x/b.rpy", 1, 7), ("d", "y.rpy", 1, 9)], "id string, name string, archive_rank int, pos int")
    assert [r.id for r in catalog.lookup(found, "x/b.rpy").collect()] == ["c"]
    tree = spark.createDataFrame([("deep/lib/a.rpy",), ("app/s.rpy",), ("app/TL/fr/s.rpy",), ("app/.git/s.rpy",), ("app/logs/t.rpy",), ("app/tmp/t.rpy",), ("app/zz_x.rpy",)], "rel string")
    assert [r.rel for r in catalog.scripts(tree).collect()] == ["app/logs/t.rpy", "app/s.rpy", "app/tmp/t.rpy"]
    assert catalog.root_of(tree).first().root == "/app"


def test_progress_is_replaced_by_a_move(spark, tmp_path):
    from textloom.sources import sinks

    path = str(tmp_path / "progress")
    schema = "kind string, text string, translation string, fp string"
    sinks.write_progress(spark.createDataFrame([("d", "a", "1", "f")], schema), path)
    again = spark.read.parquet(path)
    sinks.write_progress(again.unionByName(spark.createDataFrame([("d", "b", "2", "f")], schema)), path)
    assert sorted(r.text for r in spark.read.parquet(path).collect()) == ["a", "b"]
    assert [p.name for p in tmp_path.iterdir()] == ["progress"]
