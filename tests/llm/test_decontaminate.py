import hashlib
import random
import re

import pytest

from textloom.llm import decontaminate as D

from .util import EDGES, docs, prose

ITEMS = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items):
    words = lambda t: WORD.findall((t or "").translate(LOW))
    patterns = {}
    for i, t in items:
        w = words(t)
        m = min(8, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if x := patterns.get(tuple(w[k : k + m])):
                    found |= x
                    hit.update(range(k, k + m))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2)
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(2)
    items = [(i, prose(i, r.randint(8, 60), 50)) for i in range(12)] + [(20, "just three words"), (21, "Single"), (22, None), (23, " ... "), (24, prose(3, 20, 50)), (25, prose(3, 20, 50))]
    w = lambda t: t.split()
    texts = EDGES + [prose(100 + k, 80, 50) for k in range(10)]
    texts += [prose(200, 300, 50) + " " + items[1][1].upper() + ", " + prose(201, 400, 50), " ".join(w(items[2][1])[1:9]), "-".join(w(items[3][1])) + "\n" + "; ".join(w(items[4][1])), "so just THREE... words single"]
    texts += [items[5][1] + "x", " ".join(w(items[6][1])[:7]), (items[7][1] + " ") * 40]
    return texts, items


def test_brute_force(spark, case):
    texts, items = case
    got = {r.doc_id: tuple(r)[1:] for r in D.contamination(docs(spark, texts), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == brute(texts, items)


def test_blocks_of_a_large_benchmark(spark, case, monkeypatch):
    texts, items = case
    bench = spark.createDataFrame(items, ITEMS)
    kept = sorted(r.doc_id for r in D.decontaminate(docs(spark, texts), bench).collect())
    monkeypatch.setattr(D, "BLOCK_BYTES", 600)
    got = {r.doc_id: tuple(r)[1:] for r in D.contamination(docs(spark, texts), bench).collect()}
    assert got == brute(texts, items)
    assert sorted(r.doc_id for r in D.decontaminate(docs(spark, texts), bench).collect()) == kept == sorted(d for d, x in got.items() if not x[-1])


def test_edges(spark, case):
    texts, items = case
    df = docs(spark, texts + texts[-1:])
    none = D.decontaminate(df, spark.createDataFrame([], ITEMS))
    assert none.columns == df.columns and none.count() == len(texts) + 1
    assert D.contamination(docs(spark, []), spark.createDataFrame(items, ITEMS)).collect() == []
    same = D.contamination(docs(spark, texts[-3:-2] * 2, [4, 4]), spark.createDataFrame(items + items, ITEMS)).collect()
    assert len(same) == 2 and same[0] == same[1]


@pytest.mark.parametrize("size", [None, 600])
def test_rows_with_null_or_repeated_ids_are_judged_each_for_itself(spark, case, monkeypatch, size):
    _, items = case
    if size:
        monkeypatch.setattr(D, "BLOCK_BYTES", size)
    leak = f"{items[1][1]} {items[2][1]}"
    df = docs(spark, [leak, "clean text", leak, "clean", leak, "clean"], [None, None, 5, 5, 6, 7])
    kept = D.decontaminate(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "clean text"), (5, "clean"), (7, "clean")]
