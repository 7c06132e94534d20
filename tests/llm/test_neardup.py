import random
import re

import numpy as np
import pytest

from textloom.llm import neardup as N
from textloom.llm.components import components

from .util import EDGES, docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())))
    return out


def brute(rows, percent):
    sets = sets_of(rows)
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            n = len(s & t)
            if n and 100 * n >= percent * (len(s) + len(t) - n):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        k = r.randrange(len(w))
        w[k : k + 1] = r.choice([[], ["zz%d" % r.randrange(99)], [w[k], "yy"]])
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    passage = prose(999, 70)
    texts = [prose(k, r.randint(3, 200)) for k in range(25)]
    for k in range(6):  # families of copies with more and more edits
        base = prose(50 + k, 40 + 60 * k).split()
        texts += [edited(r, base, e) for e in (0, 0, 1, 1, 2, 3, 4, 6, 9)]
    texts += [prose(300 + k, 20) + " " + passage for k in range(20)] + [passage + f" end{k}" for k in range(8)]
    texts += ["a b c d e f g".upper(), "a b c d e f g", "one two", "two one", "One Two"] + EDGES
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def got(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize("percent", [80, 85])
def test_brute_force(spark, rows, percent):
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    assert got(N.clusters(df, percent=percent)) == brute(rows, percent)


def test_large_families_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_DOCS", 6)
    r = random.Random(3)
    base = prose(1, 80).split()
    rows = [(i, edited(r, base, r.randint(0, 5))) for i in range(60)]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    assert got(N.clusters(df, percent=85)) == brute(rows, 85)
    kept = N.deduplicated(df, percent=85)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [i for i, _, _, k in brute(rows, 85) if k]


def test_edges(spark):
    df = docs(spark, [None, "", "a b", "a b", "a b", None], [3, 2, 5, 5, 4, 3])
    assert got(N.clusters(df)) == [(2, 0, 2, True), (3, 0, 3, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False)]
    assert N.clusters(docs(spark, [])).collect() == []
    null = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.component_id) for x in N.clusters(null).collect() if x.doc_id) == [(1, 1)]
    assert N.deduplicated(null).count() == 2


def test_least_overlap_is_safe():
    o = N.least_overlap(64, 85)
    rng = np.random.default_rng(1)
    assert 30 <= o <= 40 and (rng.binomial(64, 0.85, 1_000_000) >= o).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 103), (103, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 40)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(61)) and found[103] == found[101] == found[100] == 100 and all(found[200 + k] == 200 for k in range(40))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("percent", [80, 85])
def test_sets_about_the_size_of_a_sketch(spark, percent):
    rows = []
    for rep in range(6 if percent == 80 else 40):
        for a in range(60, 65):
            for b in range(64, 81):
                if a * 100 >= percent * b:
                    words = [f"w{rep}x{a}x{b}x{k}" for k in range(b + 4)]
                    rows += [(len(rows), " ".join(words[: a + 4])), (len(rows) + 1, " ".join(words))]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    want = [(i, len(t.split()) - 4, i & ~1, not i & 1) for i, t in rows]
    assert got(N.clusters(df, percent=percent)) == want


def test_least_shared_is_safe():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        for size in range(40, 64):
            for n in range(size, 100 * size // percent + 1):
                least = -(-percent * (size + n) // (100 + percent))
                whole = np.arange(n) < least  # values in common, dealt over the ranks of the partner
                for _ in range(20):
                    assert rng.permutation(whole)[:64].sum() >= N.least_shared(size, 64, percent)
                assert least - max(0, n - 64) >= N.least_shared(size, 64, percent)


def test_deduplicated_judges_rows_not_ids(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = a + " tail"
    # 1 repeats as a head; 7 has a copy of 1 and a clean text; 8 has two near texts of its own; two nulls stay
    rows = [(1, a), (1, a), (1, a), (7, near), (7, b), (7, b), (8, c), (8, c + " end"), (9, c + " end"), (4, ""), (4, ""), (4, None), (None, a), (None, a)]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    kept = N.deduplicated(df)
    assert kept.columns == df.columns and kept.schema.simpleString() == df.schema.simpleString()
    found = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert found in ([(0, a), (0, a), (1, a), (4, ""), (7, b), (8, x)] for x in (c, c + " end"))
    assert sorted((r.doc_id, r.component_id) for r in N.clusters(df).where("doc_id = 7").collect()) == [(7, 1), (7, 7), (7, 7)]
