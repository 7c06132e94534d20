import hashlib
import random

import pytest

from textloom.llm.suffix_dedup import removal

from .util import EDGES, docs, prose


def brute(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            if k in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(k)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for k in range(len(cover)) if cover[k] and not (k and cover[k - 1]))
        out.append((i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in removal(df).collect())


def test_brute_force(spark):
    r = random.Random(5)
    passage, base = prose(1, 60), prose(2, 300)
    texts = [prose(10 + k, r.randint(5, 200)) for k in range(20)]
    texts += [base, base, base.replace("a", "o", 3), base[50:] + passage, passage + prose(77, 30) + passage, "ab" * 400, "abc " * 300, prose(3, 40) + "\n" + passage]
    texts += [base[:400] + prose(5, 30), base[:100], base[:99], "é" * 120, "é" * 49]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = list(zip(order, texts))
    assert got(docs(spark, texts, order)) == brute(sorted(rows))


def test_edges(spark):
    assert got(docs(spark, EDGES)) == brute(list(enumerate(EDGES)))
    assert got(docs(spark, [])) == []


def test_repeated_rows_count_once(spark):
    t = prose(4, 100)
    rows = got(docs(spark, [t, t, t], [7, 7, 9]))
    n = len(t.encode())
    assert [(x[0], x[2]) for x in rows] == [(7, 0), (7, 0), (9, n)]


def test_one_id_two_texts(spark):
    a, b = prose(4, 100), prose(6, 100)
    first, second = sorted([a, a + b], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows = {x[1]: x[2] for x in got(docs(spark, [a, a + b], [1, 1]))}
    assert rows[len(first.encode())] == 0 and rows[len(second.encode())] > 0


def test_null_id_is_compared_with_nothing(spark):
    t = prose(4, 100)
    df = spark.createDataFrame([(None, t), (3, t), (4, t)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in removal(df).collect()) == [(-1, 0), (3, 0), (4, len(t.encode()))]


def test_length_is_checked(spark):
    with pytest.raises(ValueError):
        removal(docs(spark, ["a"]), length=50)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_anchors_and_small_slices(spark, monkeypatch, hot):
    """One passage in many surroundings, dealt by anchors of over `hot` runs, in slices that settle little."""
    from textloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "_SLICE", 1500)
    monkeypatch.setattr(suffix_dedup, "_BATCH", 1500)
    r = random.Random(9)
    passage = prose(1, 40)
    texts = [prose(100 + k, r.randint(3, 40)) + " " + passage + " " + prose(200 + k % 7, r.randint(3, 40)) for k in range(40)]
    texts += [passage[:120] + prose(300 + k % 3, 30) for k in range(12)] + texts[:2] + ["ab" * 300, "x" * 250]
    order = list(range(len(texts)))
    r.shuffle(order)
    assert got(docs(spark, texts, order).repartition(5)) == brute(sorted(zip(order, texts)))
