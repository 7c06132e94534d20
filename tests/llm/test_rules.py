import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from textloom.llm.rules import RULES, binomial_tail, cutoffs, features, judged

from .util import EDGES, docs, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_features(spark):
    texts = EDGES + [prose(1, 60), (prose(2, 9) + "\n") * 5 + "# * |", "a b c d e a b c d e", "a b c d e f a b c d e f g", "q " * 7, "a b c d e x a b c d e b c d e y", " \n \nz\nz\n z"]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in features(docs(spark, texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_rows_hold_no_windows_or_lines(spark):
    """Of a text only its words, as strings, and numbers stand in rows; arrays of windows took several times its size."""
    plan = features(docs(spark, ["a b c d e " * 9]))._jdf.queryExecution().executedPlan()
    kinds, todo = set(), [plan]
    while todo:
        node = todo.pop()
        out, below = node.output(), node.children()
        kinds |= {out.apply(i).dataType().simpleString() + (" " + out.apply(i).name() if out.apply(i).dataType().simpleString() == "array<string>" else "") for i in range(out.size())}
        todo += [below.apply(i) for i in range(below.size())]
    assert {k for k in kinds if k.startswith("array")} <= {"array<string> w", "array<bigint>", "array<int>"}


def test_equal_halves_of_hashes_are_no_equal_windows(spark):
    r = random.Random(3)
    words = [f"{r.getrandbits(40):x}" for _ in range(200_000)]  # some five pairs of windows share half a hash by chance
    texts = [" ".join(words), " ".join(words + words[7:14]), "word " * 50_000]
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in features(docs(spark, texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 1000), (4, 1000), (10, 5000), (0, 2000), (350, 100_000), (99_000, 25_000_000)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.004).alias("p")).collect()
    for r in rows:
        if r.k >= r.n * 0.004:
            assert r.p == 1
            continue
        logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.004) + (r.n - i) * math.log(0.996) for i in range(r.k + 1)]
        top = max(logs)
        want = math.exp(top) * math.fsum(math.exp(x - top) for x in logs)
        assert abs(r.p - want) <= 1e-6 * want + 1e-12


def test_false_rejections_stay_within_the_risk(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):
        good = i % 3 > 0
        words = prose(i, 30).split()
        symbols = r.random() < (0.001 if good else 0.9)
        rows.append((i, " ".join(w + "#" * 3 if symbols else w for w in words), r.choice(["en", "fr", None]), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, q int")
    labels = df.select("doc_id", F.col("q").alias("quality"), F.lit(0).alias("toxic")).where("doc_id % 7 < 6")
    out = judged(df.drop("q"), labels, risk=0.1).join(df.select("doc_id", "q"), "doc_id").groupBy("lang", "q").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert all(x.kept >= 0.9 for x in out if x.q == 1) and all(x.kept <= 0.3 for x in out if x.q == 0)
    cuts = cutoffs(features(df), labels, risk=0.1).collect()
    assert {c.rule for c in cuts} and all(1 <= c.cut <= RULES[c.rule][4] for c in cuts)


def test_edges(spark):
    df = docs(spark, EDGES + [prose(1, 40)] * 2, [*range(len(EDGES)), 77, 77])
    out = judged(df, spark.createDataFrame([], LABELS)).collect()
    assert len(out) == len(EDGES) + 2 and all(r.kept == (not r.base_failed) for r in out)
    assert all(r.base_failed for r in out if r.n_words < 10)
    assert judged(docs(spark, []), spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0)], LABELS)).collect() == []


def test_main_path_runs_no_python(spark):
    plan = judged(docs(spark, ["a"]), spark.createDataFrame([(1, 1, 0)], LABELS))._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))
