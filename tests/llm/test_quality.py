import random
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm.quality import accepted, fit, scored

from .util import EDGES, docs, prose

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def model(spark):
    words = prose(1, 600).split()
    good = [" ".join(random.Random(k).choices(words, k=120)) for k in range(60)]
    bad = [" ".join(w + "&&&%%%" for w in random.Random(k).choices(words, k=60)) for k in range(60, 120)]
    df = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(5, None, 0), (999, 1, 0), (None, 0, 0)], LABELS)
    return df, labels, fit(df, labels)


def test_held_out_rows_are_told_apart(spark, model):
    df, _, m = model
    rows = scored(df, m).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hits = [r.predicted == int(r.doc_id < 60) for r in rows if r.held_out]
    assert len(hits) > 10 and sum(hits) >= 0.95 * len(hits)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_fit_is_repeatable_and_ignores_held_out_labels(spark, model):
    df, labels, m = model
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert fit(df, flipped) == m


def test_edges(spark, model):
    _, _, m = model
    rows = sorted(scored(docs(spark, EDGES + EDGES[-1:]), m).collect(), key=lambda r: r.doc_id)
    assert rows[0].score == rows[1].score and rows[-1].score == rows[-2].score
    assert scored(docs(spark, []), m).collect() == []
    kept = accepted(docs(spark, EDGES), m)
    assert kept.columns == docs(spark, []).columns and kept.count() == sum(r.predicted for r in rows[:-1])


def test_without_both_classes(spark):
    df = docs(spark, ["a b c", None])
    for quality, want in ((1, 1), (0, 0)):
        m = fit(df, spark.createDataFrame([(k, quality, 0) for k in range(9)], LABELS))
        assert {r.predicted for r in scored(df, m).collect()} == {want}
    assert {r.predicted for r in scored(df, fit(df, spark.createDataFrame([], LABELS))).collect()} == {1}


def test_feature_and_score_against_plain_python(spark, model):
    """The fit and the scores once more from the definition, row by row."""
    import math

    import numpy as np
    import zstandard

    from textloom.llm import quality

    df, labels, m = model
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    order = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id")).collect()}

    def advantage(text, good, bad):
        total = 0
        for i in range(0, len(text), quality.BLOCK):
            for sign, raw in ((1, bad), (-1, good)):
                known = zstandard.ZstdCompressionDict(raw)
                total += sign * len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[i : i + quality.BLOCK]))
        return total / len(text) if text else 0.0

    marks = {r.doc_id: r.quality for r in labels.collect() if r.doc_id is not None and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    by = {q: [t for _, t in sorted((order[i], texts[i]) for i, v in marks.items() if v == q and i in texts)] for q in (0, 1)}
    rest = [(t, q) for q in (0, 1) for t in by[q][len(by[q]) * 2 // 3 :]]
    x, y = np.array([advantage(t, m.good, m.bad) for t, _ in rest]), np.array([q for _, q in rest])
    counts = {q: sum(v == q for v in marks.values()) for q in (0, 1)}
    # the calibration is where the gradient of the weighted, slightly ridged likelihood vanishes
    shift = math.log(counts[1] / counts[0])
    p = 1 / (1 + np.exp(-(m.slope * x + m.intercept - shift)))
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    scale = x.std()
    assert abs((weight * (y - p)).sum()) < 1e-6
    assert abs((weight * (y - p) * x / scale).sum() - 1e-2 * m.slope * scale) < 1e-6
    for r in scored(df, m).collect()[::7]:
        want = 1 / (1 + math.exp(-(m.slope * advantage(texts[r.doc_id], m.good, m.bad) + m.intercept)))
        assert abs(r.score - want) < 1e-9
