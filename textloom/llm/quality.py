"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Every block of BLOCK bytes of a text is compressed with either dictionary. The difference of the two total
sizes over the bytes of the text is the feature: positive where the dictionary of good text helps more,
and of the same size for short and long texts, as each block meets the dictionaries anew. Logistic calibration, fitted on
labelled rows that built no dictionary and corrected to the class shares of all training labels, turns
it into a score from 0 to 1.

Training rows are those whose crc32(doc_id as text) mod 5 is not 0. The dictionaries and the
calibration are fitted on at most SAMPLE rows of each class (the first by a hash of the id, of at most
SAMPLE_BYTES bytes each), on the driver; the class shares count all training labels. Scores use the text
alone.

Defined cases: a null or empty text has the feature 0, and so the calibrated score of a text that
neither dictionary favours; labels other than 0 and 1 are ignored; without labels of both classes every
score is 1 if there is no bad label, else 0; where the dictionaries tell nothing, it is the share of good labels; repeated rows get equal scores; a very long text is
compressed whole, block by block; columns pass through `accepted` unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import text_buffers
from ._worker import in_batches

#: Bounds of the fit.
SAMPLE, SAMPLE_BYTES = 1500, 16384
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
#: Bytes compressed at once.
BLOCK = 1024
THRESHOLD = 0.3
FOLDS = 5

RESULT = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def compressors(self) -> tuple:
        import zstandard

        out = []
        for raw in (self.bad, self.good):
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return tuple(out)

    def score(self, feature: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * feature + self.intercept))))


def feature(text: bytes, bad, good) -> float:
    """Advantage of the dictionary of good text, in bytes for each byte of text."""
    n = len(text)
    if not n:
        return 0.0
    blocks = [text[i : i + BLOCK] for i in range(0, n, BLOCK)]
    return (sum(len(bad(x)) for x in blocks) - sum(len(good(x)) for x in blocks)) / n


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)], level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text for a trained one: the text itself
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge, classes of equal weight."""
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - 1e-2 * beta * np.array([1, 0])
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """The classifier from the training rows of labels."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out())
    counts = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return Model(b"", b"", 0.0, -40.0 if 0 in counts else 40.0)
    first = lambda q: marks.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(first(0).unionByName(first(1)))  # 2 * sample rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    found = rows.where(f"octet_length(text) between 1 and {SAMPLE_BYTES}").select("quality", F.xxhash64("doc_id").alias("h"), "text").collect()
    found.sort(key=lambda r: (r.h, r.text))
    texts = {q: list(dict.fromkeys(r.text.encode() for r in found if r.quality == q)) for q in (0, 1)}
    if not texts[0] or not texts[1]:
        return Model(b"", b"", 0.0, math.log(counts[1] / counts[0]))
    cut = {q: max(1, len(x) * 2 // 3) for q, x in texts.items()}
    built = {q: _dictionary(x[: cut[q]]) for q, x in texts.items()}
    model = Model(built[1], built[0], 0.0, 0.0)
    bad, good = model.compressors()
    rest = [(t, q) for q, x in texts.items() for t in (x[cut[q] :] or x)]
    slope, intercept = _logistic(np.array([feature(t, bad, good) for t, _ in rest]), np.array([q for _, q in rest]))
    if slope <= 0:  # too little text to tell the classes apart
        slope = intercept = 0.0
    return Model(model.good, model.bad, slope, intercept + math.log(counts[1] / counts[0]))


def _scores(model: Model):
    """Function from a column of texts to scores."""
    if not model.slope:
        return lambda column: [model.score(0.0)] * len(column)
    bad, good = model.compressors()

    def run(column) -> list[float]:
        data, offs = text_buffers(column)
        view = memoryview(data)
        at = offs.tolist()
        return [model.score(feature(view[i:j], bad, good)) for i, j in zip(at[:-1], at[1:])]

    return run


def scored(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        score = _scores(shared.value)
        for batch in batches:
            s = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return in_batches(rows, run, RESULT)


def accepted(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = _scores(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([x >= threshold for x in score(batch.column("text"))], pa.bool_()))

    return in_batches(docs, run, docs.schema)
