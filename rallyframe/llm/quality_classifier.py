"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed text features gives each document a score s; ordered thresholds turn it into
P(grade <= k) = 1 / (1 + exp(s - t_k)). From that come the expected grade and the tail probability by which
documents are selected. Features: frequencies of hashed byte trigrams (case and symbols included), and how
often words recur at short distance.

The fit uses a bounded, fixed sample of the labelled rows: PER_GRADE for each grade, those with the smallest
hash of doc_id, weighted back to the grades' true shares. Scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, raw_text, slices

BITS = 11
EXTRA = 4
GRADES = 3
PER_GRADE = 1500
#: Documents stay if P(grade >= SELECT_GRADE) is at least SELECT.
SELECT_GRADE = 1
SELECT = 0.4
SCALE = 32.0
#: The fold held out of the fit: crc32 of doc_id as text, modulo 4.
FOLD = 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == FOLD, F.lit(False))


def grade(quality: Column, toxic: Column) -> Column:
    """0: low quality; 1: good but toxic; 2: good."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)


def _buckets(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint32)
    code = d[:-2] | d[1:-1] << np.uint32(8) | d[2:] << np.uint32(16)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _extra(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By row: shares of words that are the one before, one of the 7 before that, one of the 24 before that; 1."""
    words = Words(data, offsets)
    h, row = words.hash, words.row
    out = np.zeros((len(offsets) - 1, EXTRA))
    n = np.maximum(np.diff(words.bounds), 1)
    for k, (low, high) in enumerate(((1, 1), (2, 8), (9, 32))):
        seen = np.zeros(len(h), bool)
        for lag in range(low, min(high, len(h) - 1) + 1):
            seen[lag:] |= (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
        out[:, k] = np.bincount(row[seen], minlength=len(n)) / n
    out[:, 3] = 1.0
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: SCALE x trigram frequencies, then the extra features."""
    rows = len(offsets) - 1
    out = np.zeros((rows, (1 << BITS) + EXTRA), np.float32)
    bucket = _buckets(data) if len(data) > 2 else np.zeros(0, np.uint32)
    for i in range(rows):
        own = bucket[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]
        if len(own):
            out[i, : 1 << BITS] = np.bincount(own, minlength=1 << BITS) * (SCALE / len(own))
    out[:, 1 << BITS :] = _extra(data, offsets)
    return out


def scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """`features @ weights` without the matrix: a look-up for each trigram, summed by text."""
    total = np.zeros(max(1, len(data) - 1))
    if len(data) > 2:
        np.cumsum(weights[: 1 << BITS][_buckets(data)], out=total[1:])
    start = np.minimum(offsets[:-1], len(total) - 1)
    end = np.clip(offsets[1:] - 2, start, len(total) - 1)
    return SCALE * (total[end] - total[start]) / np.maximum(end - start, 1) + _extra(data, offsets) @ weights[1 << BITS :]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tail(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ...: a column each."""
    return _sigmoid(score[:, None] - thresholds[None, :])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the largest likelihood less the ridge, by Adam on the whole sample."""
    n_grades = GRADES
    w = np.zeros(x.shape[1], np.float32)
    raw = np.zeros(n_grades - 1)  # the first threshold, then logarithms of the steps to the next
    weight = weight / weight.sum()
    means = [np.zeros_like(w), np.zeros_like(raw)]
    squares = [np.zeros_like(w), np.zeros_like(raw)]
    for t in range(1, steps + 1):
        thresholds = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        p = np.concatenate([np.ones((len(y), 1)), tail(x @ w, thresholds), np.zeros((len(y), 1))], axis=1)
        slope = p * (1 - p)
        own = np.maximum(p[np.arange(len(y)), y] - p[np.arange(len(y)), y + 1], 1e-9)
        up, down = slope[np.arange(len(y)), y] / own, slope[np.arange(len(y)), y + 1] / own
        by_score = weight * (down - up)
        at = np.zeros((len(y), n_grades - 1))
        for k in range(n_grades - 1):
            at[:, k] = weight * (np.where(y == k + 1, up, 0) - np.where(y == k, down, 0))
        by_threshold = at.sum(0)
        slopes = [(by_score.astype(np.float32) @ x) + ridge * w, np.array([by_threshold.sum(), *(by_threshold[k:].sum() * np.exp(raw[k]) for k in range(1, n_grades - 1))])]
        for i, value in enumerate((w, raw)):
            means[i] = 0.9 * means[i] + 0.1 * slopes[i]
            squares[i] = 0.99 * squares[i] + 0.01 * slopes[i] ** 2
            value -= rate * (means[i] / (1 - 0.9**t)) / (np.sqrt(squares[i] / (1 - 0.99**t)) + 1e-8)
    return w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) to learn from: one label for each id (the lowest grade of several), held-out ids left out."""
    known = labels.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return known.where("grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def sampled(rated: DataFrame, per_grade: int) -> DataFrame:
    """At most `per_grade` ids of each grade, the same ones in each run."""
    parts = [rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade) for g in range(GRADES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. Without any labelled document: weights 0, thresholds that keep everything."""
    known = rated(labels)
    shares = dict(known.groupBy("grade").count().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = features(*raw_text(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array([r.tobytes() for r in x], pa.binary())], ["grade", "x"])

    # At most GRADES x per_grade ids, so broadcast; as many vectors of fixed length come back.
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sampled(known, per_grade)), "doc_id").select("grade", "text")
    rows = sorted((r["grade"], bytes(r["x"])) for r in chosen.mapInArrow(run, "grade int, x binary").collect())
    if not rows:
        return np.zeros((1 << BITS) + EXTRA, np.float32), np.arange(GRADES - 1) - 10.0
    y = np.array([g for g, _ in rows])
    x = np.frombuffer(b"".join(v for _, v in rows), np.float32).reshape(len(rows), -1)
    got = np.bincount(y, minlength=GRADES)
    return fit(x, y, np.array([shares.get(int(g), 1) / got[g] for g in y], float))


def judge(docs: DataFrame, labels: DataFrame, per_grade: int = PER_GRADE, select: float = SELECT) -> DataFrame:
    """All columns of `docs` with expected_grade (0 to 2), tail_probability and kept (such columns are replaced).

    Null or empty text: scored by the constant feature alone. Null or repeated doc_id, repeated rows: each row
    is scored by its text. Labels that are null or without a document are not used; of several for one
    doc_id the lowest grade counts. Empty tables: no rows, or everything kept."""
    weights, thresholds = train(bounded_batches(docs), labels, per_grade)
    base = docs.drop("expected_grade", "tail_probability", "kept")

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text")
        return pa.array(np.concatenate([np.zeros(0), *(scores(weights, *raw_text(p.column("text"))) for p in parts)]))

    def at_least(k: int) -> Column:
        return 1 / (1 + F.exp(F.lit(float(thresholds[k - 1])) - F.col("_ordinal_score")))

    scored = base.withColumn("_ordinal_score", score(F.col("text").cast("string")))
    scored = scored.withColumn("expected_grade", sum((at_least(k) for k in range(2, GRADES)), at_least(1))).withColumn("tail_probability", at_least(SELECT_GRADE))
    return scored.withColumn("kept", F.col("tail_probability") >= select).drop("_ordinal_score")
