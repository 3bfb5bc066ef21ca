"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of ordinary text. A text is
cut in windows (words, lower-cased, in a fixed frame); each is compressed with both dictionaries, and where the
toxic one saves many bytes over the ordinary one, the window speaks for toxicity. How many such windows at each
of a few thresholds a text has is calibrated to a probability on the training documents.

What makes toxic text toxic is a small part of it. So the toxic dictionary is trained on those windows of toxic
documents that recur over many of them and hardly occur in ordinary ones; the rest of their text is like
anybody's. Letters are written in two bytes, so that a match of few letters still saves something.

Labels are learned from a bounded, fixed sample of rows: PER_LABEL labelled documents of each kind outside the held-out
fold, those with the smallest hash of doc_id, whatever their length. Dictionaries are trained on a bounded number of
windows. All documents are scored whole, every window of theirs by both dictionaries.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Documents of a label to learn from; windows of ordinary text to train on; how often a recurring toxic window is put before the trainer at most.
PER_LABEL = 1500
ORDINARY_WINDOWS = 200_000
REPEATS = 40
#: The fold held out: crc32 of doc_id as text, modulo 4. Predicted toxic from this score on. Fixed by the contract.
FOLD = 2
PREDICT = 0.3
#: Bytes that the toxic dictionary must save for a window to count, in rising order.
THRESHOLDS = (2, 4, 6)
TOXIC_BYTES, ORDINARY_BYTES = 32 << 10, 256 << 10
LEVEL = 19
#: A window is a toxic one if it occurs in this share of toxic documents (and in LEAST of them) and so many times as often as in ordinary ones.
SHARE, LEAST, CONTRAST = 0.006, 3, 10.0
FRAME = "~#window#~ "
REMEMBERED = 400_000
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == FOLD, F.lit(False))


def windows_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _WORD.findall((text or "").lower())


def framed(window: str) -> bytes:
    return f"{FRAME}{window} ".encode("utf-16-le", "surrogatepass")


def apart(texts: list[str]) -> list[list[str]]:
    """Windows of each text, without texts that mostly repeat earlier ones: copies would pass for recurring windows."""
    seen: set[int] = set()
    out = []
    for text in texts:
        w = windows_of(text)
        runs = {hash(tuple(w[i : i + 4])) for i in range(max(1, len(w) - 3))}
        if 5 * len(runs & seen) <= len(runs):
            out.append(w)
        seen |= runs
    return out


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray  # for `evidence`, the constant last

    def compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        """Content is used as it is, so that nothing but matches makes a difference."""
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        dictionary = zstandard.ZstdCompressionDict(content + FRAME.encode("utf-16-le"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


class Scorer:
    """Savings of windows, remembered within a worker as most recur."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.toxic, self.ordinary = model.compressor(model.toxic), model.compressor(model.ordinary)

    def saving(self, window: str) -> int:
        found = self.memo.get(window)
        if found is None:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
            raw = framed(window)
            found = len(self.ordinary.compress(raw)) - len(self.toxic.compress(raw))
            if len(window) < 64:
                self.memo[window] = found
        return found

    def evidence(self, windows: list[str]) -> np.ndarray:
        """For each threshold the logarithms of 1 + count and of the count's share; then 1."""
        counts = np.zeros(len(THRESHOLDS))
        for window, n in Counter(windows).items():
            saving = self.memo.get(window)
            if saving is None:
                saving = self.saving(window)
            if saving >= THRESHOLDS[0]:
                counts += [n * (saving >= t) for t in THRESHOLDS]
        return np.concatenate([np.log1p(counts), np.log1p(1000 * counts / max(1, len(windows))), [1.0]])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.evidence(windows_of(text)) @ self.model.weights, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or b" " * 8


def train(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """`toxic_share`: of all training labels, to which the sample is weighted back."""
    bad, good = apart(toxic), apart(ordinary)
    in_bad, in_good = (Counter(w for text in texts for w in set(text)) for texts in (bad, good))
    chosen = [w for w, n in in_bad.items() if len(w) >= 3 and n >= max(LEAST, SHARE * len(bad)) and n / max(1, len(bad)) >= CONTRAST * (in_good[w] + 0.5) / max(1, len(good))]
    rng = random.Random(0)
    bad_samples = [f" {w} ".encode("utf-16-le") for w in sorted(chosen) for _ in range(min(in_bad[w], REPEATS))]
    good_samples = [f" {' '.join(text[i : i + 4])} ".encode("utf-16-le") for text in good for i in range(0, len(text), 4)]
    rng.shuffle(bad_samples)
    rng.shuffle(good_samples)
    model = Model(dictionary(bad_samples, TOXIC_BYTES), dictionary(good_samples[:ORDINARY_WINDOWS], ORDINARY_BYTES), np.zeros(0))
    scorer = Scorer(model)
    texts = [windows_of(t) for t in toxic] + [windows_of(t) for t in ordinary]
    x = np.array([scorer.evidence(t) for t in texts]).reshape(len(texts), 2 * len(THRESHOLDS) + 1)
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    weight = np.where(y > 0, toxic_share / max(1, len(toxic)), (1 - toxic_share) / max(1, len(ordinary))) * len(y)
    model.weights = logistic(x, y, weight) if toxic and ordinary else np.array([0.0] * (2 * len(THRESHOLDS)) + [-3.0])
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from labelled documents outside the fold. Without both kinds of label, no text is toxic."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    n = dict(known.groupBy("toxic").count().collect())
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for t in (0, 1)]
    # At most 2 x per_label ids go out, and as many texts come back.
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")
    rows = sorted((r["toxic"], r["text"]) for r in chosen.select("toxic", "text").distinct().collect())
    return train([t for y, t in rows if y == 1], [t for y, t in rows if y == 0], n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0)))


def judge(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each row of `docs` (doc_id, text).

    Null, empty or wordless text: no window, so the score of a text without evidence. Null doc_id: not held
    out. Repeated rows: scored alike. Texts of any length are scored whole. Empty table: no rows. Nothing but
    the text enters the score; other columns are not looked at."""
    model = fit(bounded_batches(docs), labels, per_label)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=float)

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))
