"""Embedding whitening by polarised covariance: exact sums of squares for every dimension and every sum of two dimensions.

Entries become whole numbers x = floor(SCALE * entry), so every sum below is exact. Over the n distinct vectors with
sums S, y = n * x - S is centred without rounding. Two aggregates are taken: of y[i]^2 and of (y[i] + y[j])^2; the
covariance of two dimensions is half of what the latter has over the two former. The sums meet as digits in base
2^32, a row for each pair and task, so they can't overflow, whatever the number of vectors. What comes to the driver is one row
for each pair of dimensions; its matrix goes to `eigh`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

SCALE = 256
#: Digits of a sum (32 bits each, the last with the sign).
DIGITS = 8
#: Vectors squared at a time in a task.
BLOCK = 4096
LONGEST = (1 << 63) - 1


def fixed_point(vector: Column) -> Column:
    """Entries times SCALE, rounded down; those beyond the longs stop at their ends."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))))


def usable(vector: Column) -> Column:
    """Whether there is a vector, all of whose entries are numbers."""
    number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, number)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as Python's numbers where 64 bits are too few for a sum of two."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if x.size else 0
    if most < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(z: np.ndarray) -> np.ndarray:
    """Exact sums of squares of the columns, as Python's numbers: 64-bit sums of products of 21-bit parts."""
    if z.dtype == object or not z.size:
        return (z * z).sum(0).astype(object)
    bits, rows = int(np.abs(z).max()).bit_length(), len(z).bit_length()
    if 2 * bits + rows < 63:
        return np.einsum("bi,bi->i", z, z).astype(object)
    low, middle, high = z & 0x1FFFFF, (z >> 21) & 0x1FFFFF, z >> 42
    total = np.zeros(z.shape[1], object)
    for a, b, shift in ((low, low, 0), (low, middle, 22), (middle, middle, 42), (low, high, 43), (middle, high, 64), (high, high, 84)):
        total += np.einsum("bi,bi->i", a, b).astype(object) * (1 << shift)
    return total


def pair_squares(y: np.ndarray) -> np.ndarray:
    """Sums of y[i]^2, then of (y[i] + y[j])^2 for i < j, row by row of the matrix."""
    parts = [squares(y)]
    for i in range(y.shape[1] - 1):
        parts.append(squares(y[:, i : i + 1] + y[:, i + 1 :]))
    return np.concatenate(parts)


def exact_sums(vectors: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], dimensions: int) -> list[int]:
    """Sums over all vectors (x) of what `part` gives for a block of them: `width` whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for batch in batches:
            x = matrix(batch.column("x"), dimensions)
            for first in range(0, len(x), BLOCK):
                total += part(x[first : first + BLOCK])
        digits = [[(int(t) >> 32 * k) & 0xFFFFFFFF if k < DIGITS - 1 else int(t) >> 32 * k for t in total] for k in range(DIGITS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *(pa.array(d, pa.int64()) for d in digits)], ["place", *(f"d{k}" for k in range(DIGITS))])

    parts = bounded_batches(vectors).mapInArrow(run, "place long, " + ", ".join(f"d{k} long" for k in range(DIGITS)))
    out = [0] * width
    for row in parts.groupBy("place").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS))).collect():
        out[row["place"]] = sum(row[f"d{k}"] << 32 * k for k in range(DIGITS))
    return out


@dataclass
class Whitening:
    """n distinct vectors with the sums of their dimensions; the covariance's largest eigenvalues and their vectors."""

    dimensions: int = 0
    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    identity_error: float = 0.0

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y / self.n).astype(float) @ (self.vectors / np.sqrt(self.values))


def covariance(total: list[int], dimensions: int, n: int) -> np.ndarray:
    """The covariance from the sums of `pair_squares`: each entry is the exact one, rounded once."""
    own, out, at = total[:dimensions], np.zeros((dimensions, dimensions)), dimensions
    for i in range(dimensions):
        out[i, i] = own[i] / n**3
        for j in range(i + 1, dimensions):
            out[i, j] = out[j, i] = (total[at] - own[i] - own[j]) / (2 * n**3)
            at += 1
    return out


def whole_numbers(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Usable rows with x, vectors shorter than the longest filled up with 0, and the longest length."""
    rows = rows.where(usable(F.col(vector)))
    dimensions = rows.agg(F.max(F.size(vector))).first()[0] or 0
    x = fixed_point(F.col(vector))
    return rows.withColumn("x", F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dimensions) - F.size(vector)))), dimensions


def fit(rows: DataFrame, vector: str = "embedding", components: int = 4) -> Whitening:
    """The whitening of the distinct vectors of `rows`. Components that no vector varies along (eigenvalues that rounding can't
    tell from 0) are left out, so one vector, or none, gives no component."""
    counted, dimensions = whole_numbers(rows.select(F.col(vector).alias("vector")), "vector")
    if not dimensions:
        return Whitening()
    once = written(counted.select("x").distinct(), "whitening-vectors")
    n, *sums = exact_sums(once, dimensions + 1, lambda x: np.concatenate([[len(x)], column_sums(x)]), dimensions)
    total = exact_sums(once, dimensions * (dimensions + 1) // 2, lambda x: pair_squares(centred(x, n, sums)), dimensions)
    v = covariance(total, dimensions, n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > np.finfo(float).eps * dimensions * max(values[0], 0)
    model = Whitening(dimensions, n, sums, values[keep], vectors[:, keep], values[keep] / np.trace(v))
    names = [f"w{k}" for k in range(int(keep.sum()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in model.whitened(centred(matrix(batch.column("x"), dimensions), n, sums)).T], names)

    if names:
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        found = once.mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*(F.covar_pop(a, b) for a, b in pairs)).first()
        model.identity_error = max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs, strict=True))
    return model


def column_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns, as Python's numbers."""
    low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
    return high.astype(object) * (1 << 32) + low.astype(object)


def apply(rows: DataFrame, model: Whitening, keep: list[str], vector: str = "embedding") -> DataFrame:
    """`keep`, deviation (sum over dimensions of (n * x - S)^2, exact; null beyond the longs) and whitened (array) of the usable rows.

    Null vectors and those with entries that are null, infinite or no number are left out; an empty vector counts as all 0, and
    so do entries that a vector lacks. Repeated rows and ids stay rows of their own. An empty table gives no rows."""
    kinds = dict(rows.dtypes)
    named = [f"kept_{k}" for k in range(len(keep))]  # whatever the kept columns are called
    prepared, _ = whole_numbers(rows.select(*(F.col(c).alias(n) for c, n in zip(keep, named, strict=True)), F.col(vector).alias("vector")), "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = centred(matrix(batch.column("x"), model.dimensions), model.n, model.sums)
            if y.dtype != object and y.size and int(np.abs(y).max()) ** 2 * model.dimensions > LONGEST:
                y = y.astype(object)
            deviation = [int(d) if d <= LONGEST else None for d in (y * y).sum(1)]
            w = model.whitened(y)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in named), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], [*keep, "deviation", "whitened"])

    if not model.n:
        return rows.where(F.lit(False)).select(*keep, F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    return bounded_batches(prepared).select(*named, "x").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "deviation long, whitened array<double>"]))


def whiten(rows: DataFrame, components: int = 4) -> DataFrame:
    """A row for each usable row of `rows` (vec_id, embedding; further columns are not looked at) and component: vec_id, component
    (from 1), n, deviation, whitened, explained, identity_error. Cases as in `fit` and `apply`; a null vec_id stays null."""
    model = fit(rows, "embedding", components)
    wide = apply(rows, model, ["vec_id"])
    explained = F.array(*(F.lit(float(x)) for x in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    long = wide.select("vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("place", "both"))
    return long.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("both.whitened").alias("whitened"), F.col("both.explained").alias("explained"), F.lit(float(model.identity_error)).alias("identity_error"))
