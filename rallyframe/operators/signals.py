"""Signals and images as tables: motion energy, the offset between cameras, heatmaps and their blobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Polygon, in_region, num, rounded
from .clips import many_clips
from .courts import blob_reason


def motion_energy(gray: DataFrame, keys: list[str], stride: int = 10) -> DataFrame:
    """Mean absolute change of the pixels (keys, frame, pixels: array) against the sampled frame before; the first has 0."""
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = gray.where(F.col("frame") % stride == 0).withColumn("_p", F.lag("pixels").over(w))
    change = F.aggregate(F.zip_with("pixels", "_p", lambda a, b: F.abs(a.cast("double") - b)), num(0), lambda s, x: s + x) / F.size("pixels")
    return rows.select(*keys, (F.row_number().over(w) - 1).alias("sample_idx"), "frame", F.coalesce(change, num(0)).alias("energy"))


def zscore(signal: DataFrame, keys: list[str], column: str = "energy") -> DataFrame:
    """Centred, and scaled where there is anything to scale by."""
    w = Window.partitionBy(*keys)
    mean, std = F.avg(column).over(w), F.stddev_pop(column).over(w)
    return signal.withColumn("z", F.when(std > 1e-9, (F.col(column) - mean) / std).otherwise(F.col(column) - mean))


def _stretch(at: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    """By sample: how many rows, their sum and their sum of squares; a sample that isn't there has none."""
    return np.stack([np.bincount(at, minlength=n), np.bincount(at, weights=z, minlength=n), np.bincount(at, weights=z * z, minlength=n)]).astype(float)


def sliding_sums(a: np.ndarray, b: np.ndarray, lags: int) -> np.ndarray:
    """Four sums at each lag from -lags to lags: pairs, products, squares of a, squares of b. `a`: samples of a stretch, `b`: those from
    `lags` before it to `lags` after. By one transform of each row, so the time doesn't follow the number of lags."""
    size = 1 << (b.shape[1] + a.shape[1]).bit_length()
    fa, fb = np.conj(np.fft.rfft(a, size)), np.fft.rfft(b, size)
    sums = np.fft.irfft(np.stack([fa[0] * fb[0], fa[1] * fb[1], fa[2] * fb[0], fa[0] * fb[2]]), size)[:, : 2 * lags + 1]
    sums[0] = np.rint(sums[0])
    return sums


def offset_sweep(a: DataFrame, b: DataFrame, keys: list[str], stride: int = 10, max_lag: int = 600, least: int = 30, chunk: int = 4096) -> DataFrame:
    """Likeness of two signals at each lag: (keys, lag, n, corr), for lags with enough overlap.

    `a`, `b`: keys, sample_idx, energy. Signals are cut in chunks; a chunk of the first meets the same stretch of the second and
    as many samples around it as the largest lag has, so a sample is sent to its chunk and, near an end, to the next.
    Sums of chunks add up by lag. Samples may be missing or repeated."""
    lags = max_lag // stride
    chunk = max(chunk, lags, 1)
    place = F.floor(F.col("sample_idx") / chunk).cast("long")
    inside = F.pmod(F.col("sample_idx"), F.lit(chunk))
    around = F.concat(F.array(place), F.when(inside < lags, F.array(place - 1)).otherwise(F.array().cast("array<long>")), F.when(inside >= chunk - lags, F.array(place + 1)).otherwise(F.array().cast("array<long>")))
    left = zscore(a, keys).select(*keys, place.alias("chunk"), F.lit(True).alias("first"), F.col("sample_idx").cast("long").alias("sample_idx"), "z")
    right = zscore(b, keys).select(*keys, F.explode(around).alias("chunk"), F.lit(False).alias("first"), F.col("sample_idx").cast("long").alias("sample_idx"), "z")

    def fold(pdf: pd.DataFrame, part: np.ndarray) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
        first, at, z = pdf["first"].to_numpy(bool), pdf["sample_idx"].to_numpy(), pdf["z"].to_numpy(float)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        which, out = [], []
        for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            mine, i = first[lo:hi], at[lo:hi]
            if mine.any():
                begin, end = i[mine].min(), i[mine].max() + 1
                near = ~mine & (i >= begin - lags) & (i < end + lags)
                sums = sliding_sums(_stretch(i[mine] - begin, z[lo:hi][mine], end - begin), _stretch(i[near] - begin + lags, z[lo:hi][near], end - begin + 2 * lags), lags)
                some = np.flatnonzero(sums[0] > 0)
                which.append(np.full(len(some), k))
                out.append(np.vstack([some - lags, sums[:, some]]))
        if out:
            lag, n, *rest = np.concatenate(out, 1)
            yield np.concatenate(which), pd.DataFrame({"lag": lag.astype(np.int32), "n": n.astype(np.int64)} | dict(zip(("ab", "aa", "bb"), rest, strict=True)))

    parts = many_clips(left.unionByName(right), [*keys, "chunk"], ["sample_idx"], fold, "lag int, n long, ab double, aa double, bb double")
    sums = parts.groupBy(*keys, "lag").agg(*(F.sum(c).alias(c) for c in ("n", "ab", "aa", "bb")))
    norm = F.sqrt(F.greatest("aa", num(0))) * F.sqrt(F.greatest("bb", num(0)))
    return sums.where(F.col("n") >= least).select(*keys, "lag", "n", F.when(norm > 1e-9, F.col("ab") / norm).otherwise(num(0)).alias("corr"))


def best_offset(sweep: DataFrame, keys: list[str], stride: int = 10) -> DataFrame:
    """The best lag in frames, its likeness, how far ahead of the second it is, and whether to trust it."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("corr"), "lag"))
    top = sweep.withColumn("_r", rank).where("_r <= 2").groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col("lag"))).alias("_lag"), F.max("corr").alias("_c"), F.max(F.when(F.col("_r") == 2, F.col("corr"))).alias("_d"))
    margin = F.col("_c") - F.coalesce("_d", num(0))
    return top.select(*keys, (F.col("_lag") * stride).cast("int").alias("offset_frames"), rounded(F.col("_c")).alias("corr"), rounded(margin).alias("margin"), ((F.col("_c") < 0.3) | (margin < 0.05)).alias("doubtful"))


def labels_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places (y, x) of a mask's pixels in reading order, the 8-connected blob of each, and how many blobs there are, numbered in reading
    order of their first pixels.

    First the runs of pixels in each row; then the runs of neighbouring rows that touch, found by binary search, are given
    their least number, again and again until none changes."""
    h, w = mask.shape
    flat = np.zeros((h, w + 2), np.int8)
    flat[:, 1:-1] = mask
    edge = np.diff(flat.ravel(), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # of runs, in rows of w + 2
    up = w + 2
    low, high = np.searchsorted(end, start - up, "left"), np.searchsorted(start, end - up, "right")
    many = np.maximum(high - low, 0)
    below = np.repeat(np.arange(len(start)), many)
    above = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    root = np.arange(len(start))
    while True:
        a, b = root[below], root[above]
        apart = a != b
        if not apart.any():
            break
        below, above, a, b = below[apart], above[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    _, blob = np.unique(root, return_inverse=True)
    length = end - start
    cells = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
    return cells // up, cells % up - 1, np.repeat(blob, length), int(blob.max()) + 1 if len(blob) else 0


def components(mask: np.ndarray) -> list[np.ndarray]:
    """Places (y, x) of each 8-connected blob of a mask, in reading order of their first pixels."""
    y, x, blob, n = labels_of(mask)
    order = np.argsort(blob, kind="stable")
    return np.split(np.stack([y, x], 1)[order], np.cumsum(np.bincount(blob, minlength=n))[:-1]) if n else []


def blobs_of(heat: np.ndarray, threshold: float, least_area: int, most_area: int) -> tuple[np.ndarray, ...]:
    """(picture, x, y, peak, area) of the blobs of many heatmaps (n, height, width), each picture's surest first: centres weighted by the
    heatmap. The pictures lie below each other, a blank row between, so that all are labelled together."""
    n, h, w = heat.shape
    mask = np.zeros((n, h + 1, w), bool)
    mask[:, :h] = heat >= threshold
    row, x, blob, many = labels_of(mask.reshape(n * (h + 1), w))
    picture, y = np.divmod(row, h + 1)
    weight = heat[picture, y, x]
    area, total = np.bincount(blob, minlength=many), np.bincount(blob, weights=weight, minlength=many)
    peak, of = np.full(many, -np.inf), np.zeros(many, np.int64)
    np.maximum.at(peak, blob, weight)
    of[blob] = picture
    cx, cy = (np.bincount(blob, weights=weight * v, minlength=many) / np.where(total > 0, total, 1) for v in (x, y))
    keep = (area >= least_area) & (total > 0) & ((area <= most_area) if most_area else True)
    order = np.lexsort((-peak, of))
    order = order[keep[order]]
    return of[order], cx[order], cy[order], peak[order], area[order]


def blob_candidates(heat: np.ndarray, threshold: float, least_area: int, most_area: int) -> list[tuple[float, float, float, int]]:
    """(x, y, peak, area) of a heatmap's blobs, surest first: centres weighted by the heatmap."""
    return list(zip(*(a.tolist() for a in blobs_of(heat[None], threshold, least_area, most_area)[1:]), strict=True))


def pictures(column: pa.Array, most: int = 2000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Heatmaps (lists of rows) as arrays (n, height, width) with their places in the column, up to `most` at a time. Null and empty ones
    are left out."""
    tall = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    rows = column.flatten()
    wide, cells = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False), rows.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    first = np.cumsum(tall) - tall
    some = np.flatnonzero(tall)
    width = np.zeros(len(tall), np.int64)
    width[some] = wide[first[some]]
    if (np.repeat(width, tall) != wide).any():
        raise ValueError("rows of a heatmap differ in length")
    begin = np.cumsum(wide) - wide
    for h, w in sorted(set(zip(tall[some].tolist(), width[some].tolist(), strict=True))):
        same = np.flatnonzero((tall == h) & (width == w))
        for part in np.split(same, range(most, len(same), most)) if w else ():
            yield part, cells[begin[first[part]][:, None] + np.arange(h * w)].reshape(len(part), h, w)


def _with_blobs(frames: DataFrame, keys: list[str], net: tuple[int, int], full: tuple[int, int], threshold: float, least_area: int, most_area: int) -> DataFrame:
    """(keys, peak, blobs): a frame's blobs in full-resolution pixels, surest first."""
    threshold = max(threshold, 1e-6)
    sx, sy = full[0] / net[0], full[1] / net[1]
    kinds = dict(frames.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heat, found = batch.column(batch.num_columns - 1), []
            for part, maps in pictures(heat):
                of, *values = blobs_of(maps, threshold, least_area, most_area)
                found.append((part[of], *values))
            of, x, y, peak, area = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), *(np.zeros(0),) * 4)
            order = np.argsort(of, kind="stable")
            columns = {"u": pa.array(x[order] * sx), "v": pa.array(y[order] * sy), "confidence": pa.array(peak[order]), "area": pa.array(area[order].astype(np.int32))}
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))]).astype(np.int32)
            blobs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], blobs], [*batch.schema.names[:-1], "blobs"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", peak double, blobs array<struct<u: double, v: double, confidence: double, area: int>>"
    peak = F.array_max(F.transform("heatmap", F.array_max)).cast("double")
    return frames.select(*keys, peak.alias("peak"), "heatmap").mapInArrow(run, schema)


def detect_in_heatmaps(frames: DataFrame, keys: list[str], net: tuple[int, int], full: tuple[int, int], threshold: float = 0.5, least_area: int = 2, most_area: int = 0) -> DataFrame:
    """Blobs of heatmaps (keys, heatmap: array of rows) as candidates in full-resolution pixels, surest first: (keys,
    cand_idx, u, v, confidence, area). A frame without any gives no row."""
    found = _with_blobs(frames, keys, net, full, threshold, least_area, most_area).select(*keys, F.posexplode("blobs").alias("cand_idx", "b"))
    return found.select(*keys, "cand_idx", "b.u", "b.v", "b.confidence", "b.area")


def ball_in_heatmaps(frames: DataFrame, keys: list[str], net: tuple[int, int], full: tuple[int, int], crop: tuple[int, int, int, int] | None = None, region: Polygon = (), margin: float = 0.0, threshold: float = 0.5, least_area: int = 2, most_area: int = 0) -> DataFrame:
    """One row a frame: found, u, v, confidence and reason (ok, no-ball, out-of-court).

    The surest blob inside the region (dilated by the margin) is the ball; blobs of a crop of the full picture (x0, y0, x1,
    y1) are mapped back into it. Without one the confidence is the heatmap's peak. A frame with a null key has no ball."""
    x0, y0, x1, y1 = crop or (0, 0, *full)
    rows = _with_blobs(frames, keys, net, (x1 - x0, y1 - y0), threshold, least_area, most_area)
    moved = F.transform("blobs", lambda b: F.struct((b["u"] + num(x0)).alias("u"), (b["v"] + num(y0)).alias("v"), b["confidence"].alias("confidence")))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = rows.withColumn("_all", F.when(known, moved).otherwise(F.slice(moved, 1, 0)))
    rows = rows.withColumn("_in", F.filter("_all", lambda b: in_region(region, b["u"], b["v"], margin)))
    rows = rows.withColumn("reason", blob_reason(F.col("peak"), F.size("_all"), F.size("_in"), threshold)).withColumn("_b", F.get("_in", F.lit(0)))
    ok = F.col("reason") == "ok"
    return rows.select(*keys, ok.alias("found"), *(F.when(ok, F.col(f"_b.{c}")).alias(c) for c in "uv"), F.when(ok, F.col("_b.confidence")).otherwise(F.col("peak")).alias("confidence"), "reason")


def heatmap_hits(frames: DataFrame, tolerance: float) -> DataFrame:
    """Whether a heatmap's peak lies within the tolerance of the target (tx, ty), in network pixels."""
    row_max = F.transform("heatmap", lambda r: F.array_max(r))
    rows = frames.withColumn("_y", F.array_position(row_max, F.array_max(row_max)))
    rows = rows.withColumn("_row", F.element_at("heatmap", F.col("_y").cast("int"))).withColumn("_x", F.array_position(F.col("_row"), F.array_max("_row")))
    dx, dy = F.col("_x") - 1 - F.col("tx"), F.col("_y") - 1 - F.col("ty")
    return rows.withColumn("hit", F.sqrt(dx * dx + dy * dy) <= tolerance).drop("_x", "_y", "_row")
