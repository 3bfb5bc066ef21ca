"""Joins of frame tables: lockstep of cameras, gaps, nearest neighbours, clusters, event matching, guards."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import TRANSFORMS
from .clips import per_clip


def sync_join(a: DataFrame, b: DataFrame, offset: int, keys: list[str], how: str = "inner") -> DataFrame:
    """Frame f of camera A beside frame f + offset of camera B. Columns of B get the suffix _b, A's own stay."""
    right = b.select(*keys, (F.col("frame") - offset).cast("int").alias("frame"), *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in (*keys, "frame")))
    return a.join(right, [*keys, "frame"], how).withColumn("frame_b", F.col("frame") + offset)


def triangulation_gaps(a: DataFrame, b: DataFrame, labelled: DataFrame, offset: int, keys: list[str], least_conf: float = 0.5) -> DataFrame:
    """Frames of camera B to label: A sees the ball surely, B does not, and there is no label yet."""
    pairs = sync_join(a, b, offset, keys).where(F.col("found") & (F.col("confidence") >= least_conf) & ~F.col("found_b"))
    gaps = pairs.select(*keys, F.col("frame_b").alias("frame"), F.lit("tri_gap").alias("reason"), F.lit(1).alias("priority"), F.col("confidence").alias("side1_conf"))
    return gaps.join(labelled.select(*keys, "frame").distinct(), [*keys, "frame"], "left_anti")


def nearest_distance(a: DataFrame, b: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """For each point of `a` (keys, id, x, y) the distance to the nearest of `b` in the same frame; points without any are left out."""
    right = b.select(*keys, F.col("x").alias("x_b"), F.col("y").alias("y_b"))
    dx, dy = F.col("x") - F.col("x_b"), F.col("y") - F.col("y_b")
    return a.join(right, keys).groupBy(*keys, id_).agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("nn_dist"))


def transform_check(a: DataFrame, b: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """How near the second camera's points come under each candidate transform of its court frame.

    Each point fans out to four rows (the transforms), not to the other table's rows."""
    options = [F.struct(F.lit(name).alias("transform"), *(c.alias(n) for c, n in zip(f(F.col("x"), F.col("y")), ("tx", "ty"), strict=True))) for name, f in TRANSFORMS.items()]
    turned = b.withColumn("_t", F.explode(F.array(*options))).select(*keys, "_t.transform", F.col("_t.tx").alias("x"), F.col("_t.ty").alias("y"))
    dx, dy = F.col("x") - F.col("x_b"), F.col("y") - F.col("y_b")
    near = a.join(turned.select(*keys, "transform", F.col("x").alias("x_b"), F.col("y").alias("y_b")), keys).groupBy(*keys, id_, "transform").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("d"))
    stats = near.groupBy("transform").agg(F.count("*").alias("n"), F.percentile("d", F.lit(0.5)).alias("median"), F.percentile("d", F.lit(0.25)).alias("p25"), F.min("d").alias("least"))
    best = Window.orderBy("median", "transform")  # four rows
    return stats.withColumn("best", F.row_number().over(best) == 1)


def cluster(points: DataFrame, keys: list[str], radius: float = 1.5) -> DataFrame:
    """Greedy clusters within a frame: in the order of `cand_idx` each free point seeds a cluster and takes every later
    free point within the radius. Adds `seed` and `is_rep` (the highest box `bh`, of equals the first).

    A frame has a handful of points, so this is a fold over one short array, inside the JVM."""
    order = F.array_sort(F.collect_list(F.struct("cand_idx", "x", "y", "bh")))
    start = F.array().cast("array<struct<seed: int, x: double, y: double, cand_idx: int, bh: double>>")

    def add(seen: Column, p: Column) -> Column:
        near = F.filter(seen, lambda s: (s["seed"] == s["cand_idx"]) & ((s["x"] - p["x"]) * (s["x"] - p["x"]) + (s["y"] - p["y"]) * (s["y"] - p["y"]) <= radius * radius))
        seed = F.when(F.size(near) > 0, F.element_at(near, 1)["seed"]).otherwise(p["cand_idx"])
        return F.concat(seen, F.array(F.struct(seed.cast("int").alias("seed"), p["x"].alias("x"), p["y"].alias("y"), p["cand_idx"].cast("int").alias("cand_idx"), p["bh"].alias("bh"))))

    folded = points.groupBy(*keys).agg(order.alias("_p")).withColumn("_c", F.explode(F.aggregate("_p", start, add)))
    flat = folded.select(*keys, "_c.cand_idx", "_c.seed", "_c.x", "_c.y", "_c.bh")
    rank = F.row_number().over(Window.partitionBy(*keys, "seed").orderBy(F.desc("bh"), "cand_idx"))
    return flat.withColumn("is_rep", rank == 1)


def match_events(predicted: DataFrame, truth: DataFrame, tolerance: int, keys: list[str]) -> DataFrame:
    """Greedy one-to-one match: predictions by frame, each takes the nearest free truth within the tolerance, the
    earlier of equally near ones. Gives rows (keys, pred_frame, true_frame); one of them is null for what is left."""
    rows = predicted.select(*keys, "frame", F.lit(True).alias("_pred")).unionByName(truth.select(*keys, "frame", F.lit(False).alias("_pred")))

    def fold(pdf: pd.DataFrame) -> Iterable[tuple]:
        free = sorted(pdf.loc[~pdf["_pred"], "frame"].tolist())
        for f in sorted(pdf.loc[pdf["_pred"], "frame"].tolist()):
            k = bisect_left(free, f)
            near = [i for i in (k - 1, k) if 0 <= i < len(free) and abs(free[i] - f) <= tolerance]
            yield (f, free.pop(min(near, key=lambda i: (abs(free[i] - f), i))) if near else None)
        for t in free:
            yield (None, t)

    return per_clip(rows, keys, ["frame"], fold, "pred_frame int, true_frame int")


def with_places(matches: DataFrame, predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Matches (of `match_events`) with the places and calls of both sides: x_m, y_m and in_court with the prefixes
    pred_ and true_. An event's frame is its key."""
    side = lambda rows, name: rows.select(*keys, F.col("frame").alias(f"{name}_frame"), *(F.col(c).alias(f"{name}_{c}") for c in ("x_m", "y_m", "in_court")))
    return matches.join(side(predicted, "pred"), [*keys, "pred_frame"], "left").join(side(truth, "true"), [*keys, "true_frame"], "left")


def band_pairs(a: DataFrame, b: DataFrame, tolerance: int, keys: list[str]) -> DataFrame:
    """All pairs of frames within the tolerance, as an equi-join: frames are cut in bands as wide as the tolerance, and
    each row of `b` looks into its own band and the two beside it."""
    width = max(1, tolerance)
    left = a.withColumn("_band", F.floor(F.col("frame") / width))
    right = b.select(*keys, F.col("frame").alias("frame_b"), F.explode(F.array(*(F.floor(F.col("frame") / width) + d for d in (-1, 0, 1)))).alias("_band"))
    return left.join(right, [*keys, "_band"]).where(F.abs(F.col("frame") - F.col("frame_b")) <= tolerance).drop("_band")


def outside_events(frames: DataFrame, events: DataFrame, guard: int, keys: list[str]) -> DataFrame:
    """Frames farther than `guard` from every event."""
    near = events.select(*keys, F.explode(F.sequence(F.col("frame") - guard, F.col("frame") + guard)).alias("frame")).distinct()
    return frames.join(near, [*keys, "frame"], "left_anti")


def frames_needed(centres: DataFrame, keys: list[str], before: int = 2) -> DataFrame:
    """The frames that a model of before + 1 frames needs for each centre."""
    return centres.select(*keys, F.explode(F.sequence(F.col("frame") - before, F.col("frame"))).alias("frame")).where("frame >= 0").distinct()


def non_maximum_suppression(boxes: DataFrame, keys: list[str], threshold: float = 0.6) -> DataFrame:
    """Boxes of a frame by falling score (of equals the later index first), without those that overlap a kept one
    by `threshold` or more. A fold over the frame's short array."""
    order = F.reverse(F.array_sort(F.collect_list(F.struct("conf", "det_idx", "x1", "y1", "x2", "y2"))))
    start = F.array().cast("array<struct<conf: double, det_idx: int, x1: double, y1: double, x2: double, y2: double>>")

    def overlap(a: Column, b: Column) -> Column:
        from ..functions.geometry import iou

        return iou([a[c] for c in ("x1", "y1", "x2", "y2")], [b[c] for c in ("x1", "y1", "x2", "y2")])

    def add(kept: Column, p: Column) -> Column:
        return F.when(F.exists(kept, lambda k: overlap(k, p) >= threshold), kept).otherwise(F.concat(kept, F.array(p)))

    return boxes.groupBy(*keys).agg(order.alias("_p")).withColumn("_k", F.explode(F.aggregate("_p", start, add))).select(*keys, "_k.*")
