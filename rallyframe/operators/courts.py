"""Small relations and predicates of the court and of detections: lines, samples, tiles, shapes, ownership, jobs' glue."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cameras import LANDMARKS, LINES
from ..functions.geometry import num
from ..schemas import NET_Y


def court_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *a, *b) for n, (a, b) in LINES.items()], "line string, x1 double, y1 double, x2 double, y2 double")


def landmarks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *p) for n, p in LANDMARKS.items()], "name string, x double, y double")


def sample_segments(segments: DataFrame, n: int = 60) -> DataFrame:
    """n evenly spaced points of each segment (x1, y1, x2, y2), both ends included."""
    share = F.col("k") / num(n - 1)
    rows = segments.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumns({"x": F.col("x1") + (F.col("x2") - F.col("x1")) * share, "y": F.col("y1") + (F.col("y2") - F.col("y1")) * share})


def frame_range(frames: DataFrame, start: int = 0, n: int | None = None) -> DataFrame:
    """Frames from `start`, `n` of them if given, by their numbers, so that the scan can skip row groups."""
    out = frames.where(F.col("frame") >= start)
    return out if n is None else out.where(F.col("frame") < start + n)


def tile_to_frame(boxes: DataFrame, tile_w: int, tile_h: int, overlap: float = 0.2) -> DataFrame:
    """Boxes found in tiles (row, col) moved to the whole frame."""
    dx, dy = F.col("col") * num(tile_w * (1 - overlap)), F.col("row") * num(tile_h * (1 - overlap))
    return boxes.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy})


def ball_shaped(area: Column, perimeter: Column, least: float = 8, most: float = 1500, roundness: float = 0.35) -> Column:
    """A contour small and round enough for a ball."""
    return area.between(least, most) & (perimeter > 0) & (4 * math.pi * area / (perimeter * perimeter) >= roundness)


def best_blob(contours: DataFrame, keys: list[str]) -> DataFrame:
    """The roundest ball-shaped contour of each frame; of equals the first."""
    rows = contours.where(ball_shaped(F.col("area"), F.col("perimeter"))).withColumn("roundness", 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter")))
    return rows.groupBy(*keys).agg(F.max_by(F.struct("cand_idx", "u", "v", "roundness"), F.struct("roundness", -F.col("cand_idx"))).alias("b")).select(*keys, "b.*")


def blob_reason(peak: Column, n_blobs: Column, n_in_region: Column, threshold: float = 0.5) -> Column:
    """Why a frame has a ball or none."""
    return F.when(peak < max(threshold, 1e-6), "no-ball").when(n_blobs == 0, "no-ball").when(n_in_region == 0, "out-of-court").otherwise("ok")


def owns(cam: Column, y: Column) -> Column:
    """Each camera answers for the half that is nearer to it; y in the global frame."""
    return F.when(cam == "A", y < NET_Y).otherwise(y >= NET_Y)


def yellow_enough(fraction: Column, least: float = 0.06) -> Column:
    return F.coalesce(fraction >= least, F.lit(False))


def distinct_ids(rows: DataFrame, keys: list[str], column: str = "player_id") -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(column)).alias("ids"))
