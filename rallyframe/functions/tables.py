"""Table functions for SQL, to be used with LATERAL: points of line segments, and of a ball's arc between two contacts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schemas import GRAVITY


def _numbers(name: str, given: list[AnalyzeArgument], integers: tuple[int, ...]) -> None:
    for k, argument in enumerate(given):
        kind = argument.dataType.typeName()
        if kind not in ("tinyint", "smallint", "integer", "bigint", "byte", "short", "long") + (() if k in integers else ("float", "double", "decimal", "void")):
            raise ValueError(f"{name}: argument {k + 1} is {kind}, which it can't be")


class SegmentPoints:
    """segment_points(x1, y1, x2, y2, n): n evenly spaced points (k, x, y), both ends included, as `courts.sample_segments` gives."""

    @staticmethod
    def analyze(x1: AnalyzeArgument, y1: AnalyzeArgument, x2: AnalyzeArgument, y2: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        _numbers("segment_points", [x1, y1, x2, y2, n], (4,))
        if n.isConstantExpression and n.value is not None and n.value < 2:
            raise ValueError("segment_points: a segment has two points at least")
        return AnalyzeResult(StructType().add("k", IntegerType()).add("x", "double").add("y", "double"))

    def eval(self, x1: float, y1: float, x2: float, y2: float, n: int) -> Iterator[tuple]:
        if None in (x1, y1, x2, y2, n):
            return
        x1, y1, x2, y2 = map(float, (x1, y1, x2, y2))
        for k in range(n):
            share = k / float(n - 1)
            yield k, x1 + (x2 - x1) * share, y1 + (y2 - y1) * share


class ArcPoints:
    """arc_points(first, last, x1, y1, x2, y2, fps): a row (frame, x_m, y_m, z_m) for each frame between two floor contacts, as
    `sequences.ballistic_arcs` gives: straight over the floor, a parabola in height. No rows if a number is null or the last
    frame isn't after the first."""

    @staticmethod
    def analyze(first: AnalyzeArgument, last: AnalyzeArgument, x1: AnalyzeArgument, y1: AnalyzeArgument, x2: AnalyzeArgument, y2: AnalyzeArgument, fps: AnalyzeArgument) -> AnalyzeResult:
        _numbers("arc_points", [first, last, x1, y1, x2, y2, fps], (0, 1))
        if fps.isConstantExpression and fps.value is not None and fps.value <= 0:
            raise ValueError("arc_points: frames a second must be over 0")
        return AnalyzeResult(StructType().add("frame", IntegerType()).add("x_m", "double").add("y_m", "double").add("z_m", "double"))

    def eval(self, first: int, last: int, x1: float, y1: float, x2: float, y2: float, fps: float) -> Iterator[tuple]:
        if None in (first, last, x1, y1, x2, y2, fps) or last <= first:
            return
        x1, y1, x2, y2, fps = map(float, (x1, y1, x2, y2, fps))
        total = (last - first) / fps
        for frame in range(first, last + 1):
            tau = (frame - first) / fps
            share = tau / total
            yield frame, x1 + (x2 - x1) * share, y1 + (y2 - y1) * share, max(0.0, 0.5 * GRAVITY * total * tau - 0.5 * GRAVITY * tau * tau)


def register(spark: SparkSession) -> None:
    """Make `segment_points` and `arc_points` known to the session's SQL."""
    spark.udtf.register("segment_points", udtf(SegmentPoints))
    spark.udtf.register("arc_points", udtf(ArcPoints))
