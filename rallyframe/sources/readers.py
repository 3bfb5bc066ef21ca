"""Readers of label files, frame logs and configurations. All tolerate what cannot be parsed, as each says."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import lenient_bool, lenient_number
from ..schemas import FRAME_LOG


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Strings of the named columns, null where the file has no such column; a file name that matches nothing gives no rows."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if found is None or len(found) == 0:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*((F.trim(F.col(f"`{c}`")) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in columns))


def config(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration written by `writers.write_config`."""
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small document


def read_profiles(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """Identities of an earlier run (keys, player_id, hist, x, y), from `writers.write_profiles`. Their places are of that run,
    so `players.identify` takes them for stale."""
    rows = spark.read.schema(f"{keys}, player_id int, hist array<double>, x double, y double").json(path)
    return rows.where("player_id is not null")


def labels_latest(spark: SparkSession, path: str) -> DataFrame:
    """(frame, visible, u, v): for a repeated frame the last row counts; visible without a place is not visible."""
    raw = _csv(spark, path, ["frame", "visible", "u", "v"]).withColumn("_i", F.monotonically_increasing_id())
    rows = raw.select("_i", F.col("frame").cast("int").alias("frame"), (F.col("visible").cast("int") == 1).alias("_seen"), lenient_number(F.col("u")).alias("u"), lenient_number(F.col("v")).alias("v"))
    seen = F.coalesce(F.col("_seen") & F.col("u").isNotNull() & F.col("v").isNotNull(), F.lit(False))
    rows = rows.select("_i", "frame", seen.cast("int").alias("visible"), F.when(seen, F.col("u")).alias("u"), F.when(seen, F.col("v")).alias("v"))
    return rows.groupBy("frame").agg(F.max_by(F.struct("visible", "u", "v"), "_i").alias("_r")).select("frame", "_r.*")


def labels_all(spark: SparkSession, path: str) -> DataFrame:
    """(frame, visible, u, v) of every row with a frame, repeated frames included."""
    raw = _csv(spark, path, ["frame", "visible", "u", "v"])
    seen = F.lower("visible").isin("1", "1.0", "true")
    return raw.select(F.col("frame").try_cast("double").cast("int").alias("frame"), F.coalesce(seen, F.lit(False)).cast("int").alias("visible"), lenient_number(F.col("u")).alias("u"), lenient_number(F.col("v")).alias("v")).where("frame is not null")


def event_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of BALL_EVENT; only the frame is required, anything else that can't be parsed is null."""
    raw = _csv(spark, path, ["frame", "type", "u", "v", "x_m", "y_m", "in_court"])
    numbers = [lenient_number(F.col(c)).alias(c) for c in ("u", "v", "x_m", "y_m")]
    return raw.select(F.col("frame").try_cast("double").cast("int").alias("frame"), F.nullif("type", F.lit("")).alias("type"), *numbers, lenient_bool(F.col("in_court")).alias("in_court")).where("frame is not null")


def frame_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct frames of any file with a frame column; rows without a whole number are skipped."""
    return _csv(spark, path, ["frame"]).select(F.col("frame").try_cast("int").alias("frame")).dropna().distinct()


def hard_frames(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path, ["frame", "reason", "priority", "hint_u", "hint_v", "confidence"])
    return raw.select(F.col("frame").try_cast("int").alias("frame"), "reason", F.col("priority").try_cast("int").alias("priority"), *(lenient_number(F.col(c)).alias(c) for c in ("hint_u", "hint_v", "confidence"))).where("frame is not null")


def frame_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of FRAME_LOG from JSON lines, with `corrupt` (the line's text) where a line can't be parsed; NUL bytes are dropped,
    blank lines skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\u0000", "").alias("value")).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{FRAME_LOG}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col("r.frame").isNull()
    return parsed.select("r.*", F.when(bad, F.col("value")).alias("corrupt")).drop("_bad")


def predicted_bounces(spark: SparkSession, path: str) -> DataFrame:
    """Floor bounces of a frame log; lines that can't be parsed are skipped."""
    return frame_log(spark, path).where("corrupt is null and event.type = 'floor_bounce'").select("event.*")


def track_points(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A frame log's track points and its breaking events."""
    good = log.where("corrupt is null")
    points = good.where("track is not null").select("frame", F.col("track.x").alias("u"), F.col("track.y").alias("v"), "track.measured", "confidence", "track.status")
    breaking = good.where(F.col("event.type").isin("floor_bounce", "wall_bounce", "hit")).select("event.*")
    return points, breaking


def triangulated_points(log: DataFrame) -> DataFrame:
    std = F.coalesce("ball3d.std", F.array(F.lit(0.3), F.lit(0.3), F.lit(0.3)))
    return log.where("corrupt is null and ball3d is not null").select("frame", "ball3d.x", "ball3d.y", "ball3d.z", std.alias("std"))


def visible_positions(labels: DataFrame) -> DataFrame:
    return labels.where("visible = 1").select("frame", "u", "v")


def wide_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """One row a frame with `keypoints`, an array of 17 structs, from 51 columns; blanks are 0. Raises if they are missing."""
    raw = spark.read.option("header", True).csv(path)
    if "kp0_x" not in raw.columns:
        raise ValueError("no keypoint columns")
    value = lambda i, c: F.coalesce(lenient_number(F.col(f"kp{i}_{c}")), F.lit(0.0)).alias(c)
    points = F.array(*(F.struct(*(value(i, c) for c in "xyc")) for i in range(17)))
    return raw.select(*(c for c in raw.columns if not c.startswith("kp")), points.alias("keypoints"))


def keypoint_bounds(rows: DataFrame, keys: list[str], least_conf: float = 0.3) -> DataFrame:
    """Box around the confident keypoints and the boxes' corners."""
    p = rows.select(*keys, F.explode(F.concat(F.filter("keypoints", lambda k: k["c"] >= least_conf), F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1.0).alias("c")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(1.0).alias("c"))))).alias("p"))
    return p.groupBy(*keys).agg(F.min("p.x").alias("x_min"), F.min("p.y").alias("y_min"), F.max("p.x").alias("x_max"), F.max("p.y").alias("y_max"))


def clip_inventory(clips: DataFrame, labels: DataFrame) -> DataFrame:
    """Clips that have labels, with how many; clips without a frame rate can't be read and are left out."""
    n = labels.groupBy("clip").agg(F.count("*").alias("n_labels"), F.count_if(F.col("visible") == 1).alias("n_visible"))
    return clips.where("fps > 0").join(n, "clip")


