"""Sinks: long and wide rows of players, label files, frame logs, trajectories, summaries, identities, configurations."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cameras import fit_homography
from ..functions.geometry import num, rounded, slug
from ..schemas import COURT_LENGTH, COURT_WIDTH


def movement_rows(frames: DataFrame, fps: float, keys: list[str]) -> DataFrame:
    """(keys, frame, time_s, player_id, x_m, y_m) from frames with `players`, an array of structs; players without an
    id or a place are left out."""
    rows = frames.select(*keys, "frame", F.explode("players").alias("p")).where("p.player_id is not null and p.x is not null")
    return rows.select(*keys, "frame", rounded(F.col("frame") / num(fps), 3).alias("time_s"), "p.player_id", rounded(F.col("p.x"), 3).alias("x_m"), rounded(F.col("p.y"), 3).alias("y_m"))


def keypoint_columns(rows: DataFrame) -> DataFrame:
    """The 17 keypoints spread over 51 columns; only players 1 to 4."""
    wide = [F.element_at("keypoints", i + 1)[c].alias(f"kp{i}_{c}") for i in range(17) for c in "xyc"]
    return rows.where(F.col("player_id").between(1, 4)).select(*(c for c in rows.columns if c != "keypoints"), *wide)


def write_players(rows: DataFrame, path: str) -> None:
    """One folder for each player."""
    keypoint_columns(rows).write.partitionBy("player_id").mode("overwrite").option("header", True).csv(path)


def label_lines(labels: DataFrame) -> DataFrame:
    place = lambda c: F.when(F.col("visible") == 1, F.format_string("%.1f", rounded(F.col(c), 1)))
    return labels.select("frame", "visible", place("u").alias("u"), place("v").alias("v"))


def write_labels(labels: DataFrame, path: str) -> None:
    """Sorted by frame, in as many files as the sort gives; places with one digit, blank where nothing is visible."""
    label_lines(labels).orderBy("frame").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    rows.select(columns).orderBy(*order).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_locations(placed: DataFrame, path: str, order: list[str]) -> None:
    """Places of a dual view (rows of `sequences.placement`) as CSV, blank where the ball is lost."""
    metres = [rounded(F.col(c), 3).alias(c) for c in ("court_x_m", "court_y_m", "court_z_m")]
    write_csv(placed.select(*order, "source", *metres), path, [*order, "source", "court_x_m", "court_y_m", "court_z_m"], order)


def write_log(log: DataFrame, path: str) -> None:
    """JSON lines; fields without a value are left out."""
    log.write.mode("overwrite").json(path)


def last_arc_points(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """One point a frame: where arcs share a frame, that of the later one."""
    point = F.struct(*(rounded(F.col(c), 4).alias(c) for c in ("x_m", "y_m", "z_m")), F.col("seg_id").alias("arc"))
    return arcs.groupBy(*keys, "frame").agg(F.max_by(point, "seg_id").alias("p")).select(*keys, "frame", "p.*")


def summary_document(summary: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return summary.select(F.to_json(F.struct("*")).alias("document"))


def output_name(source, kind: str):
    """`<kind>_<slug of the source>.csv` as a column."""
    return F.concat(F.lit(f"{kind}_"), slug(source), F.lit(".csv"))


def write_profiles(states: DataFrame, path: str) -> None:
    """Identities (rows of `players.identity_states`), one JSON line for each profile, as `readers.read_profiles` takes them."""
    states.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def calibrated(config: dict, image: list[tuple[float, float]], world: list[tuple[float, float]]) -> dict:
    """A camera's configuration with the homography of landmarks clicked in the image, and the points themselves."""
    points, metres = np.array(image, float), np.array(world, float)
    h, error = fit_homography(points, metres)
    block = {
        "image_points": points.tolist(),
        "world_points": metres.tolist(),
        "H": h.tolist(),
        "H_inv": np.linalg.inv(h).tolist(),
        "reprojection_error_m": {k: round(error[k], 4) for k in ("mean", "max")},
        "court_dimensions_m": {"width": COURT_WIDTH, "length": COURT_LENGTH},
    }
    return config | {"homography": block}


def synchronised(config: dict, offset: int, method: str = "manual") -> dict:
    """A camera's configuration with the other camera's offset in frames."""
    return config | {"sync": config.get("sync", {}) | {"offset_frames": int(offset), "method": method}}


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """A configuration as one JSON document, as `readers.read_config` takes it."""
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(path)
