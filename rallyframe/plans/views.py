"""Frame tables derived from the given tables: the columns an operator needs, computed from events, line items and embeddings.

A clip is a user of `events`, a frame the user's n-th event; camera B of a match is the user with the next id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import num

#: A homography of the pixel range of the views to the court, and two cameras (3x4, row by row).
H = (0.0031, 0.0002, -1.2, 0.0001, 0.0085, 2.0, 0.00002, 0.0004, 1.0)
CAMERA_A = (4200.0, 1990.0, -260.0, 1300.0, 0.0, 1650.0, -3900.0, 20500.0, 0.0, 1.0, -0.35, 4.0)
ROI = [(300, 200), (3400, 150), (3700, 1500), (2600, 2000), (900, 2050), (100, 1300)]
OFFSET = 3
FPS = 20.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, frame, found, u, v, confidence, event_id, event_type."""
    found = F.col("event_type") != "error"
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("clip"),
        frame.alias("frame"),
        found.alias("found"),
        F.when(found, 1920.0 + (F.col("value") - 50.0) * 20.0).alias("u"),
        F.when(found, 1080.0 + (k - 50.0) * 10.0).alias("v"),
        ((1 + F.col("event_id") % 100) / num(100)).alias("confidence"),
        "event_id",
        "event_type",
    )


OBS = """obs AS (
    SELECT user_id AS clip, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS frame,
           event_type <> 'error' AS found,
           CASE WHEN event_type <> 'error' THEN 1920e0 + (value - 50e0) * 20e0 END AS u,
           CASE WHEN event_type <> 'error' THEN 1080e0 + (regexp_extract(props, '([0-9]+)', 1)::DOUBLE - 50e0) * 10e0 END AS v,
           (1 + event_id % 100) / 100e0 AS confidence, event_id, event_type
    FROM events)"""


def cameras(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Camera A (even clips) and B (odd ones) of matches."""
    side = lambda r: obs.where(F.col("clip") % 2 == r).withColumn("match", F.floor(F.col("clip") / 2).cast("long"))
    return side(0), side(1)


CAMS = """cam_a AS (SELECT *, clip // 2 AS match FROM obs WHERE clip % 2 = 0), cam_b AS (SELECT *, clip // 2 AS match FROM obs WHERE clip % 2 = 1)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from line items: frame l_orderkey, det_idx l_linenumber; a clip has 1,000 frames, so clips grow in number, not in length."""
    x1, y1 = F.col("l_quantity") * 8.0, F.col("l_extendedprice") / 500.0
    return read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1000).cast("long").alias("clip"),
        F.col("l_orderkey").alias("frame"),
        F.col("l_linenumber").alias("det_idx"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 60.0 + F.col("l_discount") * 400.0).alias("x2"),
        (y1 + 90.0 + F.col("l_tax") * 800.0).alias("y2"),
        (num(0.2) + F.col("l_discount") * 7.0).alias("conf"),
        "l_partkey",
        "l_suppkey",
        "l_discount",
        "l_tax",
    )


BOXES = """boxes AS (
    SELECT l_orderkey // 1000 AS clip, l_orderkey AS frame, l_linenumber AS det_idx, l_quantity * 8e0 AS x1, l_extendedprice / 500e0 AS y1,
           l_quantity * 8e0 + 60e0 + l_discount * 400e0 AS x2, l_extendedprice / 500e0 + 90e0 + l_tax * 800e0 AS y2,
           0.2e0 + l_discount * 7e0 AS conf, l_partkey, l_suppkey, l_discount, l_tax
    FROM lineitem)"""


def r(expression: str, digits: int = 4) -> str:
    """SQL of `geometry.rounded`."""
    return f"floor(({expression}) * 1e{digits} + 0.5e0) / 1e{digits}"


def projected(m: tuple[float, ...], u: str = "u", v: str = "v") -> tuple[str, str, str]:
    """SQL of the three rows of a projective map."""
    return tuple(f"({m[3 * i]!r}::DOUBLE * {u} + {m[3 * i + 1]!r}::DOUBLE * {v} + {m[3 * i + 2]!r}::DOUBLE)" for i in range(3))
