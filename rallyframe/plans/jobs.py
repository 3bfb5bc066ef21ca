"""End-to-end jobs: the operators in the order in which a match is worked on.

All of a job's stages are keyed by clip or match, so the rows of a match meet in one task and matches run side by side."""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cameras import Camera, triangulated
from ..functions.geometry import Matrix, Polygon, box_center, foot_point, in_court, in_polygon, in_region, num, project, rounded, to_global, transform_point
from ..operators import bytetrack, courts, joins, metrics, physics, players, sequences, tracking
from ..operators.clips import per_clip
from ..operators.courts import owns
from ..schemas import EkfConfig, EventConfig, IdentityConfig, MiningConfig, TrackerConfig


def events_from_labels(labels: DataFrame, homography: Matrix, fps: float, stride: int, tracker: TrackerConfig = TrackerConfig(), cfg: EventConfig = EventConfig()) -> DataFrame:
    """Events on a hand-labelled track (clip, frame, visible, u, v): every label counts as sure, and a step lasts as many
    frames as labels lie apart (see `frame_stride`)."""
    seen = F.col("visible") == 1
    rows = labels.select("clip", "frame", F.lit(0).alias("cand_idx"), F.when(seen, F.col("u")).alias("u"), F.when(seen, F.col("v")).alias("v"), num(1).alias("confidence"))
    return tracking.tracked_events(rows, homography, TrackerConfig(**{**tracker.__dict__, "dt": stride / fps}), cfg)


def ball_evaluation(candidates: DataFrame, homography: Matrix, roi: Polygon = (), margin: float = 200.0, tracker: TrackerConfig = TrackerConfig(), cfg: EventConfig = EventConfig()) -> DataFrame:
    """A frame log of one camera: detection, track, event."""
    inside = candidates.withColumn("_in", F.col("u").isNull() | in_region(roi, F.col("u"), F.col("v"), margin))
    rows = inside.withColumns({c: F.when(F.col("_in"), F.col(c)) for c in ("u", "v", "confidence")}).drop("_in")
    best = rows.groupBy("clip", "frame").agg(F.max_by(F.struct("u", "v", "confidence"), F.struct("confidence", -F.col("cand_idx"))).alias("d"))
    track = tracking.track(rows, tracker)
    events = tracking.events(track, homography, cfg).select("clip", "frame", F.struct("type", "u", "v", "x_m", "y_m", "in_court").alias("event"))
    log = best.select("clip", "frame", F.col("d.u").isNotNull().alias("found"), "d.*")
    names = [c for c in track.columns if c not in ("clip", "frame")]
    return log.join(track.select("clip", "frame", F.struct(*names).alias("track")), ["clip", "frame"]).join(events, ["clip", "frame"], "left")


def ball_fusion(log_a: DataFrame, log_b: DataFrame, a: Camera, b: Camera, offset: int, fps: float, max_reproj_px: float = 40.0) -> DataFrame:
    """Both cameras' logs (match, frame, measured, meas_u, meas_v) in lockstep, with the ball in space where both measure it
    and the rays meet. Speed is over the frames that lie between."""
    left = log_a.select("match", "frame", "measured", "meas_u", "meas_v")
    both = joins.sync_join(left, log_b.select("match", "frame", "measured", "meas_u", "meas_v"), offset, ["match"])
    seen = F.col("measured") & F.col("measured_b")
    pick = lambda c: F.when(seen, F.col(c))
    rows = both.withColumn("ball3d", triangulated(a, b, max_reproj_px)(pick("meas_u"), pick("meas_v"), pick("meas_u_b"), pick("meas_v_b")))
    rows = rows.withColumn("rejected", F.when(seen & F.col("ball3d").isNull(), "epipolar"))
    points = rows.where("ball3d is not null").select("match", "frame", "ball3d.x", "ball3d.y", "ball3d.z")
    speeds = sequences.with_speed(points, fps, ["match"]).select("match", "frame", "speed_kmh")
    return rows.join(speeds, ["match", "frame"], "left")


def fusion_summary(fused: DataFrame) -> DataFrame:
    has = F.col("ball3d").isNotNull()
    z = F.col("ball3d.z")
    return fused.groupBy("match").agg(F.count("*").alias("n_frames"), F.count_if(has).alias("n_3d"), rounded(F.count_if(has) / F.count("*")).alias("triangulation_rate"), F.avg("ball3d.reproj_px").alias("mean_reproj_px"), F.min(z).alias("z_min"), F.percentile(z, F.lit(0.5)).alias("z_median"), F.max(z).alias("z_max"))


def ball_3d(log_a: DataFrame, log_b: DataFrame, events_a: DataFrame, a: Camera, b: Camera, homography: Matrix, offset: int, fps: float, cfg: EkfConfig = EkfConfig()) -> DataFrame:
    """The ball's trajectory of each match: fusion, filter and smoother, then output rows with where each comes from.

    `log_a`, `log_b`: match, frame, measured, meas_u, meas_v, confidence, x, y (the track); `events_a`: match, frame, type,
    x_m, y_m."""
    fused = ball_fusion(log_a, log_b, a, b, offset, fps).select("match", "frame", "ball3d")
    one = events_a.groupBy("match", "frame").agg(F.max_by(F.struct("type", "x_m", "y_m"), "type").alias("e"))
    log = log_a.join(fused, ["match", "frame"], "left").join(one, ["match", "frame"], "left")
    state = log.select("match", "frame", "measured", F.col("meas_u").alias("u"), F.col("meas_v").alias("v"), "confidence", F.col("x").alias("track_x"), F.col("y").alias("track_y"), F.col("ball3d.x").alias("x3"), F.col("ball3d.y").alias("y3"), F.col("ball3d.z").alias("z3"), F.col("ball3d.std").alias("std3"), F.col("e.type").alias("event_type"), F.col("e.x_m").alias("event_x"), F.col("e.y_m").alias("event_y"))
    path = physics.trajectory(state, a.p, homography, fps, ["match"], cfg)
    return sequences.provenance(path, log.select("match", "frame", "measured", "meas_u", "meas_v", F.col("x").alias("track_x"), F.col("y").alias("track_y"), F.col("ball3d").isNotNull().alias("has_3d"), F.col("e.type").alias("event")), fps, ["match"])


def seeded_hold_out(points: DataFrame, keys: list[str], share: float = 0.3, seed: int = 0) -> DataFrame:
    """(keys, frame) of a seeded sample of each clip's frames: `share` of them, at least one; none of a clip with under six."""

    def fold(pdf: pd.DataFrame) -> Iterable[tuple]:
        frames = sorted(set(pdf["frame"].tolist()))
        if len(frames) >= 6:
            for k in draw_held_out(len(frames), share, seed):
                yield (int(frames[k]),)

    return per_clip(points.select(*keys, "frame"), keys, ["frame"], fold, "frame int")


def height_validation(state: DataFrame, camera: Camera, homography: Matrix, fps: float, keys: list[str], share: float = 0.3, seed: int = 0) -> DataFrame:
    """How well heights come back where triangulated points are withheld: absolute errors' median, mean and p90, over all clips.

    Which points are withheld is drawn in each clip with the seed (`seeded_hold_out`)."""
    held = seeded_hold_out(state.where("z3 is not null"), keys, share, seed).withColumn("_held", F.lit(True))
    drawn = state.join(held, [*keys, "frame"], "left")
    hidden = drawn.withColumns({c: F.when(F.col("_held").isNull(), F.col(c)) for c in ("x3", "y3", "z3", "std3")}).drop("_held")
    path = physics.trajectory(hidden, camera.p, homography, fps, keys)
    true = drawn.where("_held").select(*keys, "frame", F.col("z3").alias("true_z"))
    error = true.join(path, [*keys, "frame"]).withColumn("_e", F.abs(F.col("z") - F.col("true_z")))
    return error.agg(F.count("*").alias("n"), F.percentile("_e", F.lit(0.5)).alias("median"), F.avg("_e").alias("mean"), F.percentile("_e", F.lit(0.9)).alias("p90"))


def arcs_from_log(log: DataFrame, homography: Matrix, fps: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Arcs of the ball from one camera's frame log (keys, frame, measured, u, v, event_type, x_m, y_m): flights between events, arcs
    between the floor contacts of a flight, and the points of those arcs.

    Gives arcs (keys, seg_id, arc_id, start_frame, end_frame, kind) and points (keys, seg_id, arc_id, frame, x_m, y_m, z_m,
    apex_m); open arcs have no points."""
    events = log.where("event_type is not null").select(*keys, "frame", F.col("event_type").alias("type"), "x_m", "y_m")
    segments = sequences.flight_segments(log.select(*keys, "frame"), events, keys)
    contacts = sequences.floor_contacts(log, events, homography, keys)
    arcs = sequences.segment_arcs(segments, contacts, keys)
    bounce = F.lit("floor_bounce")
    points = sequences.ballistic_arcs(arcs.where("kind = 'anchored'").withColumns({"start_type": bounce, "end_type": bounce}), contacts, fps, keys, "arc_id")
    return arcs, points


def arc_report(arcs: DataFrame, points: DataFrame, observed: DataFrame, p: Matrix, keys: list[str]) -> DataFrame:
    """Each arc of `arcs_from_log` against what was seen: apex, median pixel error under the camera `p` (3x4, row by row), verdict (open,
    high, mismatch, ok). `observed`: keys, frame, measured, u, v."""
    u, v = project(p, F.col("x_m"), F.col("y_m"), F.col("z_m"))
    seen = points.join(observed.where("measured").select(*keys, "frame", "u", "v"), [*keys, "frame"], "left").withColumns({"pu": u, "pv": v})
    d = F.sqrt((F.col("pu") - F.col("u")) * (F.col("pu") - F.col("u")) + (F.col("pv") - F.col("v")) * (F.col("pv") - F.col("v")))
    out = seen.withColumn("_d", d).groupBy(*keys, "seg_id", "arc_id").agg(F.max("apex_m").alias("apex_m"), F.percentile("_d", F.lit(0.5)).alias("median_px"))
    return arcs.join(out, [*keys, "seg_id", "arc_id"], "left").withColumn("verdict", metrics.arc_verdict(F.col("apex_m"), F.col("median_px")))


def tiled_detection(boxes: DataFrame, keys: list[str], tile: tuple[int, int], overlap: float = 0.2, threshold: float = 0.6) -> DataFrame:
    """Boxes found in overlapping tiles (keys, row, col, det_idx, x1, y1, x2, y2, conf) as boxes of the whole frame: moved to their place,
    those that several tiles found kept once, numbered again by confidence as det_idx."""
    moved = courts.tile_to_frame(boxes, *tile, overlap)
    w = Window.partitionBy(*keys).orderBy("row", "col", "det_idx", "x1", "y1", "conf")
    numbered = moved.withColumn("det_idx", (F.row_number().over(w) - 1).cast("int")).select(*keys, "det_idx", "x1", "y1", "x2", "y2", "conf")
    kept = joins.non_maximum_suppression(numbered, keys, threshold)
    order = Window.partitionBy(*keys).orderBy(F.desc("conf"), F.desc("det_idx"))
    return kept.withColumn("det_idx", (F.row_number().over(order) - 1).cast("int"))


def single_camera_players(detections: DataFrame, frames: DataFrame, keys: list[str], homography: Matrix, roi: Polygon = (), cfg: bytetrack.ByteConfig = bytetrack.ByteConfig(), least_conf: float = 0.5, inside_m: float = 0.0, order: Sequence[str] = ("det_idx",), with_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """One camera's players: boxes (keys, frame, x1, y1, x2, y2, conf, keypoints, and `order`, by which those of a frame are taken) inside the
    region, their tracks, and where they stand; and for each clip of `frames` (keys, frame: all that were processed) the summary of the run.

    Rows: keys, frame, track_id, conf, the box, foot_u, foot_v, foot_source, x_m, y_m, inside. Only boxes on a track are rows. What is told
    of a box goes through the tracking beside it, so nothing is joined again; the summary takes along only what it counts. `with_rows`: the
    summary's `players` are its clip's rows, by frame and track; one tracking then gives both, but a clip's rows lie in one of the summary."""
    within = in_polygon(roi, *box_center(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    kept = players.inside_region(detections, roi).dropna(subset=[*keys, "frame"])
    fu, fv, source = foot_point(F.col("keypoints"), F.col("x1"), F.col("x2"), F.col("y2"), least_conf)
    feet = kept.withColumns({"foot_u": fu, "foot_v": fv, "foot_source": source})
    placed = bytetrack.tracked_boxes(feet, keys, [*order], ["frame", "conf", "x1", "y1", "x2", "y2", "foot_u", "foot_v", "foot_source"], cfg)
    x, y = transform_point(homography, F.col("foot_u"), F.col("foot_v"))
    placed = placed.withColumns({"x_m": x, "y_m": y}).withColumn("inside", in_court(F.col("x_m"), F.col("y_m"), inside_m))
    told = ["frame", "track_id", "conf", "x1", "y1", "x2", "y2", "foot_u", "foot_v", "foot_source", "x_m", "y_m", "inside"]
    rows = placed.select(*keys, *told)
    height = F.col("y2") - F.col("y1")
    tracked = placed if with_rows else bytetrack.tracked_boxes(kept, keys, [*order], ["frame", "conf", "y1", "y2"], cfg)
    seen = tracked.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.collect_list(F.when(F.col("begins"), F.col("frame"))).alias("_born"),
        rounded(F.avg("conf")).alias("mean_confidence"),
        rounded(F.min(height), 1).alias("height_min"),
        rounded(F.percentile(height, F.lit(0.5)), 1).alias("height_median"),
        rounded(F.max(height), 1).alias("height_max"),
        *([F.sort_array(F.collect_list(F.struct(*told))).alias("players")] if with_rows else []),
    )
    raw = detections.groupBy(*keys).agg(F.count("*").alias("_raw"), F.count_if(within).alias("_kept"))
    n = frames.select(*keys, "frame").distinct().groupBy(*keys).agg(F.count("*").alias("frames_processed"), F.min("frame").alias("_first"))
    many = lambda a: F.array_size(a).cast("long")
    churn = F.filter("_born", lambda f: f > F.col("_first"))  # tracks that begin after the first processed frame
    whole = lambda c: F.coalesce(c, F.lit(0))
    removed = whole("_raw") - whole("_kept")
    summary = n.join(raw, keys, "left").join(seen, keys, "left").select(
        *keys,
        "frames_processed",
        whole("_raw").alias("detections_raw_total"),
        whole("_kept").alias("detections_after_roi_total"),
        removed.alias("detections_removed_by_roi"),
        rounded(num(100) * removed / F.greatest(F.lit(1), whole("_raw")), 2).alias("roi_removed_pct"),
        F.coalesce("mean_confidence", num(0)).alias("mean_confidence"),
        whole(many(F.col("_born"))).alias("unique_track_ids"),
        whole(many(churn)).alias("id_churn_proxy"),
        rounded(whole("_n") / F.col("frames_processed"), 2).alias("avg_tracks_per_frame"),
        *(F.coalesce(c, num(0)).alias(c) for c in ("height_min", "height_median", "height_max")),
        *([F.coalesce("players", F.array()).alias("players")] if with_rows else []),
    )
    return rows, summary


def dual_view(fused: DataFrame, homography_a: Matrix, homography_b: Matrix) -> DataFrame:
    """A place for each frame of a match, from both cameras or either (rows of `ball_fusion`). Camera B's floor points are
    turned into the global frame first."""
    xa, ya = transform_point(homography_a, F.when(F.col("measured"), F.col("meas_u")), F.when(F.col("measured"), F.col("meas_v")))
    lx, ly = transform_point(homography_b, F.when(F.col("measured_b"), F.col("meas_u_b")), F.when(F.col("measured_b"), F.col("meas_v_b")))
    xb, yb = to_global(F.lit("B"), lx, ly)
    rows = fused.select("match", "frame", F.col("ball3d.x").alias("x3"), F.col("ball3d.y").alias("y3"), F.col("ball3d.z").alias("z3"), xa.alias("xa"), ya.alias("ya"), xb.alias("xb"), yb.alias("yb"))
    return sequences.placement(rows)


def dual_bounces(events_a: DataFrame, events_b: DataFrame, offset: int) -> DataFrame:
    """Floor bounces of both cameras in the global frame, each from the camera that owns the half."""
    a = events_a.where("type = 'floor_bounce'").select("match", "frame", F.lit("A").alias("cam"), F.col("x_m").alias("x"), F.col("y_m").alias("y"), "in_court")
    gx, gy = to_global(F.lit("B"), F.col("x_m"), F.col("y_m"))
    b = events_b.where("type = 'floor_bounce'").select("match", (F.col("frame") - offset).cast("int").alias("frame"), F.lit("B").alias("cam"), gx.alias("x"), gy.alias("y"), "in_court")
    return a.unionByName(b).where(owns(F.col("cam"), F.col("y")))


def detector_precision(detections: DataFrame, labels: DataFrame, keys: list[str], tolerance: float = 30.0, held: DataFrame | set[int] | None = None) -> DataFrame:
    """A threshold sweep on labelled frames: all of them, those of a table (keys, frame), or those of a small set of frames."""
    rows = labels.select(*keys, "frame", "visible", F.col("u").alias("lu"), F.col("v").alias("lv")).join(detections, [*keys, "frame"])
    if isinstance(held, DataFrame):
        rows = rows.join(held.select(*keys, "frame").distinct(), [*keys, "frame"], "left_semi")
    elif held is not None:
        rows = rows.where(F.col("frame").isin(sorted(held)))
    d = F.sqrt((F.col("u") - F.col("lu")) * (F.col("u") - F.col("lu")) + (F.col("v") - F.col("lv")) * (F.col("v") - F.col("lv")))
    return metrics.threshold_sweep(rows.withColumn("dist", d), tolerance, keys)


def mine_hard_frames(log: DataFrame, keys: list[str], cfg: MiningConfig = MiningConfig()) -> DataFrame:
    return sequences.hard_frames(log, keys, cfg)


def player_fusion(detections_a: DataFrame, detections_b: DataFrame, homography_a: Matrix, homography_b: Matrix, profiles: DataFrame, offset: int, roi_a: Polygon = (), roi_b: Polygon = (), cfg: IdentityConfig = IdentityConfig()) -> DataFrame:
    """Named players on the court: each camera's positions, clusters over both, identities, copied to a cluster's members.

    Detections: match, frame, det_idx, x1, y1, x2, y2, conf, keypoints, color_hist (null if unknown); profiles: match,
    player_id, hist, x, y. A profile without colour is never matched, as its place is of an earlier run."""
    a = players.court_positions(detections_a, "A", homography_a, roi_a)
    b = players.court_positions(detections_b, "B", homography_b, roi_b)
    found = players.fuse(a, b, offset, ["match"])
    colour = a.select("match", "frame", F.col("det_idx").alias("cand_idx"), "color_hist").unionByName(b.select("match", (F.col("frame") - offset).cast("int").alias("frame"), (F.col("det_idx") + 1000).alias("cand_idx"), "color_hist"))
    seen = found.where("is_rep").join(colour, ["match", "frame", "cand_idx"]).select("match", "frame", F.col("cand_idx").alias("det_idx"), "x", "y", F.col("color_hist").alias("hist"))
    named = players.identify(seen, profiles, ["match"], cfg).select("match", "frame", F.col("det_idx").alias("seed_rep"), "player_id", "cost", "reentry")
    reps = found.where("is_rep").select("match", "frame", "seed", F.col("cand_idx").alias("seed_rep"))
    return found.join(reps, ["match", "frame", "seed"]).join(named, ["match", "frame", "seed_rep"], "left").drop("seed_rep")


def draw_held_out(n: int, share: float, seed: int) -> list[int]:
    """A seeded sample of 0..n-1: `share` of them, at least one."""
    return sorted(random.Random(seed).sample(range(n), max(1, int(n * share))))
