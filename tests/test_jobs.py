import numpy as np
import pytest
from pyspark.sql import functions as F
from rallyframe.functions.geometry import floor_point, min_max, project
from rallyframe.operators import courts, metrics, players, sequences
from rallyframe.plans import jobs, queries
from rallyframe.plans.queries import _two_cameras
from rallyframe.sources import readers, writers


def test_small_relations(spark):
    assert courts.court_lines(spark).count() == courts.landmarks(spark).count() == 8
    ends = courts.sample_segments(courts.court_lines(spark), 3).where("line = 'net'").orderBy("k").collect()
    assert [(r.x, r.y) for r in ends] == [(0.0, 10.0), (5.0, 10.0), (10.0, 10.0)]
    frames = spark.range(20).withColumnRenamed("id", "frame")
    assert [r.frame for r in courts.frame_range(frames, 5, 3).orderBy("frame").collect()] == [5, 6, 7]
    tile = spark.createDataFrame([(1, 1, 10.0, 10.0, 20.0, 20.0)], "row int, col int, x1 double, y1 double, x2 double, y2 double")
    assert courts.tile_to_frame(tile, 100, 50).first().x1 == 90.0 and courts.tile_to_frame(tile, 100, 50).first().y2 == 60.0
    one = spark.range(1)
    reason = lambda *a: one.select(courts.blob_reason(*map(F.lit, a))).first()[0]
    assert [reason(0.1, 1, 1), reason(0.9, 0, 0), reason(0.9, 2, 0), reason(0.9, 2, 1)] == ["no-ball", "no-ball", "out-of-court", "ok"]
    assert one.select(courts.owns(F.lit("A"), F.lit(9.9)), courts.owns(F.lit("B"), F.lit(9.9)), courts.yellow_enough(F.lit(None).cast("double"))).first()[:] == (True, False, False)
    assert one.select(min_max(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0)))).first()[0] == [0.0, 1.0, 0.5]


def test_floor_point_undoes_projection(spark):
    a, _ = _two_cameras()
    p = tuple(a.p.ravel())
    rows = spark.createDataFrame([(3.0, 4.0), (9.0, 19.0)], "x double, y double")
    u, v = project(p, F.col("x"), F.col("y"), F.lit(0.0))
    x, y = floor_point(p, F.col("u"), F.col("v"))
    for r in rows.withColumns({"u": u, "v": v}).select("x", "y", x.alias("bx"), y.alias("by")).collect():
        assert (r.bx, r.by) == pytest.approx((r.x, r.y))


def test_bounces_from_labels(spark):
    y = np.concatenate([np.linspace(100, 900, 9), np.linspace(860, 500, 9)])
    labels = spark.createDataFrame([(1, 2 * i, 1, 500.0, float(v)) for i, v in enumerate(y)] + [(1, 40, 1, None, None)], "clip long, frame int, visible int, u double, v double")
    scale = (0.01, 0, 0, 0, 0.02, 0, 0, 0, 1)
    got = jobs.events_from_labels(labels.where("u is not null"), scale, 20.0, 2).collect()
    assert [r.type for r in got] == ["floor_bounce"] and got[0].in_court and 16 <= got[0].frame <= 22


def match_logs(spark, jump=None):
    a, b = _two_cameras()
    rows_a, rows_b = [], []
    for f in range(30):
        p = np.array([[4.0, 5 + 0.2 * f, 2.0]])
        (ua, va), (ub, vb) = a.project(p)[0], b.project(p)[0]
        rows_a.append((1, f, True, float(ua), float(va), 0.9, float(ua), float(va)))
        rows_b.append((1, f + 4, f != 3, float(ub) + (400.0 if f == jump else 0.0), float(vb), 0.9, float(ub), float(vb)))
    schema = "match long, frame int, measured boolean, meas_u double, meas_v double, confidence double, x double, y double"
    return a, b, spark.createDataFrame(rows_a, schema), spark.createDataFrame(rows_b, schema)


def test_ball_fusion(spark):
    a, b, log_a, log_b = match_logs(spark, jump=10)
    got = {r.frame: r for r in jobs.ball_fusion(log_a, log_b, a, b, 4, 20.0).collect()}
    assert len(got) == 30 and got[3].ball3d is None and got[3].rejected is None and got[10].rejected == "epipolar"
    assert got[20].ball3d.y == pytest.approx(9.0) and got[20].speed_kmh == pytest.approx(0.2 * 20 * 3.6) and got[11].speed_kmh == pytest.approx(0.2 * 20 * 3.6)
    summary = jobs.fusion_summary(jobs.ball_fusion(log_a, log_b, a, b, 4, 20.0)).first()
    assert (summary.n_frames, summary.n_3d) == (30, 28)


def test_ball_in_space_job(spark):
    a, b, log_a, log_b = match_logs(spark)
    events = spark.createDataFrame([], "match long, frame int, type string, x_m double, y_m double")
    got = jobs.ball_3d(log_a, log_b, events, a, b, (1, 0, 0, 0, 1, 0, 0, 0, 1), 4, 20.0).orderBy("frame").collect()
    assert len(got) == 30 and {r.source for r in got} == {"triangulated", "measured"} and all(0 <= r.z_m <= 8 for r in got)


def test_detector_precision_prefers_the_best_threshold(spark):
    labels = spark.createDataFrame([(1, f, 1, 10.0, 10.0) for f in range(10)], "clip long, frame int, visible int, u double, v double")
    found = spark.createDataFrame([(1, f, True, 10.0 if f < 6 else 200.0, 10.0, 0.9 if f < 6 else 0.55) for f in range(10)], "clip long, frame int, found boolean, u double, v double, confidence double")
    best = jobs.detector_precision(found, labels, ["clip"]).where("best").first()
    assert best.threshold == 0.6 and best.precision == 1.0 and best.recall == 0.6
    assert jobs.detector_precision(found, labels, ["clip"], held=set(range(6))).where("best").first().recall == 1.0
    held = spark.createDataFrame([(1, f) for f in (0, 1, 2, 2)], "clip long, frame int")
    assert jobs.detector_precision(found, labels, ["clip"], held=held).where("best").first().tp == 3


def test_locations_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1.23456, 2.0, 3.0), (1, 1, None, None, None)], "match long, frame int, x3 double, y3 double, z3 double")
    none = F.lit(None).cast("double")
    placed = sequences.placement(rows.withColumns({c: none for c in ("xa", "ya", "xb", "yb")}))
    writers.write_locations(placed, str(tmp_path / "l"), ["match", "frame"])
    got = spark.read.option("header", True).csv(str(tmp_path / "l")).orderBy("frame").collect()
    assert [tuple(r) for r in got] == [("1", "0", "both", "1.235", "2.0", "3.0"), ("1", "1", "lost", None, None, None)]


def test_covariance_of_a_point():
    """Against the formula: the Jacobian's pseudo-inverse times the noise."""
    from rallyframe.functions.cameras import triangulation_covariance, triangulation_std

    a, b = _two_cameras()
    x = np.array([[4.0, 9.0, 1.5]])
    slope = np.concatenate([np.stack([(c.project(x + 1e-5 * np.eye(3)[i]) - c.project(x - 1e-5 * np.eye(3)[i]))[0] / 2e-5 for i in range(3)], axis=1) for c in (a, b)])
    want = np.linalg.pinv(slope) @ np.linalg.pinv(slope).T * 4.0
    got = triangulation_covariance(a.p, b.p, a.project(x), b.project(x))[0]
    assert np.allclose(got, got.T) and np.allclose(np.sqrt(np.diag(got)), triangulation_std(a.p, b.p, a.project(x), b.project(x))[0])
    assert np.allclose(np.diag(got), np.diag(want), rtol=0.2)


def test_summaries(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 3.0)], "clip long, reproj_px double")
    r = metrics.reprojection_stats(rows, ["clip"]).first()
    assert (r.n, r.median, r.mean) == (2, 2.0, 2.0)
    assert writers.summary_document(rows.limit(1)).first().document == '{"clip":1,"reproj_px":1.0}'
    verdicts = spark.range(1).select(*(metrics.arc_verdict(F.lit(a).cast("double"), F.lit(b).cast("double")) for a, b in ((None, None), (9, 1), (3, 60), (3, 10)))).first()
    assert verdicts[:] == ("open", "high", "mismatch", "ok")
    clips = spark.createDataFrame([("a", 20.0), ("b", 0.0), ("c", 20.0)], "clip string, fps double")
    labels = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "clip string, visible int")
    assert [(r.clip, r.n_labels, r.n_visible) for r in readers.clip_inventory(clips, labels).collect()] == [("a", 2, 1)]
    arcs = spark.createDataFrame([(1, 5, 1.0, 1.0, 1.0, 0), (1, 5, 2.0, 2.0, 2.0, 1)], "clip long, frame int, x_m double, y_m double, z_m double, seg_id int")
    assert writers.last_arc_points(arcs, ["clip"]).first().x_m == 2.0


def test_single_camera_run_in_figures(spark, sf):
    """The summary counted by hand from the rows and the boxes."""
    rng = np.random.default_rng(2)
    point = [{"x": 0.0, "y": 0.0, "c": 0.0}] * 15 + [{"x": 10.0, "y": 20.0, "c": 0.9}] * 2
    rows = [(c, f, i, 100.0 * i + 3 * f, 50.0, 100.0 * i + 3 * f + 40, 170.0 + c, float(rng.choice([0.2, 0.6, 0.9])), point if f % 2 else point[:15] * 2) for c in (1, 2) for f in range(30) if f % 9 != 4 for i in range(4)]
    schema = "clip long, frame int, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, keypoints array<struct<x: double, y: double, c: double>>"
    boxes = spark.createDataFrame(rows, schema)
    frames = spark.createDataFrame([(c, f) for c in (1, 2, 3) for f in range(30)], "clip long, frame int")
    roi = [(0, 0), (310, 0), (310, 400), (0, 400)]
    seen, summary = jobs.single_camera_players(boxes, frames, ["clip"], (0.02, 0, 0, 0, 0.05, 0, 0, 0, 1), roi)
    seen, summary = seen.collect(), {r.clip: r.asDict() for r in summary.collect()}
    for c in (1, 2):
        mine = [r for r in seen if r.clip == c]
        inside = [r for r in rows if r[0] == c and 0 <= (r[3] + r[5]) / 2 <= 310]
        first = {}
        for r in sorted(mine, key=lambda r: r.frame):
            first.setdefault(r.track_id, r.frame)
        want = {"clip": c, "frames_processed": 30, "detections_raw_total": sum(r[0] == c for r in rows), "detections_after_roi_total": len(inside), "detections_removed_by_roi": sum(r[0] == c for r in rows) - len(inside)}
        want |= {"unique_track_ids": len(first), "id_churn_proxy": sum(f > 0 for f in first.values()), "avg_tracks_per_frame": round(len(mine) / 30, 2), "mean_confidence": round(sum(r.conf for r in mine) / len(mine), 4), "height_min": 120.0 + c, "height_median": 120.0 + c, "height_max": 120.0 + c}
        assert all(summary[c][k] == pytest.approx(v, abs=0.011) for k, v in want.items())
        assert all(r.x_m == pytest.approx(0.02 * r.foot_u) and r.y_m == pytest.approx(0.05 * r.foot_v) and r.inside == (0 <= r.x_m <= 10 and 0 <= r.y_m <= 20) for r in mine)
    assert summary[3] == {"clip": 3, "frames_processed": 30} | {k: 0 for k in summary[3] if k not in ("clip", "frames_processed")}


def test_single_camera_run_tracks_once(spark, sf):
    """The summary comes out of one pass over the tracked boxes, and each box's centre is worked out once before the region is looked at."""
    summary = queries.QUERIES["single_camera_players"](spark, sf)
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan
    kept = players.inside_region(spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_tax x1", "l_tax y1", "l_discount x2", "l_discount y2"), [(0, 0), (310, 0), (310, 400), (0, 400)])
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("/ 2.0") == 2


def test_single_camera_run_gives_places(spark, sf):
    """The query gives where each tracked player stands beside its clip's figures."""
    got = queries.QUERIES["single_camera_players"](spark, sf).collect()
    assert sum(len(r.players) for r in got) > 1000
    for r in got:
        seen, heights = r.players, sorted(p.y2 - p.y1 for p in r.players)
        assert [(p.frame, p.track_id) for p in seen] == sorted({(p.frame, p.track_id) for p in seen})
        assert all(p.foot_source == "bbox" and (p.foot_u, p.foot_v) == ((p.x1 + p.x2) / 2, p.y2) for p in seen)
        assert all(p.x_m == pytest.approx(0.02 * p.foot_u) and p.y_m == pytest.approx(0.05 * p.foot_v) and p.inside == (0 <= p.x_m <= 10 and 0 <= p.y_m <= 20) for p in seen)
        assert len({p.track_id for p in seen}) == r.unique_track_ids and r.avg_tracks_per_frame == pytest.approx(len(seen) / r.frames_processed, abs=0.0051)
        assert r.mean_confidence == pytest.approx(np.mean([p.conf for p in seen]), abs=1e-4) and [heights[0], heights[-1]] == pytest.approx([r.height_min, r.height_max], abs=0.051)


def test_single_camera_run_in_one_tracking(spark):
    """A summary with its rows holds the rows and the figures of the two tables; clips without players have none."""
    point = [{"x": 0.0, "y": 0.0, "c": 0.0}] * 15 + [{"x": 10.0, "y": 20.0, "c": 0.9}] * 2
    rows = [(c, f, i, 100.0 * i + 3 * f, 50.0, 100.0 * i + 3 * f + 40, 170.0 + c, 0.9, point if f % 2 else point[:15] * 2) for c in (1, 2) for f in range(30) if f % 9 != 4 for i in range(4)]
    schema = "clip long, frame int, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, keypoints array<struct<x: double, y: double, c: double>>"
    boxes, frames = spark.createDataFrame(rows, schema), spark.createDataFrame([(c, f) for c in (1, 2, 3) for f in range(30)], "clip long, frame int")
    run = lambda **more: jobs.single_camera_players(boxes, frames, ["clip"], (0.02, 0, 0, 0, 0.05, 0, 0, 0, 1), [(0, 0), (310, 0), (310, 400), (0, 400)], **more)
    (seen, summary), (again, whole) = run(), run(with_rows=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, seen.collect()))
    assert sorted(map(tuple, whole.drop("players").collect())) == sorted(map(tuple, summary.collect()))
    assert [(r.clip, *p) for r in whole.orderBy("clip").collect() for p in r.players] == sorted(map(tuple, seen.collect()))
    assert {r.clip: len(r.players) > 0 for r in whole.collect()} == {1: True, 2: True, 3: False}


def test_boxes_of_a_frame_are_taken_in_order(spark):
    """Numbers that repeat within a frame, told apart by another column: as if the boxes had numbers of their own."""
    rng, point = np.random.default_rng(3), [{"x": 0.0, "y": 0.0, "c": 0.0}] * 17
    rows = []
    for c in (1, 2, 3):
        for f in range(40):
            for i, k in enumerate(rng.permutation(5).tolist()):
                x, y = 70.0 * k + float(rng.uniform(0, 20)), float(rng.uniform(0, 30))
                rows.append((c, f, 1 + i // 2, i, 10 * f + i, x, y, x + 60, y + 150, float(rng.choice([0.2, 0.6, 0.9])), point))
    schema = "clip long, frame int, det_idx int, part int, n int, x1 double, y1 double, x2 double, y2 double, conf double, keypoints array<struct<x: double, y: double, c: double>>"
    boxes = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], schema).repartition(3)
    frames = boxes.select("clip", "frame")
    h, roi = (0.02, 0, 0, 0, 0.05, 0, 0, 0, 1), [(0, 0), (310, 0), (310, 400), (0, 400)]
    got = jobs.single_camera_players(boxes, frames, ["clip"], h, roi, order=["det_idx", "part"])
    want = jobs.single_camera_players(boxes.withColumn("det_idx", F.col("n")), frames, ["clip"], h, roi)
    for a, b in zip(got, want, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    seen = got[0].collect()
    inside = {(r[0], r[1], r[5]) for r in rows if (r[5] + r[7]) / 2 <= 310}
    assert len(seen) == len({(r.clip, r.frame, r.x1) for r in seen}) and {(r.clip, r.frame, r.x1) for r in seen} <= inside
    assert {r.clip: r.unique_track_ids for r in got[1].collect()} == {c: len({r.track_id for r in seen if r.clip == c}) for c in (1, 2, 3)}


def test_seeded_hold_out(spark):
    import random

    points = spark.createDataFrame([(c, 3 * f) for c, n in ((1, 20), (2, 6), (3, 5)) for f in range(n)] + [(1, 0)], "clip long, frame int")
    got = {}
    for r in jobs.seeded_hold_out(points, ["clip"], 0.3, 7).collect():
        got.setdefault(r.clip, set()).add(r.frame)
    assert got == {c: {3 * k for k in random.Random(7).sample(range(n), max(1, int(0.3 * n)))} for c, n in ((1, 20), (2, 6))}
