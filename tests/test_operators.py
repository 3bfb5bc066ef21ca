import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rallyframe.functions import cameras
from rallyframe.functions import geometry as G
from rallyframe.operators import joins, metrics, physics, players, sequences, signals, tracking
from rallyframe.schemas import EkfConfig, EventConfig, IdentityConfig, SuppressConfig, TrackerConfig


def candidates(spark, rows):
    return spark.createDataFrame(rows, "clip long, frame int, cand_idx int, u double, v double, confidence double")


def test_gap_and_outlier():
    kalman = tracking.Kalman(TrackerConfig(dt=0.05, max_coast=10, gate=9.21))
    status = []
    for f in range(20):
        found = [] if 6 <= f <= 9 else [(3000.0, 200.0, 0.6)] if f == 13 else [(100.0 + 40 * f, 500.0, 0.8)]
        status.append(kalman.step(found))
    assert [s[0] for s in status[6:10]] == ["coasting"] * 4 and status[13][7] and status[13][0] == "coasting"
    assert status[0][0] == "tracking" and abs(status[19][1] - 860) < 20


def test_track_is_lost_and_found(spark):
    rows = [(1, f, 0, 10.0 * f if f < 5 or f > 30 else None, 5.0 if f < 5 or f > 30 else None, 0.9) for f in range(35)] + [(2, 0, 0, None, None, None)]
    got = {(r.clip, r.frame): r for r in tracking.track(candidates(spark, rows)).collect()}
    assert len(got) == 36 and got[2, 0].status == "lost" and got[2, 0].x is None
    assert got[1, 19].status == "coasting" and got[1, 20].status == "lost" and got[1, 31].status == "tracking" and got[1, 31].vx == 0


def test_candidates_near_the_prediction_win():
    kalman = tracking.Kalman(TrackerConfig(associate_px=50))
    kalman.step([(100.0, 100.0, 0.5)])
    assert kalman.step([(900.0, 900.0, 0.99), (105.0, 100.0, 0.2), (110.0, 100.0, 0.3)])[9] == 110.0
    assert kalman.step([(900.0, 900.0, 0.99), (950.0, 900.0, 0.2)])[9] == 900.0


def test_bounce_and_hit():
    cfg = EventConfig(min_vy=100)
    state = tracking.Events(cfg, None)
    seen = [state.step(f, 5.0, 5.0, 50.0, vy, True) for f, vy in enumerate([200.0, 300.0, -200.0, -100.0, 50.0])]
    assert [s and s[1] for s in seen] == [None, None, "floor_bounce", None, None] and seen[2][6] is None
    state = tracking.Events(cfg, lambda u, v: (0.3, 5.0))
    seen = [state.step(f, 1.0, 1.0, vx, -10.0, True) for f, vx in enumerate([-900.0, -900.0, 700.0])]
    assert seen[2][1] == "wall_bounce"
    state = tracking.Events(cfg, lambda u, v: (5.0, 5.0))
    seen = [state.step(f, 1.0, 1.0, vx, vy, True) for f, (vx, vy) in enumerate([(2000.0, -5.0), (-2000.0, -5.0)])]
    assert seen[1][1] == "hit"


def test_parked_ball_is_dropped_and_released():
    state = tracking.Suppressor(SuppressConfig(min_frames=10, radius_px=14, release_px=60, still_px=8))
    kept = {}
    for f in range(45):
        found = [(500.0, 500.0, 0.9)] if f < 30 else [(500.0 + 30 * (f - 29), 500.0 - 20 * (f - 29), 0.9)]
        if f >= 5:
            found.append((100.0 + 25 * f, 300.0, 0.8))
        kept[f] = state.step(f, found)
    assert kept[5][0] and not kept[15][0] and not kept[29][0] and kept[44][0]
    assert all(kept[f][1] for f in range(5, 45))


def test_case_audit_sees_a_still_ball(spark):
    rows = [(1, f, 0, 100.0 + 60 * f, 300.0, 0.9) for f in range(50)] + [(1, f, 1, 500.0, 900.0, 0.2) for f in range(50)]
    got = {r.frame: r for r in tracking.case_audit(candidates(spark, rows)).collect()}
    assert got[45].n_static == 1 and got[45].static_while_fast and got[10].n_moving == 1 and got[10].n_static == 0
    assert got[45].tracking and abs(got[45].speed - 60 * 20) < 60


def test_cluster_against_loop(spark):
    rng = random.Random(1)
    rows = [(f, i, rng.uniform(0, 6), rng.uniform(0, 6), float(rng.randrange(5))) for f in range(20) for i in range(rng.randrange(1, 9))]
    got = {(r.frame, r.cand_idx): (r.seed, r.is_rep) for r in joins.cluster(spark.createDataFrame(rows, "frame int, cand_idx int, x double, y double, bh double"), ["frame"]).collect()}
    for f in range(20):
        points = [r for r in rows if r[0] == f]
        used, want = set(), {}
        for i, p in enumerate(points):
            if i in used:
                continue
            members = [i] + [j for j in range(i + 1, len(points)) if j not in used and (points[j][2] - p[2]) ** 2 + (points[j][3] - p[3]) ** 2 <= 2.25]
            used |= set(members)
            rep = max(members, key=lambda j: (points[j][4], -j))
            want |= {j: (i, j == rep) for j in members}
        assert {i: got[f, i] for i in want} == want


def test_match_is_greedy_by_frame(spark):
    at = lambda *f: spark.createDataFrame([(1, x) for x in f], "clip long, frame int")
    got = {(r.pred_frame, r.true_frame) for r in joins.match_events(at(10, 12, 30), at(11, 14, 50), 3, ["clip"]).collect()}
    assert got == {(10, 11), (12, 14), (30, None), (None, 50)}
    pairs = {(r.frame, r.frame_b) for r in joins.band_pairs(at(10, 12, 30), at(11, 14, 50), 3, ["clip"]).collect()}
    assert pairs == {(10, 11), (12, 11), (12, 14)}


def test_assignment_against_all():
    rng = np.random.default_rng(0)
    for rows, columns in itertools.product((1, 3, 4), (1, 2, 4, 6, 11)):
        cost = rng.random((rows, columns))
        best = min(sum(cost[i, j] for i, j in zip(r, c, strict=True)) for r in itertools.permutations(range(rows), min(rows, columns)) for c in itertools.combinations(range(columns), min(rows, columns)))
        pairs = players.assign(cost)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(rows, columns)
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_filter_step_against_matrices():
    """One prediction and a joint correction by the textbook's matrices, and a floor contact's variances."""
    a, _ = two()
    cfg, dt = EkfConfig(), 0.02
    ekf = physics.Ekf(cfg, a.p, dt, [3.0, 4.0, 1.0])
    f, s, c = np.eye(6), np.array([3.0, 4.0, 1.0, 0, 0, 0]), np.diag(cfg.p0)
    f[:3, 3:] = dt * np.eye(3)
    s = f @ s + np.array([0, 0, -0.5 * 9.81 * dt * dt, 0, 0, -9.81 * dt])
    c = f @ c @ f.T + np.diag([cfg.q_pos, cfg.q_pos, cfg.q_pos_z, cfg.q_vel, cfg.q_vel, cfg.q_vel_z])

    def correct(s, c, h, y, r):
        gain = c @ h.T @ np.linalg.inv(h @ c @ h.T + r)
        return s + gain @ y, (np.eye(6) - gain @ h) @ c

    h = np.zeros((2, 6))
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        h[:, i] = (a.project((s[:3] + step)[None])[0] - a.project((s[:3] - step)[None])[0]) / 2e-5
    seen = a.project(s[None, :3])[0] + [7.0, -4.0]
    s, c = correct(s, c, h, np.array([7.0, -4.0]), np.eye(2) * cfg.meas_px**2 / 0.8)
    ekf.predict()
    ekf.see_2d(*seen, 0.8)
    assert np.allclose(ekf.s, s, atol=1e-6) and np.allclose(ekf.c, c, atol=1e-5)
    s, c = correct(s, c, np.eye(3, 6), np.array([3.1, 4.2, 0.0]) - s[:3], np.diag([0.05, 0.05, 0.02]))
    ekf.anchor(3.1, 4.2)
    assert np.allclose(ekf.s, s, atol=1e-6) and np.allclose(ekf.c, c, atol=1e-5)


def test_smoother_against_loop():
    rng = np.random.default_rng(0)
    f = np.eye(6)
    f[:3, 3:] = 0.05 * np.eye(3)
    sym = lambda: (lambda m: m @ m.T + np.eye(6))(rng.normal(size=(6, 6)))
    forward = [{"prior": rng.normal(size=6), "post": rng.normal(size=6), "prior_c": sym(), "post_c": sym(), "break": k == 4} for k in range(9)]
    want = [r["post"].copy() for r in forward]
    for k in range(7, -1, -1):
        if not forward[k + 1]["break"]:
            want[k] = want[k] + forward[k]["post_c"] @ f.T @ np.linalg.inv(forward[k + 1]["prior_c"]) @ (want[k + 1] - forward[k + 1]["prior"])
    got = physics.smooth(forward, f, 8.0)
    for g, w in zip(got, want, strict=True):
        assert np.allclose(g, [*w[:2], min(max(w[2], 0), 8), *w[3:]])


def test_parking_is_decided_after_all_links():
    """Two candidates on one blob: the centre is where the later one left it."""
    state = tracking.Suppressor(SuppressConfig(min_frames=3, still_px=10.0))
    for f in range(6):
        state.step(f, [(500.0, 500.0, 0.9), (504.0, 500.0, 0.8)])
    assert [b.centre for b in state.blobs] == [(504.0, 500.0)]


def plain_audit(rows):
    """Summary of audit rows (one clip) by loops."""
    events = {r[0] + k for r in rows if r[4] for k in range(-4, 5)}
    runs = lambda flags: (sum(flags), sum(f and (i == 0 or not flags[i - 1]) for i, f in enumerate(flags)))
    play = [r[1] and r[2] and r[0] not in events for r in rows]
    slow = [p and 0 < r[3] < 600 for p, r in zip(play, rows, strict=True)]
    fast = lambda part: max((r[3] for r in part if r[1] and r[2]), default=0) >= 1500
    apex = [s and fast(rows[max(0, i - 8) : i]) and fast(rows[i + 1 : i + 9]) for i, s in enumerate(slow)]
    return sum(play), runs([p and 0 < r[3] < 500 for p, r in zip(play, rows, strict=True)]), runs(apex)


def test_audit_summary(spark):
    rng = random.Random(8)
    rows = [(f, rng.random() < 0.9, rng.random() < 0.95, rng.choice([0.0, 300.0, 550.0, 900.0, 1700.0]), "hit" if rng.random() < 0.03 else None) for f in range(300)]
    df = spark.createDataFrame([(1, *r, 0, False, False) for r in rows], "clip long, frame int, measured boolean, tracking boolean, speed double, event string, n_suppressed int, two_moving boolean, static_while_fast boolean")
    r = metrics.audit_summary(df, ["clip"]).first()
    assert (r.n_play, (r.under_500_frames, r.under_500_episodes), (r.apex_frames, r.apex_episodes)) == plain_audit(rows)


def test_parked_ball_is_reported_once(spark):
    rows = [(1, f, 0, 500.0 + f % 2, 900.0, 0.2) for f in range(60)] + [(1, f, 1, 100.0 + 30 * f, 300.0, 0.9) for f in range(60)]
    got = tracking.parked_balls(candidates(spark, rows)).collect()
    assert [(r.first_frame, r.u, r.v, r.life) for r in got] == [(0, 501.0, 900.0, 60)]
    kept = tracking.case_audit(candidates(spark, rows), suppress=True).agg({"n_suppressed": "sum"}).first()[0]
    assert kept > 10


def test_ball_in_a_cropped_heatmap(spark):
    def heat(*dots):
        out = np.zeros((18, 32))
        for x, y, p in dots:
            out[y : y + 2, x : x + 2] = p
        return out.tolist()

    frames = [(0, heat((4, 4, 0.7), (20, 9, 0.9))), (1, heat((20, 9, 0.9))), (2, heat()), (3, heat((4, 4, 0.7)))]
    df = spark.createDataFrame(pd.DataFrame({"clip": [1] * 4, "frame": [f for f, _ in frames], "heatmap": [h for _, h in frames]}), "clip long, frame int, heatmap array<array<double>>")
    got = {r.frame: r for r in signals.ball_in_heatmaps(df, ["clip", "frame"], (32, 18), (420, 280), (100, 100, 420, 280), [(100, 100), (200, 100), (200, 200), (100, 200)], 5.0).collect()}
    assert [got[f].reason for f in range(4)] == ["ok", "out-of-court", "no-ball", "ok"] and [got[f].found for f in range(4)] == [True, False, False, True]
    assert (got[0].u, got[0].v, got[0].confidence) == pytest.approx((145.0, 145.0, 0.7)) and got[1].u is None and got[1].confidence == pytest.approx(0.9)


def test_identities_outlive_a_run(spark, tmp_path):
    from rallyframe.sources import readers, writers

    near, far = [1.0, 0.0], [0.0, 1.0]
    detections = spark.createDataFrame([(1, f, 0, 2.0 + f, 3.0, near) for f in range(5)], "match long, frame int, det_idx int, x double, y double, hist array<double>")
    profiles = spark.createDataFrame([(1, 1, near, 2.0, 3.0), (1, 2, far, None, None)], "match long, player_id int, hist array<double>, x double, y double")
    states = players.identity_states(detections, profiles, ["match"], IdentityConfig(profiles=(1, 2)))
    assert [(r.player_id, r.x, r.last_seen, r.state) for r in states.orderBy("player_id").collect()] == [(1, 6.0, 4, "active"), (2, None, -1, "missing")]
    writers.write_profiles(states, str(tmp_path / "ids"))
    again = readers.read_profiles(spark, str(tmp_path / "ids"), "match long")
    assert {(r.player_id, tuple(r.hist), r.x) for r in again.collect()} == {(1, (1.0, 0.0), 6.0), (2, (0.0, 1.0), None)}
    assert {r.player_id for r in players.identify(detections, again, ["match"]).collect()} == {1}


def test_configuration_round_trip(spark, tmp_path):
    from rallyframe.sources import readers, writers

    image, world = [(100.0, 900.0), (900.0, 900.0), (300.0, 300.0), (700.0, 300.0)], [(0.0, 0.0), (10.0, 0.0), (0.0, 20.0), (10.0, 20.0)]
    config = writers.synchronised(writers.calibrated({"source": "a.mp4", "sync": {"note": "x"}}, image, world), 37)
    writers.write_config(spark, config, str(tmp_path / "c"))
    got = readers.read_config(spark, str(tmp_path / "c"))
    assert got == config and got["sync"] == {"note": "x", "offset_frames": 37, "method": "manual"}
    h = np.array(got["homography"]["H"])
    mapped = np.c_[image, np.ones(4)] @ h.T
    assert np.allclose(mapped[:, :2] / mapped[:, 2:], world) and np.allclose(h @ np.array(got["homography"]["H_inv"]), np.eye(3), atol=1e-9)


def test_segments_without_two_contacts_are_open(spark):
    segments = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 200)], "clip long, seg_id int, start_frame int, end_frame int")
    contacts = spark.createDataFrame([(1, 10), (1, 70), (1, 150), (1, 300)], "clip long, frame int")
    got = {(r.seg_id, r.arc_id, r.start_frame, r.end_frame, r.kind) for r in sequences.segment_arcs(segments, contacts, ["clip"]).collect()}
    assert got == {(0, 0, 0, 10, "open"), (1, 0, 10, 70, "anchored"), (1, 1, 70, 150, "anchored")}


def test_identity_reentry_and_threshold():
    hists = {k: np.eye(4)[k - 1] + 0.01 for k in (1, 2, 3, 4)}
    state = players.Identities(IdentityConfig(), {k: players.Profile(h) for k, h in hists.items()})
    first = state.step(0, [(1.0, 1.0, hists[2]), (5.0, 5.0, hists[4])])
    assert {(j, k) for j, k, *_ in first} == {(0, 2), (1, 4)} and not any(r[5] for r in first)
    state.step(1, [])
    assert state.step(2, [(1.1, 1.0, hists[2])])[0][5] is True
    assert state.step(3, [(1.1, 1.0, None)])[0][1] == 2
    empty = players.Identities(IdentityConfig())
    assert empty.step(0, [(1.0, 1.0, hists[1])]) == []


def test_geometry_against_numbers(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    rows = [(0.0, 5.0), (5.0, 5.0), (10.0, 10.0), (10.1, 5.0), (-3.0, -4.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    x, y = F.col("x"), F.col("y")
    got = df.select(G.in_polygon(square, x, y).alias("a"), G.edge_distance(square, x, y).alias("d"), G.in_region(square, x, y, 4.9).alias("r"), G.in_polygon([], x, y).alias("n")).collect()
    assert [r.a for r in got[:5]] == [True, True, True, False, False] and got[4].d == 5.0 and [r.r for r in got[3:5]] == [True, False] and all(r.n for r in got)
    m = np.array([[2, 0.1, 3], [0.2, 1.5, -1], [0.001, 0.002, 1.0]])
    px, py = G.transform_point(tuple(m.ravel()), x, y)
    bx, by = G.transform_point(tuple(np.linalg.inv(m).ravel()), F.col("px"), F.col("py"))
    back = df.where("x is not null").withColumns({"px": px, "py": py}).select("x", "y", bx.alias("bx"), by.alias("by")).collect()
    assert all(abs(r.x - r.bx) < 1e-9 and abs(r.y - r.by) < 1e-9 for r in back)
    heat = df.limit(1).select(G.gaussian_heatmap(5, 4, F.lit(2.0), F.lit(1.0)).alias("h"), G.gaussian_heatmap(2, 2, F.lit(None).cast("double"), F.lit(1.0)).alias("z")).first()
    assert heat.h[1][2] == 1.0 and heat.h[1][3] == pytest.approx(math.exp(-1 / 18)) and heat.z == [[0.0, 0.0], [0.0, 0.0]]
    assert df.limit(1).select(G.slug(F.lit("/a b/c d.x.mp4"))).first()[0] == "c_d.x" and df.limit(1).select(G.slug(F.lit("/a/"))).first()[0] == "camera"
    assert df.limit(1).select(G.bhattacharyya(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))).first()[0] == 1.0


def two():
    from rallyframe.plans.queries import _two_cameras

    return _two_cameras()


def test_triangulation_round_trip():
    a, b = two()
    points = np.array([[5, 10, 2.0], [1, 3, 0.0], [9, 18, 4.0]])
    assert np.allclose(cameras.triangulate(a.p, b.p, a.project(points), b.project(points)), points, atol=1e-9)
    std = cameras.triangulation_std(a.p, b.p, a.project(points[:1]), b.project(points[:1]))[0]
    assert std.argmax() == 1


def test_far_rays_are_rejected(spark):
    a, b = two()
    point = np.array([[5, 10, 2.0]])
    (ua, va), (ub, vb) = a.project(point)[0], b.project(point)[0]
    rows = spark.createDataFrame([(float(ua), float(va), float(ub), float(vb)), (float(ua), float(va), float(ub) + 300, float(vb)), (None, 1.0, 1.0, 1.0)], "ua double, va double, ub double, vb double")
    got = rows.select(cameras.triangulated(a, b)(*(F.col(c) for c in ("ua", "va", "ub", "vb"))).alias("t")).collect()
    assert got[0].t.z == pytest.approx(2.0) and got[1].t is None and got[2].t is None


def test_calibration_recovers_a_camera():
    forward = np.array([4.0, 13.0, -6.0]) / np.linalg.norm([4.0, 13.0, -6.0])
    right = np.cross(forward, [0, 0, 1.0]) / np.linalg.norm(np.cross(forward, [0, 0, 1.0]))
    r = np.stack([right, np.cross(forward, right), forward])
    a = cameras.Camera(np.array([[2500.0, 0, 1920], [0, 2500.0, 1080], [0, 0, 1]]), r, -r @ np.array([1.0, -4.0, 7.0]))
    world = np.array(list(cameras.LANDMARKS.values()))
    image = a.project(np.c_[world, np.zeros(len(world))])
    h, error = cameras.fit_homography(image, world)
    assert error["max"] < 1e-6 and np.allclose(cameras.apply_homography(h, image), world, atol=1e-6)
    found = cameras.build_camera(image, world, 3840, 2160)
    assert found.stable and np.allclose(found.centre, a.centre, atol=1e-2) and abs(found.k[0, 0] - 2500) < 5
    turned = cameras.build_camera(image, np.array([10, 20]) - world, 3840, 2160, second=True)
    assert np.allclose(turned.centre, a.centre, atol=1e-2)
    image[0] += 400
    assert cameras.fit_homography(image, world)[1]["max"] > 0.5 and np.median(np.linalg.norm(cameras.apply_homography(cameras.fit_homography(image, world)[0], image) - world, axis=1)) < 1e-3
    with pytest.raises(ValueError):
        cameras.build_camera(image[:4], world[:4], 3840, 2160)


def test_peaks_by_definition():
    v = np.array([0, 5, 1, 1, 9, 9, 2, 3, 0, 8, 7.5, 8.2, 0])
    assert list(physics.peaks(v, 3, 1)) == [1, 4, 9, 11][:2] + [11]
    assert list(physics.peaks(v, 0, 1)) == [1, 4, 7, 9, 11] and list(physics.peaks(v, 0, 5)) == [4, 11]


def test_trajectory_follows_a_throw(spark):
    a, _ = two()
    fps, rows = 50.0, []
    for f in range(40):
        t = f / fps
        p = np.array([[3 + 4 * t, 4 + 8 * t, 1 + 4 * t - 0.5 * 9.81 * t * t]])
        u, v = a.project(p)[0]
        spot = [float(c) for c in p[0]] if f % 3 == 0 else [None] * 3
        if f not in (11, 12):
            rows.append((1, f, True, float(u), float(v), 0.9, float(u), float(v), *spot, [0.1] * 3 if f % 3 == 0 else None, None, None, None))
    schema = "clip long, frame int, measured boolean, u double, v double, confidence double, track_x double, track_y double, x3 double, y3 double, z3 double, std3 array<double>, event_type string, event_x double, event_y double"
    got = physics.trajectory(spark.createDataFrame(rows, schema), a.p, (1, 0, 0, 0, 1, 0, 0, 0, 1), fps, ["clip"]).orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(40)) and all(0 <= r.z <= EkfConfig().z_max for r in got)
    for r in got[5:35]:
        t = r.frame / fps
        assert abs(r.x - 3 - 4 * t) < 0.3 and abs(r.z - (1 + 4 * t - 0.5 * 9.81 * t * t)) < 0.4


def test_known_lag_is_found(spark):
    rng = np.random.default_rng(0)
    signal = rng.normal(size=200)
    a = spark.createDataFrame([(1, i, float(signal[i])) for i in range(150)], "match long, sample_idx int, energy double")
    b = spark.createDataFrame([(1, i, float(signal[i - 7] if i >= 7 else 0)) for i in range(150)], "match long, sample_idx int, energy double")
    best = signals.best_offset(signals.offset_sweep(a, b, ["match"]), ["match"]).first()
    assert best.offset_frames == 70 and best.corr > 0.9 and not best.doubtful


def test_dot_in_a_heatmap(spark):
    heat = np.zeros((288, 512))
    y, x = np.mgrid[:288, :512]
    heat[(x - 200) ** 2 + (y - 100) ** 2 <= 16] = 0.9
    heat[5, 5] = 0.8
    df = spark.createDataFrame(pd.DataFrame({"clip": [1], "heatmap": [heat.tolist()]}), "clip long, heatmap array<array<double>>")
    got = signals.detect_in_heatmaps(df, ["clip"], (512, 288), (1024, 576)).collect()
    assert len(got) == 1 and abs(got[0].u - 400) < 1 and abs(got[0].v - 200) < 1
    assert signals.heatmap_hits(df.withColumns({"tx": F.lit(201.0), "ty": F.lit(100.0)}), 5.0).first().hit


def test_held_out_split():
    items = list(range(100, 140))
    held = metrics.held_out(items)
    assert len(held) == 6 and held <= set(items) and held == metrics.held_out(items) and metrics.held_out([1, 2]) < {1, 2}
    assert metrics.held_out([7]) == {7} and metrics.held_out([]) == set()


def test_gaps_longer_than_the_limit_stay(spark):
    rows = [(1, f, None if f in (2, 3, 6, 7, 8, 10) else float(f), None if f in (2, 3, 6, 7, 8, 10) else 1.0) for f in range(11)]
    got = {r.frame: r.u for r in sequences.interpolate_gaps(spark.createDataFrame(rows, "clip long, frame int, u double, v double"), 2, ["clip"]).collect()}
    assert got[2] == 2.0 and got[3] == 3.0 and got[6] is None and got[10] is None
