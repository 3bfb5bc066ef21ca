import numpy as np
import pytest
from pyspark.sql import functions as F
from rallyframe.operators import long_clips
from rallyframe.operators.tracking import Kalman, track
from rallyframe.schemas import TrackerConfig

CANDIDATE = "clip long, frame int, cand_idx int, u double, v double, confidence double"


def flights(seed, frames, clips=1, gaps=0.1):
    """Rows with short and long gaps, several candidates in some frames, ties of confidence."""
    rng, rows = np.random.default_rng(seed), []
    for clip in range(clips):
        away, x = 0, np.array([900.0, 500.0])
        for f in range(frames):
            x = np.clip(x + rng.normal(scale=8, size=2), 0, 1900)
            if away == 0 and rng.random() < gaps:
                away = int(rng.choice([1, 2, 5, 15, 16, 40]))
            away = max(0, away - 1)
            if away or f < clip * 3:
                rows.append((clip, f, 0, None, None, None))
            else:
                rows += [(clip, f, k, float(x[0] + 300 * k), float(x[1]), float(rng.choice([0.3, 0.6, 0.9]))) for k in range(1 + (f % 17 == 0))]
    return rows


def compared(spark, rows, chunk, cfg):
    frame = spark.createDataFrame(rows, CANDIDATE)
    want = track(frame, long_clips.linear(cfg)).orderBy("clip", "frame").toPandas()
    got = long_clips.track_long(frame, cfg, chunk=chunk).orderBy("clip", "frame").toPandas()
    for c in ("clip", "frame", "status", "measured", "coast"):
        assert got[c].tolist() == want[c].tolist(), c
    for c in ("x", "y", "vx", "vy", "std"):
        assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-9, atol=1e-6, equal_nan=True), c
    return want


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_chunks_give_the_track(spark, chunk):
    want = compared(spark, flights(1, 300, clips=4), chunk, TrackerConfig())
    assert {"lost", "coasting", "tracking"} == set(want.status)


def test_a_long_clip_is_dealt_over_many_tasks(spark):
    rows = flights(2, 30_000, gaps=0.02)
    compared(spark, rows, 1024, TrackerConfig(dt=1 / 25))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = long_clips.track_long(spark.createDataFrame(rows, CANDIDATE), chunk=1024).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(p["count"] for p in parts) < 30_000


def test_elements_compose_in_any_order():
    """Halves first or one after another: the same map, and that of the filter."""
    cfg, rng = long_clips.linear(TrackerConfig()), np.random.default_rng(3)
    seen = rng.normal(500, 20, size=(9, 2))
    seen[[2, 5]] = np.nan
    many = long_clips.elements(seen, np.full(9, cfg.r * cfg.conf_ref / 0.5), cfg)
    one = long_clips.composed(many)
    step = tuple(x[0] for x in many)
    for k in range(1, 9):
        step = long_clips.compose(step, tuple(x[k] for x in many))
    assert all(np.allclose(a, b) for a, b in zip(one, step, strict=True))
    kalman = Kalman(cfg, [480.0, 510.0, 3.0, -4.0, 25.0, 0.0, 1e6], 1, 0)
    start = list(kalman.state)
    for u, v in seen:
        kalman.step([] if np.isnan(u) else [(u, v, 0.5)])
    assert np.allclose(long_clips.carried(start, one), kalman.state)


def test_no_rows(spark):
    assert long_clips.track_long(spark.createDataFrame([], CANDIDATE)).count() == 0


def plain_smoothed(rows, cfg):
    """By matrices over a whole clip: filter, then smoother, each stretch of a track by itself."""
    dt, q = cfg.dt, cfg.q
    f = np.kron(np.eye(2), [[1, dt], [0, 1]])
    noise = np.kron(np.eye(2), [[q * dt**4 / 4, q * dt**3 / 2], [q * dt**3 / 2, q * dt**2]])
    out = {}
    for clip in {r[0] for r in rows}:
        kalman, states = Kalman(cfg), []
        for frame in sorted({r[1] for r in rows if r[0] == clip}):
            kalman.step([r[3:] for r in rows if r[0] == clip and r[1] == frame and r[3] is not None])
            states.append((frame, kalman.state))
        later = None
        for frame, s in reversed(states):
            if s is None:
                later = None
                continue
            x, y, vx, vy, p11, p12, p22 = s
            m, p = np.array([x, vx, y, vy]), np.kron(np.eye(2), [[p11, p12], [p12, p22]])
            if later is not None:
                m = m + p @ f.T @ np.linalg.inv(f @ p @ f.T + noise) @ (later - f @ m)
            out[clip, frame] = later = m
    return out


@pytest.mark.parametrize("chunk", [1, 9, 50, 10_000])
def test_chunks_give_the_smoothed_track(spark, chunk):
    rows, cfg = flights(4, 160, clips=3), TrackerConfig()
    got = {(r.clip, r.frame): (r.x, r.vx, r.y, r.vy) for r in long_clips.smooth_long(spark.createDataFrame(rows, CANDIDATE), cfg, chunk=chunk).collect()}
    want = plain_smoothed(rows, long_clips.linear(cfg))
    assert got.keys() == want.keys() and len(got) > 200
    assert all(np.allclose(got[k], want[k], rtol=1e-7, atol=1e-5) for k in want)


def test_chunks_are_handed_over_many_at_a_time(spark):
    """Handing chunks to Python one by one costs milliseconds each."""
    frame = spark.createDataFrame(flights(5, 40), CANDIDATE)
    for out in (long_clips.track_long(frame, chunk=8), long_clips.smooth_long(frame, chunk=8)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_elements_of_many_chunks_compose_together():
    cfg, rng = long_clips.linear(TrackerConfig()), np.random.default_rng(6)
    of = np.repeat(np.arange(5), [1, 2, 7, 8, 3])
    many = long_clips.elements(rng.normal(500, 20, size=(len(of), 2)), np.full(len(of), 30.0), cfg)
    got = long_clips.composed_by(many, of)
    for k in range(5):
        assert all(np.array_equal(a[k], b) for a, b in zip(got, long_clips.composed(tuple(x[of == k] for x in many)), strict=True))
