import re
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from rallyframe.functions import geometry, tables
from rallyframe.operators import courts, physics, players, sequences, signals
from rallyframe.plans.queries import QUERIES, _csv_of, _flights
from rallyframe.plans.views import CAMERA_A, FPS, H, observations
from rallyframe.schemas import EkfConfig
from rallyframe.sources import scorers

SAMPLE = "match long, sample_idx int, energy double"


def plain_components(mask):
    """Blobs by a flood from each pixel in reading order."""
    left, out = {tuple(map(int, p)) for p in np.argwhere(mask)}, []
    for p in sorted(left):
        if p in left:
            todo, blob = [p], []
            left.discard(p)
            while todo:
                y, x = todo.pop()
                blob.append((y, x))
                for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            out.append(sorted(blob))
    return out


@pytest.mark.parametrize("share", [0.0, 0.05, 0.3, 0.45, 0.6, 1.0])
def test_blobs_against_a_flood(share):
    rng = np.random.default_rng(7)
    for shape in ((1, 1), (1, 40), (33, 1), (31, 47)):
        mask = rng.random(shape) < share
        assert [list(map(tuple, b.tolist())) for b in signals.components(mask)] == plain_components(mask)


def test_blobs_of_winding_shapes():
    spiral = np.zeros((41, 41), bool)
    y, x, dy, dx = 0, 0, 0, 1
    spiral[0, 0] = True
    for leg in (n for k in range(40, 1, -2) for n in (k, k)):
        for _ in range(leg):
            if not (0 <= y + dy < 41 and 0 <= x + dx < 41):
                break
            y, x = y + dy, x + dx
            spiral[y, x] = True
        dy, dx = dx, -dy
    comb = np.zeros((60, 61), bool)
    comb[:, ::2], comb[-1] = True, True
    for mask in (spiral, comb):
        assert [list(map(tuple, b.tolist())) for b in signals.components(mask)] == plain_components(mask)


def test_dense_maps_are_quick():
    mask = np.random.default_rng(8).random((288, 512)) < 0.5
    began = time.process_time()
    signals.labels_of(mask)
    quick = time.process_time() - began
    began = time.process_time()
    plain_components(mask)
    assert 10 * quick < time.process_time() - began


def test_candidates_are_weighted_centres():
    heat = np.zeros((6, 8))
    heat[1, 1:3], heat[4, 5], heat[2, 6:8] = [0.6, 0.9], 0.95, [0.9, 0.9]
    got = signals.blob_candidates(heat, 0.5, 2, 0)
    assert got == [(pytest.approx(1.6), pytest.approx(1.0), 0.9, 2), (pytest.approx(6.5), 2.0, 0.9, 2)]
    assert [c[3] for c in signals.blob_candidates(heat, 0.5, 1, 1)] == [1] and signals.blob_candidates(heat, 0.99, 1, 0) == []


def plain_sweep(a, b, lags, least):
    z = lambda x: (x - x.mean()) / x.std() if x.std() > 1e-9 else x - x.mean()
    za, zb = z(np.array([e for _, e in a])), z(np.array([e for _, e in b]))
    out = {}
    for lag in range(-lags, lags + 1):
        pairs = [(p, q) for (i, _), p in zip(a, za, strict=True) for (j, _), q in zip(b, zb, strict=True) if j - i == lag]
        if len(pairs) >= least:
            p, q = np.array(pairs).T
            norm = np.sqrt((p * p).sum() * (q * q).sum())
            out[lag] = (len(pairs), (p * q).sum() / norm if norm > 1e-9 else 0.0)
    return out


@pytest.mark.parametrize("chunk", [1, 20, 64, 4096])
def test_sweep_against_all_pairs(spark, chunk):
    """Gaps, a repeated sample, samples before 0, a shift of 7."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=260)
    a = [(i - 20, float(base[i])) for i in range(230) if i % 13 != 5] + [(3, 0.5)]
    b = [(i - 20 + 7, float(base[i] + 0.1 * rng.normal())) for i in range(20, 260) if i % 17 != 4]
    frames = [spark.createDataFrame([(1, *r) for r in x] + [(2, i, 1.0) for i in range(40)], SAMPLE) for x in (a, b)]
    got = {(r.match, r.lag): (r.n, r.corr) for r in signals.offset_sweep(*frames, ["match"], 10, 150, 30, chunk).collect()}
    want = plain_sweep(a, b, 15, 30)
    assert {k[1] for k in got if k[0] == 1} == set(want) and all(got[1, k][0] == n and got[1, k][1] == pytest.approx(c, abs=1e-9) for k, (n, c) in want.items())
    assert max(want, key=lambda k: want[k][1]) == 7 and {got[2, k] for _, k in got if _ == 2} <= {(n, 0.0) for n in range(30, 41)}
    best = {r.match: r.offset_frames for r in signals.best_offset(signals.offset_sweep(*frames, ["match"], 10, 150, 30, chunk), ["match"]).collect()}
    assert best[1] == 70


def test_chunks_are_scored_as_the_whole_clip(spark):
    """A scorer of three frames: the sum of the last three values."""

    def loader():
        def score(pdf):
            total = pdf["v"].rolling(3).sum()
            return pd.DataFrame({"clip": pdf["clip"], "frame": pdf["frame"], "found": total.notna(), "u": total, "v": None, "confidence": 0.0, "reason": "ok"})

        return score

    scorers.register("sum3", loader)
    rows = spark.createDataFrame([(c, 2 * f + f // 7, float(f * f % 11)) for c, n in (("a", 57), ("b", 20), ("c", 1), ("d", 40)) for f in range(n)], "clip string, frame int, v double")
    whole = sorted(map(str, scorers.score_clips(rows, "sum3", chunk=10**6).collect()))
    for chunk in (2, 10, 20, 33):
        assert sorted(map(str, scorers.score_clips(rows, "sum3", chunk=chunk).collect())) == whole
    assert len(whole) == 118 and sum("found=False" in r for r in whole) == 7
    with pytest.raises(ValueError, match="chunk"):
        scorers.score_clips(rows, "sum3", chunk=1)


def test_table_functions_in_sql(spark, sf):
    tables.register(spark)
    courts.court_lines(spark).createOrReplaceTempView("court_lines")
    got = spark.sql("SELECT l.line, p.k, p.x, p.y FROM court_lines l, LATERAL segment_points(l.x1, l.y1, l.x2, l.y2, 60) p")
    want = courts.sample_segments(courts.court_lines(spark), 60).select("line", "k", "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 480
    obs, segments = _flights(spark, sf)
    bounces = obs.where("event_type = 'purchase'").select("clip", "frame", F.lit("floor_bounce").alias("type"), F.lit(None).cast("double").alias("x_m"), F.lit(None).cast("double").alias("y_m"))
    contacts = sequences.floor_contacts(obs, bounces, H, ["clip"])
    segments.createOrReplaceTempView("segments")
    contacts.createOrReplaceTempView("contacts")
    sql = f"""SELECT s.clip, s.seg_id, a.* FROM segments s JOIN contacts p ON p.clip = s.clip AND p.frame = s.start_frame JOIN contacts q ON q.clip = s.clip AND q.frame = s.end_frame,
        LATERAL arc_points(s.start_frame, s.end_frame, p.x_m, p.y_m, q.x_m, q.y_m, {FPS}D) a WHERE s.start_type = 'floor_bounce' AND s.end_type = 'floor_bounce'"""
    want = sequences.ballistic_arcs(segments, contacts, FPS, ["clip"]).select("clip", "seg_id", "frame", "x_m", "y_m", "z_m")
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rounded(spark.sql(sql)) == rounded(want) and want.count() > 50


def test_table_functions_refuse_what_they_can_t_take(spark):
    tables.register(spark)
    for call in ("segment_points(1.0, 2.0, 3.0, 4.0, 1)", "segment_points('a', 2.0, 3.0, 4.0, 5)", "arc_points(1, 5, 0.0, 0.0, 1.0, 1.0, 0.0)", "arc_points(1.5, 5, 0.0, 0.0, 1.0, 1.0, 20.0)"):
        with pytest.raises(Exception, match="segment_points|arc_points"):
            spark.sql(f"SELECT * FROM {call}").collect()
    assert spark.sql("SELECT * FROM arc_points(5, 5, 0.0, 0.0, 1.0, 1.0, 20.0)").count() == spark.sql("SELECT * FROM segment_points(NULL, 2.0, 3.0, 4.0, 5)").count() == 0


def test_queries_of_signals_still_give_rows(spark, sf):
    assert QUERIES["heatmap_detect"](spark, sf).count() > 0 and observations(spark, sf).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_heatmap_hits_need_no_join(spark, sf):
    """Heatmaps are made beside their targets: a join would gather them on the driver, to send them to all."""
    assert "Join" not in plan_of(QUERIES["heatmap_hits"](spark, sf))


def test_heatmaps_take_exponentials_along_each_axis_only(spark):
    df = spark.createDataFrame([(3.25, 1.5), (None, 1.0)], "u double, v double").select(geometry.gaussian_heatmap(8, 5, F.col("u"), F.col("v"), 1.5).alias("h"))
    for part in plan_of(df).split("EXP(")[1:]:
        assert len(set(re.findall(r"lambda x_\d+", part.split("lambdafunction")[0].split(", lambda")[0]))) == 1
    assert plan_of(df).count("EXP(") == 2
    got = [np.array(r.h) for r in df.collect()]
    y, x = np.mgrid[:5, :8]
    assert np.allclose(got[0], np.exp(-((x - 3.25) ** 2 + (y - 1.5) ** 2) / 4.5), rtol=1e-14, atol=0) and not got[1].any()


def test_pictures_of_a_batch_are_labelled_together(spark):
    """Blobs of many heatmaps at once are those of each; unlike sizes and missing heatmaps may lie in one batch."""
    rng = np.random.default_rng(5)
    maps = [rng.random((6, 7)) for _ in range(40)] + [np.zeros((6, 7)), rng.random((3, 9)), np.ones((6, 7))]
    want = [(k, i, x, y, peak, area) for k, m in enumerate(maps) for i, (x, y, peak, area) in enumerate(signals.blob_candidates(m, 0.6, 2, 0))]
    plain = [(k, len(b)) for k, m in enumerate(maps) for b in signals.components(m >= 0.6) if len(b) >= 2]
    assert sorted((k, area) for k, *_, area in want) == sorted(plain)
    df = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(maps)] + [(99, None), (98, [])], "frame int, heatmap array<array<double>>").coalesce(1)
    got = [tuple(r) for r in signals.detect_in_heatmaps(df, ["frame"], (1, 1), (1, 1), 0.6).orderBy("frame", "cand_idx").collect()]
    assert got == want


def test_ball_in_heatmap_is_one_pass(spark, sf):
    """A frame's blobs stay beside its peak: no join, no grouping, and the heatmaps are made once."""
    plan = plan_of(QUERIES["ball_in_heatmap"](spark, sf))
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("MapInArrow") == 1


def test_places_are_worked_out_once(spark, sf):
    """The bounds are looked at after the places, not by a filter that works them out again for each comparison."""
    filters = [line for line in plan_of(QUERIES["player_places"](spark, sf)).splitlines() if "Filter" in line]
    assert filters and all(">= 0.5" not in line for line in filters)


def test_wide_files_are_compressed(spark):
    path = _csv_of(spark, spark.range(50).selectExpr("id AS kp0_x"), "wide")
    names = [f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))]
    parts = [n for n in names if n.startswith("part-")]
    assert parts and all(n.endswith(".csv.gz") for n in parts) and spark.read.option("header", True).csv(path).count() == 50


def test_smoother_takes_little_memory_a_cell():
    rng, n, m = np.random.default_rng(7), 300, 60
    cells = {c: rng.random((n, m)) for c in ("u", "v", "x3", "y3", "z3", "track_x", "track_y", "confidence")} | {c: np.full((n, m), np.nan) for c in ("event_x", "event_y")}
    cells |= {"measured": np.ones((n, m), bool), "low": np.zeros((n, m), bool), "bounce": np.zeros((n, m), bool), "std3": np.full((n, m, 3), 0.3)}
    flights = physics.Flights(EkfConfig(), np.array(CAMERA_A).reshape(3, 4), H, FPS)
    tracemalloc.start()
    flights.run(np.full(n, m), cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / (n * m) < 1000


def test_colour_distances_of_a_frame_at_once():
    rng = np.random.default_rng(8)
    a, b = [rng.random(5) for _ in range(4)], [*(rng.random(5) for _ in range(3)), np.zeros(5)]
    for seen in (b, [*b, None], b[:1]):
        want = [[players.bhattacharyya_np(x, y) for y in seen] for x in a]
        got = players.color_distances(a, seen)
        assert [[z is None for z in row] for row in got] == [[z is None for z in row] for row in want]
        assert np.allclose(np.array(got, float), np.array(want, float), equal_nan=True, rtol=1e-12)
    assert players.color_distances(a, []) == [[]] * 4
