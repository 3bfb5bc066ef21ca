"""Streams with typed state: identities with saved profiles, folds over frames in any order, lockstep, the fixed-lag smoother."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from rallyframe.operators import physics
from rallyframe.operators.joins import sync_join
from rallyframe.operators.players import identify, identity_states
from rallyframe.operators.tracking import suppress_parked, track, tracked_events
from rallyframe.plans.queries import _two_cameras
from rallyframe.plans.views import H, observations
from rallyframe.streaming import folds
from rallyframe.streaming.identities import identify_stream, identity_snapshot
from rallyframe.streaming.lockstep import sync_stream

START = 1_700_000_000
HISTS = {1: [1.0, 0.0], 2: [0.0, 1.0]}
DETECTION = "match long, frame int, det_idx int, x double, y double, hist array<double>"
PROFILE = "match long, player_id int, hist array<double>, x double, y double"


def timed(rows, fps=20):
    return rows.withColumn("ts", F.timestamp_millis(F.lit(START * 1000) + (F.col("frame") * 1000 / fps).cast("long")))


def drained(query, n):
    """Wait until a stream that never ends by itself has read n rows, and stop it."""
    seen, until = {}, time.time() + 120
    while sum(seen.values()) < n:
        assert query.isActive and time.time() < until, query.exception()
        time.sleep(0.1)
        seen |= {p.batchId: p.numInputRows for p in query.recentProgress}
    query.stop()


def detections(spark):
    return spark.createDataFrame([(m, f, i, float(i + 1), f / 10, HISTS[(i + f // 25) % 2 + 1]) for m in (7, 8) for f in range(60) for i in range(2) if i == 0 or not 30 <= f < 45], DETECTION)


def players(spark):
    return spark.createDataFrame([(m, i, HISTS[i], None, None) for m in (7, 8) for i in (1, 2)], PROFILE)


def identified(spark, rows, profiles, tmp_path, parts, **options):
    """The stream is started anew for each part, from its checkpoint."""
    for lo, hi in parts:
        part = rows.where((F.col("frame") >= lo) & (F.col("frame") < hi))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        out = identify_stream(stream, profiles, **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        drained(out.trigger(processingTime="200 milliseconds").start(), part.count())
    return spark.read.parquet(str(tmp_path / "out"))


def test_identities_after_a_restart_and_their_snapshot(spark, tmp_path):
    rows, profiles = detections(spark), players(spark)
    want = identify(rows, profiles, ["match"])
    got = identified(spark, rows, profiles, tmp_path, [(0, 25), (25, 60)])
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.where("reentry").count() > 0
    snapshot, states = identity_snapshot(spark, str(tmp_path / "state")), identity_states(rows, profiles, ["match"])
    assert sorted(map(str, snapshot.select(states.columns).collect())) == sorted(map(str, states.collect()))
    later = spark.createDataFrame([(7, f, 0, 1.0, 1.0, HISTS[1]) for f in range(3)], DETECTION)
    again = identify(later, snapshot.select("match", "player_id", "hist", "x", "y"), ["match"])
    assert {(r.player_id, r.frame) for r in again.collect()} == {(1, 0), (1, 1), (1, 2)}


def test_places_expire_with_time_and_matches_when_idle(spark, tmp_path):
    rows, profiles = detections(spark).where("match = 7"), players(spark)
    got = identified(spark, rows, profiles, tmp_path, [(0, 10), (10, 20)], place_ms=1)
    assert got.where("frame = 10 and pos_dist_m is not null").count() == 0 and got.where("frame = 11 and pos_dist_m is not null").count() > 0
    assert identity_snapshot(spark, str(tmp_path / "state")).where("match = 7").count() == 4
    rows.where("frame < 10").coalesce(1).write.parquet(str(tmp_path / "idle"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "idle"))
    query = identify_stream(stream, profiles, idle_ms=1).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state2")).trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60
    while time.time() < until and not (len(query.recentProgress) > 3 and query.recentProgress[-1].numInputRows == 0 and query.recentProgress[-1].stateOperators[0].numRowsTotal <= 8):
        time.sleep(0.2)
    query.stop()
    assert identity_snapshot(spark, str(tmp_path / "state2")).where("match = 7").count() == 0


def shuffled(spark, rows, tmp_path, name, make, key, parts=4, reach=15, seed=5):
    """All rows of a stream whose frames come out of order by up to `reach`; last a row of another key, far later."""
    rng = random.Random(seed)
    frames = [r[0] for r in rows.select("frame").distinct().collect()]
    place = spark.createDataFrame([(f, rng.randrange(-reach, reach)) for f in frames], "frame int, moved int")
    last = max(frames) + reach
    dealt = timed(rows).join(place, "frame").withColumn("part", F.floor((F.col("frame") + F.col("moved")) * parts / (last + 1)))
    for part in range(-1, parts):
        dealt.where(F.col("part") == part).drop("part", "moved").select(timed(rows).columns).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{name}"))
    flush = timed(rows).limit(1).withColumns({key: F.lit(-99).cast(dict(rows.dtypes)[key]), "frame": F.lit(10**6).cast("int"), "ts": F.timestamp_seconds(F.lit(START + 10**5))})
    flush.select(timed(rows).columns).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{name}"))
    stream = spark.readStream.schema(timed(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{name}"))
    for _ in range(2):  # the second goes on from the checkpoint
        query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / f"out{name}")).option("checkpointLocation", str(tmp_path / f"state{name}")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"out{name}")).where(F.col(key) != -99), query


def test_track_of_shuffled_frames(spark, sf, tmp_path):
    rows = observations(spark, sf).where("clip < 6 and frame < 80").select("clip", "frame", F.lit(0).alias("cand_idx"), "u", "v", "confidence")
    got, query = shuffled(spark, rows, tmp_path, "tracks", lambda s: folds.track_in_order(s, H), "clip")
    names = ["clip", "frame", "status", "x", "y", "vx", "vy", "coast"]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(map(tuple, track(rows).select(names).collect()), key=str)
    assert sorted((r.clip, r.frame, r.event_type) for r in got.where("event_type is not null").collect()) == sorted((r.clip, r.frame, r.type) for r in tracked_events(rows, H).collect())


def test_parked_blobs_of_shuffled_frames(spark, tmp_path):
    rows = spark.createDataFrame([(c, f, i, *p) for c in (1, 2) for f in range(60) for i, p in enumerate([(500.0 + (f % 2), 400.0, 0.9), (100.0 + 40.0 * f, 300.0, 0.8)])], "clip long, frame int, cand_idx int, u double, v double, confidence double")
    got, _ = shuffled(spark, rows, tmp_path, "parked", folds.suppress_in_order, "clip", reach=10)
    want = suppress_parked(rows)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.where("not kept").count() > 20


def test_lockstep_of_streams(spark, sf, tmp_path):
    obs = observations(spark, sf).select(F.floor(F.col("clip") / 2).cast("long").alias("match"), F.col("clip") % 2 == 0, "frame", "found", "u")
    a, b = (timed(obs.where(obs.columns[1] if even else f"not ({obs.columns[1]})").select("match", "frame", "found", "u")) for even in (True, False))
    streams = []
    for name, rows in (("a", a), ("b", b)):
        for part in range(3):
            rows.where(F.floor(F.col("frame") / 15) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        spark.createDataFrame([(-1, 10**6, None, None)], "match long, frame int, found boolean, u double").withColumn("ts", F.timestamp_seconds(F.lit(START + 10**5))).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    query = sync_stream(*streams, 3, ["match"], 20, late="1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = sync_join(*(x.where("frame < 45").drop("ts") for x in (a, b)), 3, ["match"])
    got = spark.read.parquet(str(tmp_path / "out")).where("match >= 0")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 100
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 4  # all but the last rows have gone


LOG = "clip long, frame int, measured boolean, u double, v double, confidence double, track_x double, track_y double, x3 double, y3 double, z3 double, std3 array<double>, event_type string, event_x double, event_y double"


def flights(spark, n=150, clips=2):
    """Balls that bounce on the floor, seen by a camera with noise and gaps; now and then triangulated."""
    a, _ = _two_cameras()
    rng, rows = np.random.default_rng(3), []
    for c in range(clips):
        s = np.array([3.0 + c, 4.0, 1.0, 1.0, 3.0, 4.0])
        for f in range(n):
            s[:3] += s[3:] / 20
            s[5] -= 9.81 / 20
            event = None
            if s[2] < 0:
                s[2], s[5], event = 0.0, -0.7 * s[5], "floor_bounce"
            if s[1] > 18 or s[1] < 2:
                s[4] = -s[4]
            w = a.p @ [*s[:3], 1.0]
            u, v = w[:2] / w[2] + rng.normal(scale=2.0, size=2)
            if f % 11 == 5:
                continue
            seen, three = f % 7 != 3, f % 9 == 0
            rows.append((c, f, seen, float(u) if seen else None, float(v) if seen else None, 0.9, None, None, *((float(x) for x in s[:3] + rng.normal(scale=0.1, size=3)) if three else (None,) * 3), [0.2] * 3 if three else None, event, float(s[0]) if event else None, float(s[1]) if event else None))
    return spark.createDataFrame(rows, LOG), a.p


def places(df):
    return {(r.clip, r.frame): (r.x, r.y, r.z) for r in df.collect()}


def test_clips_stepped_together_are_as_alone(spark):
    """Arrays of clips against one clip at a time, with clips of all lengths, one without a place, a clip without a key."""
    log, camera = flights(spark, n=90, clips=6)
    log = log.where("frame < 20 + 14 * clip").unionByName(log.limit(3).withColumns({"clip": F.lit(None).cast("long")})).unionByName(log.where("clip = 1 and not measured and x3 is null").withColumn("clip", F.lit(77).cast("long")))
    log = log.withColumn("event_x", F.when(F.col("clip") != 2, F.col("event_x"))).withColumn("track_x", F.col("u")).withColumn("track_y", F.col("v"))
    h = (0.01, 0.001, 0.2, 0.0, 0.02, 0.1, 0.0, 0.0001, 1.0)
    want = places(physics.fixed_lag(log, camera, h, 20, ["clip"], 10**6))
    for cells in (100_000, 150):
        got = places(physics.trajectory(log, camera, h, 20, ["clip"], most_cells=cells))
        assert got.keys() == want.keys() and len({k[0] for k in got}) == 7
        assert max(math.dist(got[k], want[k]) for k in want) < 1e-7


@pytest.mark.parametrize(("lag", "error"), [(1_000, 0.0), (40, 0.05), (15, 0.35)])
def test_fixed_lag_follows_the_smoother(spark, lag, error):
    log, camera = flights(spark)
    flat = (1, 0, 0, 0, 1, 0, 0, 0, 1)
    want, got = places(physics.trajectory(log, camera, flat, 20, ["clip"])), places(physics.fixed_lag(log, camera, flat, 20, ["clip"], lag))
    assert got.keys() == want.keys()
    apart = [math.dist(got[k], want[k]) for k in want]
    assert max(apart) < 1e-7 if error == 0 else np.percentile(apart, 95) <= error


def test_flight_on_a_stream(spark, tmp_path):
    log, camera = flights(spark, n=100)
    flat = (1, 0, 0, 0, 1, 0, 0, 0, 1)
    for lag in (500, 20):
        got, _ = shuffled(spark, log, tmp_path, f"flight{lag}", lambda s, lag=lag: folds.flight_in_order(s, camera, flat, 20, lag), "clip")
        assert places(got) == places(physics.fixed_lag(log, camera, flat, 20, ["clip"], lag))
    want = places(physics.trajectory(log, camera, flat, 20, ["clip"]))
    assert all(math.dist(p, want[k]) < 1e-7 for k, p in places(physics.fixed_lag(log, camera, flat, 20, ["clip"], 500)).items())
