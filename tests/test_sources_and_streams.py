import json

import pytest
from pyspark.sql import functions as F
from rallyframe.operators.tracking import suppress_parked, track, tracked_events
from rallyframe.plans.views import H, observations
from rallyframe.sources import readers, scorers, writers
from rallyframe.streaming.ball import detections_by_window, suppress_stream, track_stream


def test_labels(spark, tmp_path):
    (tmp_path / "l.csv").write_text("frame,visible,u,v\n2,1,10.0,20.0\n0,1,,\n2,1,11.5,21.0\n4,0,,\n1,true,3,4\n")
    path = str(tmp_path / "l.csv")
    with pytest.raises(Exception):  # noqa: B017
        readers.labels_latest(spark, path).collect()
    got = [(r.frame, r.visible, r.u) for r in readers.labels_all(spark, path).orderBy("frame", "u").collect()]
    assert got == [(0, 1, None), (1, 1, 3.0), (2, 1, 10.0), (2, 1, 11.5), (4, 0, None)]
    (tmp_path / "m.csv").write_text("frame,visible,u,v\n2,1,10.0,20.0\n0,1,,\n2,1,11.5,21.0\n4,0,,\n")
    got = {r.frame: (r.visible, r.u) for r in readers.labels_latest(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {2: (1, 11.5), 0: (0, None), 4: (0, None)}
    assert readers.labels_latest(spark, str(tmp_path / "none.csv")).count() == 0
    assert sorted(r.frame for r in readers.frame_list(spark, path).collect()) == [0, 1, 2, 4]


def test_event_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("frame,type,u,in_court\n5,floor_bounce,1.5,Yes\n,hit,2,no\n7,,x,maybe\n")
    got = [(r.frame, r.type, r.u, r.x_m, r.in_court) for r in readers.event_rows(spark, str(tmp_path / "e.csv")).orderBy("frame").collect()]
    assert got == [(5, "floor_bounce", 1.5, None, True), (7, None, None, None, None)]


def test_frame_log_with_bad_lines(spark, tmp_path):
    good = {"frame": 3, "found": True, "u": 1.0, "v": 2.0, "confidence": 0.5, "reason": "ok", "track": {"x": 1.0, "y": 2.0, "measured": True, "status": "tracking"}, "event": {"frame": 3, "type": "floor_bounce", "u": 1.0, "v": 2.0}}
    lines = [json.dumps(good), "", "{\"frame\": 4, \"fou", "\x00" + json.dumps({"frame": 5, "found": False, "ball3d": {"x": 1.0, "y": 2.0, "z": 3.0}}) + "\x00"]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = readers.frame_log(spark, str(tmp_path / "log.jsonl"))
    assert log.where("corrupt is not null").count() == 1 and sorted(r.frame for r in log.where("corrupt is null").collect()) == [3, 5]
    assert readers.predicted_bounces(spark, str(tmp_path / "log.jsonl")).first().frame == 3
    points, events = readers.track_points(log)
    assert points.count() == 1 and events.count() == 1 and readers.triangulated_points(log).first().std == [0.3, 0.3, 0.3]
    writers.write_log(log.where("corrupt is null").drop("corrupt"), str(tmp_path / "out"))
    assert readers.frame_log(spark, str(tmp_path / "out")).where("corrupt is null").count() == 2


def test_keypoints_round_trip(spark, tmp_path):
    points = F.array(*(F.struct(F.lit(float(i)).alias("x"), F.lit(i + 0.5).alias("y"), F.lit(0.9).alias("c")) for i in range(17)))
    rows = spark.createDataFrame([(1, 1), (2, 7)], "frame int, player_id int").withColumn("keypoints", points)
    writers.write_players(rows, str(tmp_path / "players"))
    back = readers.wide_keypoints(spark, str(tmp_path / "players" / "player_id=1"))
    assert back.count() == 1 and back.first().keypoints[16].y == 16.5 and not (tmp_path / "players" / "player_id=7").exists()
    box = readers.keypoint_bounds(rows.withColumns({"x1": F.lit(-1.0), "y1": F.lit(0.0), "x2": F.lit(5.0), "y2": F.lit(30.0)}), ["frame"]).first()
    assert (box.x_min, box.y_min, box.x_max, box.y_max) == (-1.0, 0.0, 16.0, 30.0)
    with pytest.raises(ValueError):
        (tmp_path / "x.csv").write_text("a,b\n1,2\n")
        readers.wide_keypoints(spark, str(tmp_path / "x.csv"))


def test_label_file_round_trip(spark, tmp_path):
    labels = spark.createDataFrame([(3, 1, 1.25, 2.0), (1, 0, None, None)], "frame int, visible int, u double, v double")
    writers.write_labels(labels, str(tmp_path / "labels"))
    got = {r.frame: (r.visible, r.u) for r in readers.labels_all(spark, str(tmp_path / "labels")).collect()}
    assert got == {3: (1, 1.3), 1: (0, None)}


def test_scorer_hook(spark):
    frames = spark.createDataFrame([("a", i) for i in range(5)], "clip string, frame int")
    assert {r.reason for r in scorers.score_frames(frames).collect()} == {"stub-no-weights"}
    scorers.register("all", lambda: lambda pdf: pdf[["clip", "frame"]].assign(found=True, u=1.0, v=2.0, confidence=0.9, reason="ok"))
    got = {r.frame: (r.found, r.reason) for r in scorers.mark_warmup(scorers.score_frames(frames, "all")).collect()}
    assert got == {0: (False, "warmup"), 1: (False, "warmup"), 2: (True, "ok"), 3: (True, "ok"), 4: (True, "ok")}


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = observations(spark, sf).select("clip", "frame", F.lit(0).alias("cand_idx"), "u", "v", "confidence")
    for part in range(3):
        rows.where((F.col("frame") >= part * 25) & (F.col("frame") < (part + 1) * 25)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = track_stream(stream, H, idle_ms=None).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    streamed = spark.table("tracks")
    batch = track(rows.where("frame < 75"))
    names = ["clip", "frame", "status", "x", "y", "vx", "vy", "coast"]
    assert sorted(map(tuple, streamed.select(names).collect()), key=str) == sorted(map(tuple, batch.select(names).collect()), key=str)
    events = tracked_events(rows.where("frame < 75"), H)
    assert sorted((r.clip, r.frame, r.event_type) for r in streamed.where("event_type is not null").collect()) == sorted((r.clip, r.frame, r.type) for r in events.collect())


def streamed(spark, tmp_path, rows, name, make):
    """All rows of a stream that is read file by file, in three stretches of frames."""
    for part in range(3):
        rows.where((F.col("frame") >= part * 20) & (F.col("frame") < (part + 1) * 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_parked_blobs_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(c, f, i, *p) for c in (1, 2) for f in range(60) for i, p in enumerate([(500.0 + (f % 2), 400.0, 0.9), (100.0 + 40.0 * f, 300.0, 0.8)])], "clip long, frame int, cand_idx int, u double, v double, confidence double")
    got = streamed(spark, tmp_path, rows, "parked", lambda s: suppress_stream(s, idle_ms=None))
    want = suppress_parked(rows)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.where("not kept").count() > 20


def test_windows_drop_late_rows(spark, tmp_path):
    def batch(name, *seconds):
        spark.createDataFrame([("a", s) for s in seconds], "clip string, s long").select("clip", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()

    spark.createDataFrame([], "clip string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("clip string, ts timestamp").parquet(str(tmp_path / "in"))
    query = detections_by_window(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    batch("one", 0, 10, 20)
    batch("two", 200)
    batch("three", 5, 400)
    batch("four", 600)
    query.stop()
    assert spark.table("windows").orderBy("start").first().n == 3
