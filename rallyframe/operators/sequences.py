"""Window operators over an ordered clip: deltas, gap filling, runs, mining of hard frames, flight segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import Matrix, num, rounded, transform_point
from ..schemas import GRAVITY, MiningConfig


def by_frame(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("frame")


def with_speed(points: DataFrame, fps: float, keys: list[str], columns: tuple[str, ...] = ("x", "y", "z"), name: str = "speed_kmh") -> DataFrame:
    """km/h from the point before, over the frames that really lie between; null on the first."""
    w = by_frame(keys)
    moved = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in columns[1:]), (F.col(columns[0]) - F.lag(columns[0]).over(w)) * (F.col(columns[0]) - F.lag(columns[0]).over(w))))
    return points.withColumn(name, moved / ((F.col("frame") - F.lag("frame").over(w)) / num(fps)) * 3.6)


def frame_stride(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The median gap between frames of a clip."""
    gaps = frames.withColumn("_gap", F.col("frame") - F.lag("frame").over(by_frame(keys)))
    return gaps.where("_gap > 0").groupBy(*keys).agg(F.percentile("_gap", F.lit(0.5)).alias("stride"))


def interpolate_gaps(points: DataFrame, max_gap: int, keys: list[str], columns: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Fill runs of nulls of at most `max_gap` rows linearly between the points on both sides; adds `interpolated`."""
    order = by_frame(keys)
    place = F.row_number().over(order)
    upto, since = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    out = points.withColumn("_i", place).withColumn("_p", F.when(F.col(columns[0]).isNotNull(), F.struct("_i", *columns)))
    out = out.withColumn("_a", F.last("_p", True).over(upto)).withColumn("_b", F.first("_p", True).over(since))
    fill = F.col(columns[0]).isNull() & (F.col("_b._i") - F.col("_a._i") - 1 <= max_gap)
    fill = F.coalesce(fill, F.lit(False))
    share = (F.col("_i") - F.col("_a._i")) / (F.col("_b._i") - F.col("_a._i"))
    out = out.withColumn("interpolated", fill)
    for c in columns:
        out = out.withColumn(c, F.when(F.col("interpolated"), F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * share).otherwise(F.col(c)))
    return out.drop("_i", "_p", "_a", "_b")


def runs(frames: DataFrame, flag: Column, keys: list[str]) -> DataFrame:
    """Unbroken runs of rows where `flag` holds: (keys, first_frame, last_frame, n)."""
    w = by_frame(keys)
    marked = frames.withColumn("_f", flag).withColumn("_i", F.row_number().over(w))
    marked = marked.where("_f").withColumn("_island", F.col("_i") - F.row_number().over(w))
    return marked.groupBy(*keys, "_island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n")).drop("_island")


def episodes(frames: DataFrame, flag: Column, keys: list[str]) -> DataFrame:
    """(keys, n_true, n_runs)."""
    marked = frames.withColumn("_f", flag)
    starts = F.col("_f") & ~F.coalesce(F.lag("_f").over(by_frame(keys)), F.lit(False))
    return marked.withColumn("_s", starts).groupBy(*keys).agg(F.count_if("_f").alias("n_true"), F.count_if("_s").alias("n_runs"))


def longest_miss(frames: DataFrame, warmup: Column, keys: list[str]) -> DataFrame:
    """The longest run of frames without a ball; warm-up rows neither lengthen nor break one."""
    counted = frames.where(~warmup)
    longest = runs(counted, ~F.col("found"), keys).groupBy(*keys).agg(F.max("n").alias("longest"))
    return counted.select(*keys).distinct().join(longest, keys, "left").select(*keys, F.coalesce("longest", F.lit(0)).alias("longest_miss"))


def isolation_support(hits: DataFrame, keys: list[str], reach: int = 3) -> DataFrame:
    """For each hit, at how many distances up to `reach` frames there is another before or after."""
    near = F.collect_list("frame").over(by_frame(keys).rangeBetween(-reach, reach))
    apart = F.filter(F.transform("_near", lambda f: F.abs(f - F.col("frame"))), lambda d: d > 0)
    return hits.withColumn("_near", near).withColumn("support", F.size(F.array_distinct(apart)).cast("long")).drop("_near")


def static_hits(hits: DataFrame, keys: list[str], cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """Hits in the middle of a run that hardly moves: at least `static_run` hits within the window, none farther than the radius.
    Adds `still`; runs are reported once in `static_window` frames (see `hard_frames`)."""
    w = by_frame(keys).rangeBetween(-cfg.static_window, cfg.static_window)
    near = F.collect_list(F.struct("u", "v")).over(w)
    far = F.transform("_near", lambda p: F.sqrt((p["u"] - F.col("u")) * (p["u"] - F.col("u")) + (p["v"] - F.col("v")) * (p["v"] - F.col("v"))))
    return hits.withColumn("_near", near).withColumn("still", (F.size("_near") >= cfg.static_run) & (F.array_max(far) <= cfg.static_radius)).drop("_near")


def spaced(frames: Column, least: int) -> Column:
    """Of an ordered array of frames those at least `least` after the last one taken."""
    start = F.array().cast("array<int>")
    return F.aggregate(frames, start, lambda taken, f: F.when((F.size(taken) == 0) | (f - F.element_at(taken, -1) >= least), F.concat(taken, F.array(f.cast("int")))).otherwise(taken))


def hard_frames(log: DataFrame, keys: list[str], cfg: MiningConfig = MiningConfig()) -> DataFrame:
    """Frames worth labelling: isolated hits, hits on something static, unsure hits, and short losses while tracking.

    `log`: keys, frame, found, u, v, confidence, status, coast. Values are rounded before they are compared."""
    rows = log.withColumns({"u": rounded(F.col("u"), 1), "v": rounded(F.col("v"), 1), "confidence": rounded(F.col("confidence"), 3)})
    hits = static_hits(isolation_support(rows.where("found"), keys, cfg.reach), keys, cfg)
    still = hits.where((F.col("support") >= cfg.min_support) & F.col("still"))
    picked = still.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("frame").cast("int"))).alias("_f"))
    picked = picked.select(*keys, F.explode(spaced(F.col("_f"), cfg.static_run)).alias("frame"), F.lit(True).alias("_static"))
    reason = F.when(F.col("support") < cfg.min_support, "fp_isolated").when(F.col("_static"), "fp_static").when(F.col("confidence") < cfg.low_conf, "lowconf")
    wrong = hits.join(picked, [*keys, "frame"], "left").withColumn("reason", reason).where("reason is not null")
    missed = rows.where(~F.col("found") & (F.col("status") == "coasting") & (F.col("coast") <= cfg.max_gap)).withColumn("reason", F.lit("miss"))
    priority = F.when(F.col("reason") == "fp_static", 2).when(F.col("reason") == "lowconf", 3).otherwise(1)
    names = [*keys, "frame", "reason", priority.alias("priority"), F.col("u").alias("hint_u"), F.col("v").alias("hint_v"), "confidence"]
    return wrong.select(names).unionByName(missed.select(names))


def genuine_apexes(tracked: DataFrame, near_event: DataFrame, keys: list[str], slow: float = 600.0, fast: float = 1500.0, reach: int = 8) -> DataFrame:
    """Rows where the ball is slow between fast stretches, away from events."""
    w = by_frame(keys)
    measured = F.when(F.col("measured"), F.col("speed"))
    rows = tracked.withColumn("_before", F.max(measured).over(w.rowsBetween(-reach, -1))).withColumn("_after", F.max(measured).over(w.rowsBetween(1, reach)))
    rows = rows.where(F.col("measured") & (F.col("status") == "tracking") & (F.col("speed") > 0) & (F.col("speed") < slow) & (F.col("_before") >= fast) & (F.col("_after") >= fast))
    return rows.drop("_before", "_after").join(near_event.select(*keys, "frame"), [*keys, "frame"], "left_anti")


BREAKING = ("floor_bounce", "wall_bounce", "hit")


def flight_segments(points: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches between boundaries: the first and last tracked frame, and events inside. Neighbours share a boundary.

    Gives (keys, seg_id, start_frame, end_frame, start_type, end_type); types are null at ends without an event."""
    ends = points.groupBy(*keys).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    breaking = events.where(F.col("type").isin(*BREAKING)).groupBy(*keys, "frame").agg(F.max("type").alias("type"))
    inside = breaking.join(ends, keys).where(F.col("frame").between(F.col("lo"), F.col("hi"))).select(*keys, "frame")
    bounds = ends.select(*keys, F.explode(F.array("lo", "hi")).alias("frame")).union(inside).distinct().join(breaking, [*keys, "frame"], "left")
    w = by_frame(keys)
    rows = bounds.select(*keys, F.col("frame").alias("start_frame"), F.col("type").alias("start_type"), F.lead("frame").over(w).alias("end_frame"), F.lead("type").over(w).alias("end_type"), (F.row_number().over(w) - 1).alias("seg_id"))
    return rows.where("end_frame is not null")


def segment_points(points: DataFrame, segments: DataFrame, keys: list[str], band: int = 64) -> DataFrame:
    """Points with their segments, as an equi-join on bands of frames; a boundary point belongs to both."""
    cut = segments.withColumn("_band", F.explode(F.sequence(F.floor(F.col("start_frame") / band), F.floor(F.col("end_frame") / band))))
    return points.withColumn("_band", F.floor(F.col("frame") / band)).join(cut, [*keys, "_band"]).where(F.col("frame").between(F.col("start_frame"), F.col("end_frame"))).drop("_band")


def segment_stats(points: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Frames, measured points, ends on the floor, whether there is enough to fit, whether it is long."""
    group = [*keys, "seg_id", "start_frame", "end_frame", "start_type", "end_type"]
    anchors = (F.coalesce(F.col("start_type") == "floor_bounce", F.lit(False)).cast("int") + F.coalesce(F.col("end_type") == "floor_bounce", F.lit(False)).cast("int"))
    out = segment_points(points, segments, keys).groupBy(*group).agg(F.count_if("measured").alias("n_measured"))
    n_frames = F.col("end_frame") - F.col("start_frame") + 1
    return out.withColumns({"n_frames": n_frames, "floor_anchors": anchors, "fittable": F.col("n_measured") >= 3, "is_long": n_frames > 60})


def ballistic_arcs(segments: DataFrame, contacts: DataFrame, fps: float, keys: list[str], *also: str) -> DataFrame:
    """Points of the arcs between two floor contacts: straight in x and y, a parabola in z under gravity.

    `contacts`: keys, frame, x_m, y_m. Segments without a contact at both ends have no points; `segment_arcs` names them open.
    `also`: further columns of the segments to be kept."""
    both = segments.where("start_type = 'floor_bounce' and end_type = 'floor_bounce' and end_frame > start_frame")
    at = lambda side: contacts.select(*keys, F.col("frame").alias(f"{side}_frame"), F.col("x_m").alias(f"{side}_x"), F.col("y_m").alias(f"{side}_y"))
    both = both.join(at("start"), [*keys, "start_frame"]).join(at("end"), [*keys, "end_frame"])
    rows = both.withColumn("frame", F.explode(F.sequence("start_frame", "end_frame")))
    total, tau = (F.col("end_frame") - F.col("start_frame")) / num(fps), (F.col("frame") - F.col("start_frame")) / num(fps)
    share = tau / total
    z = F.greatest(num(0), 0.5 * GRAVITY * total * tau - 0.5 * GRAVITY * tau * tau)
    return rows.select(*keys, "seg_id", *also, "frame", (F.col("start_x") + (F.col("end_x") - F.col("start_x")) * share).alias("x_m"), (F.col("start_y") + (F.col("end_y") - F.col("start_y")) * share).alias("y_m"), z.alias("z_m"), (num(GRAVITY) * total * total / 8).alias("apex_m"))


def segment_arcs(segments: DataFrame, contacts: DataFrame, keys: list[str]) -> DataFrame:
    """Arcs of every segment: one between each two neighbouring floor contacts inside it (`kind` anchored), or one over the
    whole segment where there are fewer than two (open). `contacts`: keys, frame.

    Gives (keys, seg_id, arc_id, start_frame, end_frame, kind)."""
    inside = segment_points(contacts.select(*keys, "frame").distinct(), segments.select(*keys, "seg_id", "start_frame", "end_frame"), keys)
    w = Window.partitionBy(*keys, "seg_id").orderBy("frame")
    pairs = inside.select(*keys, "seg_id", F.col("frame").alias("start_frame"), F.lead("frame").over(w).alias("end_frame"), (F.row_number().over(w) - 1).alias("arc_id")).where("end_frame is not null")
    anchored = pairs.select(*keys, "seg_id", "arc_id", "start_frame", "end_frame", F.lit("anchored").alias("kind"))
    rest = segments.join(pairs.select(*keys, "seg_id").distinct(), [*keys, "seg_id"], "left_anti")
    return anchored.unionByName(rest.select(*keys, "seg_id", F.lit(0).alias("arc_id"), "start_frame", "end_frame", F.lit("open").alias("kind")))


def floor_contacts(points: DataFrame, events: DataFrame, homography: Matrix, keys: list[str]) -> DataFrame:
    """Where floor bounces touch: the event's metres, else the track's point through the homography."""
    x, y = transform_point(homography, F.col("u"), F.col("v"))
    floor = events.where("type = 'floor_bounce'").select(*keys, "frame", "x_m", "y_m")
    return floor.join(points.select(*keys, "frame", x.alias("_x"), y.alias("_y")), [*keys, "frame"], "left").select(*keys, "frame", F.coalesce("x_m", "_x").alias("x_m"), F.coalesce("y_m", "_y").alias("y_m"))


def provenance(trajectory: DataFrame, log: DataFrame, fps: float, keys: list[str]) -> DataFrame:
    """Output rows of a trajectory beside the log: pixels, metres, speed, where the point comes from, the event.

    `log`: keys, frame, measured, meas_u, meas_v, track_x, track_y, has_3d, event."""
    rows = with_speed(trajectory, fps, keys).join(log, [*keys, "frame"], "left")
    u, v = F.coalesce(F.when(F.col("measured"), F.col("meas_u")), F.col("track_x")), F.coalesce(F.when(F.col("measured"), F.col("meas_v")), F.col("track_y"))
    source = F.when(F.col("has_3d"), "triangulated").when(F.col("measured"), "measured").otherwise("gap")
    return rows.select(*keys, "frame", rounded(u, 1).alias("u"), rounded(v, 1).alias("v"), rounded(F.col("x"), 3).alias("x_m"), rounded(F.col("y"), 3).alias("y_m"), rounded(F.col("z"), 3).alias("z_m"), rounded(F.col("speed_kmh"), 1).alias("speed_kmh"), source.alias("source"), F.coalesce("event", F.lit("")).alias("event"))


def placement(frames: DataFrame) -> DataFrame:
    """Which place a dual view shows: triangulated, else camera A's floor point on the court, else B's, else none.

    `frames` has x3, y3, z3 and xa, ya, xb, yb in global metres."""
    on = lambda s: F.coalesce(F.col(f"x{s}").between(-2, 12) & F.col(f"y{s}").between(-2, 22), F.lit(False))
    has3 = F.col("x3").isNotNull()
    pick = lambda c: F.when(has3, F.col(f"{c}3")).when(on("a"), F.col(f"{c}a")).when(on("b"), F.col(f"{c}b"))
    source = F.when(has3, "both").when(on("a"), "side-1").when(on("b"), "side-2").otherwise("lost")
    return frames.withColumns({"court_x_m": pick("x"), "court_y_m": pick("y"), "court_z_m": F.when(has3, F.col("z3")), "source": source})


def trail(points: DataFrame, keys: list[str], length: int = 30) -> DataFrame:
    """The last points up to each row, back to the latest gap."""
    w = by_frame(keys)
    gap = F.sum(F.when(F.col("u").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = points.withColumn("_g", gap).where("u is not null")
    last = Window.partitionBy(*keys, "_g").orderBy("frame").rowsBetween(-(length - 1), 0)
    return rows.withColumn("trail", F.collect_list(F.struct("u", "v")).over(last)).drop("_g")
