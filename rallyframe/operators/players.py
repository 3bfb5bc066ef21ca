"""Players: identities by position and colour, fusion of two cameras."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Matrix, Polygon, box_center, foot_point, in_court, in_polygon, num, to_global, transform_point
from ..schemas import IdentityConfig
from .clips import none, per_clip, stretches
from .joins import cluster


def cell_cost(dist_m: Column, color: Column, fresh: Column, cfg: IdentityConfig = IdentityConfig()) -> Column:
    """Cost of giving a detection to a profile: distance (if the profile's place is fresh) and colour, weighted by what
    there is; null if there is neither."""
    pos = F.coalesce(fresh, F.lit(False)) & dist_m.isNotNull()
    weight = F.when(pos, num(cfg.w_pos)).otherwise(num(0)) + F.when(color.isNotNull(), num(cfg.w_color)).otherwise(num(0))
    cost = F.when(pos, num(cfg.w_pos) * F.least(num(1), dist_m / num(cfg.diagonal_m))).otherwise(num(0)) + F.when(color.isNotNull(), num(cfg.w_color) * color).otherwise(num(0))
    return F.when(weight > 0, cost / F.nullif(weight, num(0)))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the least total, as many as the shorter side. Each row is given a column by the cheapest
    chain of moves of the rows before it, under prices that keep all reduced costs from falling below 0."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    costs, n_columns = cost.tolist(), cost.shape[1]
    of_row, of_column = [0.0] * len(costs), [0.0] * n_columns  # prices
    row_of = [-1] * n_columns
    for row in range(len(costs)):
        least, back, done, open_ = [math.inf] * n_columns, [-1] * n_columns, [], list(range(n_columns))
        at, column, base = row, -1, 0.0
        while at >= 0:
            for j in open_:
                way = base + costs[at][j] - of_row[at] - of_column[j]
                if way < least[j]:
                    least[j], back[j] = way, column
            column = min(open_, key=least.__getitem__)
            open_.remove(column)
            done.append(column)
            base, at = least[column], row_of[column]
        of_row[row] += base
        for j in done:
            if row_of[j] >= 0:
                of_row[row_of[j]] += base - least[j]
            of_column[j] -= base - least[j]
        while column >= 0:
            row_of[column] = row_of[back[column]] if back[column] >= 0 else row
            column = back[column]
    return sorted((i, j) for j, i in enumerate(row_of) if i >= 0)


@dataclass
class Profile:
    hist: np.ndarray | None = None
    pos: tuple[float, float] | None = None
    last: int = -1
    missing: bool = True


def bhattacharyya_np(a: np.ndarray | None, b: np.ndarray | None) -> float | None:
    if a is None or b is None:
        return None
    norm = math.sqrt(float(a.sum()) * float(b.sum()))
    return math.sqrt(max(0.0, 1 - float(np.sqrt(a * b).sum()) / norm)) if norm > 0 else 1.0


def color_distances(profiles: list[np.ndarray | None], seen: list[np.ndarray | None]) -> list[list[float | None]]:
    """`bhattacharyya_np` of each profile and each detection, at once where all have histograms of one length."""
    every = [*profiles, *seen]
    if not profiles or not seen or any(h is None for h in every) or len({len(h) for h in every}) > 1:
        return [[bhattacharyya_np(a, b) for b in seen] for a in profiles]
    a, b = np.stack(profiles), np.stack(seen)
    norm = np.sqrt(a.sum(1)[:, None] * b.sum(1))
    some = norm > 0
    common = np.sqrt(a[:, None] * b).sum(2) / np.where(some, norm, 1.0)
    return np.where(some, np.sqrt(np.maximum(0.0, 1 - common)), 1.0).tolist()


@dataclass
class Identities:
    """State of a match: four profiles; `step` takes a frame's detections (x, y, histogram)."""

    cfg: IdentityConfig
    profiles: dict[int, Profile] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k in self.cfg.profiles:
            self.profiles.setdefault(k, Profile())

    def step(self, frame: int, detections: list[tuple[float | None, float | None, np.ndarray | None]]) -> list[tuple]:
        """(index, player, cost, distance, colour distance, re-entry) of the accepted pairs."""
        c, ids, out = self.cfg, list(self.profiles), []
        cost, parts = [[1e6] * len(detections) for _ in ids], {}
        colors = color_distances([self.profiles[k].hist for k in ids], [hist for _, _, hist in detections])
        for i, k in enumerate(ids):
            p = self.profiles[k]
            fresh = p.pos is not None and p.last >= 0 and frame - p.last <= c.position_ttl
            for j, (x, y, _) in enumerate(detections):
                d = math.hypot(x - p.pos[0], y - p.pos[1]) if fresh and x is not None else None
                color = colors[i][j]
                weight = (c.w_pos if d is not None else 0) + (c.w_color if color is not None else 0)
                if weight:
                    cost[i][j] = ((c.w_pos * min(1, d / c.diagonal_m) if d is not None else 0) + (c.w_color * color if color is not None else 0)) / weight
                parts[i, j] = (d, color)
        taken = set()
        for i, j in assign(np.array(cost)) if detections else []:
            if cost[i][j] >= c.threshold:
                continue
            k, p = ids[i], self.profiles[ids[i]]
            x, y, hist = detections[j]
            again = p.missing and p.last >= 0 and frame - p.last > 1
            p.pos = (x, y) if x is not None else p.pos
            p.last, p.missing = frame, False
            if c.ema > 0 and hist is not None:
                p.hist = hist if p.hist is None else (1 - c.ema) * p.hist + c.ema * hist
            taken.add(k)
            out.append((j, k, round(float(cost[i][j]), 4), *(None if z is None else round(z, 3) for z in parts[i, j]), again))
        for k in ids:
            if k not in taken:
                self.profiles[k].missing = True
        return out


def _with_profiles(detections: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles (keys, player_id, hist, x, y) as rows of frame -1 before the detections."""
    return detections.select(*keys, "frame", "det_idx", "x", "y", "hist").unionByName(profiles.select(*keys, F.lit(-1).alias("frame"), F.col("player_id").alias("det_idx"), "x", "y", "hist"))


def _identified(pdf: pd.DataFrame, cfg: IdentityConfig, state: list[Identities]) -> Iterable[tuple]:
    """Rows of `identify` for a match; its state is put into `state`."""
    array = lambda h: None if h is None else np.asarray(h, float)
    known = pdf[pdf["frame"] == -1]
    state.append(Identities(cfg, {int(r.det_idx): Profile(array(r.hist), None if none(r.x) is None else (r.x, r.y)) for r in known.itertuples(index=False)}))
    seen = pdf[pdf["frame"] >= 0]
    index = seen["det_idx"].tolist()
    rows = [(none(x), none(y), array(h)) for x, y, h in zip(seen["x"].tolist(), seen["y"].tolist(), seen["hist"].tolist(), strict=True)]
    for frame, first, last in stretches(seen["frame"]):
        for j, player, cost, d, color, again in state[0].step(frame, rows[first:last]):
            yield (frame, index[first + j], player, cost, d, color, again)


def identify(detections: DataFrame, profiles: DataFrame, keys: list[str], cfg: IdentityConfig = IdentityConfig()) -> DataFrame:
    """Give detections (keys, frame, det_idx, x, y, hist) to the profiles of their match (keys, player_id, hist, x, y).

    A profile without colour and place can't be matched. Places of earlier runs count as stale."""
    schema = "frame int, det_idx int, player_id int, cost double, pos_dist_m double, color_dist double, reentry boolean"
    return per_clip(_with_profiles(detections, profiles, keys), keys, ["frame", "det_idx"], lambda pdf: _identified(pdf, cfg, []), schema)


def identity_states(detections: DataFrame, profiles: DataFrame, keys: list[str], cfg: IdentityConfig = IdentityConfig()) -> DataFrame:
    """Profiles of each match after its last frame: (keys, player_id, hist, x, y, last_seen, state), as `identify` leaves them.
    They can be the profiles of a later run."""

    def fold(pdf: pd.DataFrame) -> Iterable[tuple]:
        state: list[Identities] = []
        for _ in _identified(pdf, cfg, state):
            pass
        for k, p in sorted(state[0].profiles.items()):
            yield (k, None if p.hist is None else p.hist.tolist(), *(p.pos or (None, None)), p.last, "missing" if p.missing else "active")

    return per_clip(_with_profiles(detections, profiles, keys), keys, ["frame", "det_idx"], fold, "player_id int, hist array<double>, x double, y double, last_seen int, state string")


def inside_region(boxes: DataFrame, polygon: Polygon) -> DataFrame:
    """Boxes whose centre lies in the region. Centres come out of a list of one: a filter on their formula would work it out again
    several times for each edge."""
    if len(polygon) < 3:
        return boxes
    x, y = box_center(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    centred = boxes.select("*", F.inline(F.array(F.struct(x.alias("_cx"), y.alias("_cy")))))
    return centred.where(in_polygon(polygon, F.col("_cx"), F.col("_cy"))).drop("_cx", "_cy")


def court_positions(detections: DataFrame, cam: str, homography: Matrix, polygon: Polygon = (), least_conf: float = 0.5, bounds_m: float = 2.0) -> DataFrame:
    """Where players stand: region, foot point, metres in the global frame, and whether on the court (within bounds)."""
    fx, fy, source = foot_point(F.col("keypoints"), F.col("x1"), F.col("x2"), F.col("y2"), least_conf)
    rows = inside_region(detections, polygon).withColumns({"foot_u": fx, "foot_v": fy, "foot_source": source})
    x, y = transform_point(homography, F.col("foot_u"), F.col("foot_v"))
    gx, gy = to_global(F.lit(cam), x, y)
    # out of a list of one: a filter on plain columns would move below them and work each place out dozens of times
    placed = rows.withColumn("_at", F.explode(F.array(F.struct(gx.alias("x"), gy.alias("y")))))
    own = [c for c in rows.columns if c not in ("cam", "x", "y", "bh", "inside")]
    placed = placed.select(*own, F.lit(cam).alias("cam"), "_at.x", "_at.y", (F.col("y2") - F.col("y1")).alias("bh"))
    return placed.withColumn("inside", in_court(F.col("x"), F.col("y"))).where(in_court(F.col("x"), F.col("y"), bounds_m))


def fuse(a: DataFrame, b: DataFrame, offset: int, keys: list[str], radius: float = 1.5) -> DataFrame:
    """Players of both cameras in one frame of reference, one row for each person: detections of A, then of B, in
    clusters. `a`, `b`: rows of `court_positions`."""
    name = ["cam", "frame", "det_idx", "x", "y", "bh"]
    both = a.select(*keys, *name, F.lit(0).alias("_s")).unionByName(b.select(*keys, "cam", (F.col("frame") - offset).cast("int").alias("frame"), "det_idx", "x", "y", "bh", F.lit(1).alias("_s")))
    both = both.withColumn("cand_idx", (F.col("_s") * 1000 + F.col("det_idx")).cast("int"))
    frames = a.select(*keys, "frame").distinct().join(b.select(*keys, (F.col("frame") - offset).cast("int").alias("frame")).distinct(), [*keys, "frame"])
    found = cluster(both.join(frames, [*keys, "frame"], "left_semi"), [*keys, "frame"], radius)
    return found.withColumn("cam", F.when(F.col("cand_idx") < 1000, "A").otherwise("B"))
