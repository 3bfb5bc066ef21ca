"""The ball in space: an extended Kalman filter under gravity over a clip, smoothed backwards; low points of the track."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.geometry import Matrix
from ..schemas import GRAVITY, EkfConfig
from .clips import many_clips, none, per_clip
from .tracking import court_map


def peaks(values: np.ndarray, prominence: float, distance: int) -> np.ndarray:
    """Places of local maxima: the middle of a plateau; of those nearer than `distance` the highest stay; then those
    that stand out by `prominence` over the higher of the two lowest points toward higher ground."""
    found, i, n = [], 1, len(values)
    while i < n - 1:
        j = i
        while j + 1 < n and values[j + 1] == values[i]:
            j += 1
        if values[i] > values[i - 1] and j < n - 1 and values[j + 1] < values[i]:
            found.append((i + j) // 2)
        i = j + 1
    keep = [True] * len(found)
    for i in sorted(range(len(found)), key=lambda i: (values[found[i]], i), reverse=True):
        if keep[i]:
            for step in (-1, 1):
                k = i + step
                while 0 <= k < len(found) and abs(found[k] - found[i]) < distance:
                    keep[k], k = False, k + step
    out = []
    for p in (q for q, stays in zip(found, keep, strict=True) if stays):
        bases = []
        for step in (-1, 1):
            low, k = values[p], p + step
            while 0 <= k < n and values[k] <= values[p]:
                low, k = min(low, values[k]), k + step
            bases.append(low)
        if values[p] - max(bases) >= prominence:
            out.append(p)
    return np.array(out, int)


def cusps(points: DataFrame, keys: list[str], prominence: float = 80.0, distance: int = 5) -> DataFrame:
    """Frames where the image track is lowest (v largest) for a while, among points that have a v."""

    def fold(pdf: pd.DataFrame) -> Iterable[tuple]:
        seen = pdf[pdf["v"].notna()]
        for i in peaks(seen["v"].to_numpy(float), prominence, distance):
            yield (int(seen["frame"].iloc[i]),)

    return per_clip(points, keys, ["frame"], fold, "frame int")


#: Variances (square metres) of a floor contact's place, and of the pull back between floor and ceiling.
ANCHOR_VARIANCE = np.array([0.05, 0.05, 0.02])
CLAMP_VARIANCE = 0.05
_AXES = np.eye(3, 6)


class Ekf:
    """Position and velocity; gravity is known. Measurements have independent noise, so each of their numbers is a
    correction of its own and nothing is inverted."""

    def __init__(self, cfg: EkfConfig, p: np.ndarray, dt: float, at: list[float]):
        self.cfg, self.p = cfg, p
        self.s, self.c = np.array([*at, 0.0, 0.0, 0.0]), np.diag(cfg.p0)
        self.f = np.eye(6)
        self.f[:3, 3:] = dt * np.eye(3)
        self.fall = np.array([0.0, 0.0, -0.5 * GRAVITY * dt**2, 0.0, 0.0, -GRAVITY * dt])
        self.q = np.diag([cfg.q_pos, cfg.q_pos, cfg.q_pos_z, cfg.q_vel, cfg.q_vel, cfg.q_vel_z])

    def predict(self) -> None:
        self.s = self.f @ self.s + self.fall
        self.c = self.f @ self.c @ self.f.T + self.q

    def update(self, rows: list[tuple[np.ndarray, float, float]]) -> None:
        """(direction, innovation at the state before all of them, variance) of each number."""
        before = self.s
        for h, innovation, variance in rows:
            ch = self.c @ h
            gain = ch / (h @ ch + variance)
            self.s = self.s + gain * (innovation - h @ (self.s - before))
            self.c = self.c - gain[:, None] * ch

    def see_2d(self, u: float, v: float, confidence: float) -> None:
        x, y, w = self.p[:, :3] @ self.s[:3] + self.p[:, 3]
        if not w or not np.isfinite([x, y, w]).all():
            return
        variance = self.cfg.meas_px**2 / max(confidence, 0.05)
        slope = np.zeros((2, 6))
        slope[0, :3], slope[1, :3] = (self.p[0, :3] - x / w * self.p[2, :3]) / w, (self.p[1, :3] - y / w * self.p[2, :3]) / w
        self.update([(slope[0], u - x / w, variance), (slope[1], v - y / w, variance)])

    def see_place(self, xyz: np.ndarray, variance: np.ndarray) -> None:
        self.update([(_AXES[i], xyz[i] - self.s[i], variance[i]) for i in range(3)])

    def see_3d(self, xyz: np.ndarray, std: np.ndarray) -> None:
        self.see_place(xyz, np.maximum(std, 0.05) ** 2)

    def anchor(self, x: float, y: float) -> None:
        self.see_place(np.array([x, y, 0.0]), ANCHOR_VARIANCE)

    def flip(self) -> None:
        self.s[5] = abs(self.cfg.restitution * self.s[5])

    def clamp(self) -> None:
        z = min(max(self.s[2], 0.0), self.cfg.z_max)
        if z != self.s[2]:
            self.update([(_AXES[2], z - self.s[2], CLAMP_VARIANCE)])


def smooth(forward: list[dict], f: np.ndarray, z_max: float) -> list[np.ndarray]:
    """Backwards over a clip; the chain breaks where the next row is a bounce. z ends within [0, z_max]. The gains of all
    rows are worked out together."""
    states = [r["post"].copy() for r in forward]
    if len(forward) > 1:
        post, prior = np.stack([r["post_c"] for r in forward[:-1]]), np.stack([r["prior_c"] for r in forward[1:]])
        breaks = np.array([r["break"] for r in forward[1:]])
        breaks |= ~np.isfinite(prior).all((1, 2)) | (np.linalg.det(prior) == 0)
        prior[breaks] = np.eye(6)
        gains = post @ f.T @ np.linalg.inv(prior)
        for k in np.flatnonzero(~breaks)[::-1]:
            states[k] = states[k] + gains[k] @ (states[k + 1] - forward[k + 1]["prior"])
    for s in states:
        s[2] = min(max(s[2], 0.0), z_max)
    return states


FLIGHT_ROW = "frame int, measured boolean, u double, v double, confidence double, track_x double, track_y double, x3 double, y3 double, z3 double, std3 array<double>, event_type string, event_x double, event_y double"


class FlightRow(NamedTuple):
    """A frame of the log, with null for what is missing."""

    frame: int
    measured: bool | None
    u: float | None
    v: float | None
    confidence: float | None
    track_x: float | None
    track_y: float | None
    x3: float | None
    y3: float | None
    z3: float | None
    std3: list[float] | None
    event_type: str | None
    event_x: float | None
    event_y: float | None


class Flight:
    """The filter on its way through a clip."""

    def __init__(self, cfg: EkfConfig, camera: np.ndarray, fps: float, to_court: Callable[[float, float], tuple[float, float]]):
        self.cfg, self.camera, self.fps, self.to_court = cfg, camera, fps, to_court
        self.ekf: Ekf | None = None
        self.last = -1

    def saved(self) -> tuple[list[float] | None, list[float] | None, int]:
        return (None, None, self.last) if self.ekf is None else (self.ekf.s.tolist(), self.ekf.c.ravel().tolist(), self.last)

    def restore(self, s: Iterable[float] | None, c: Iterable[float] | None, last: int) -> None:
        self.last, self.ekf = last, None
        if s is not None:
            self.ekf = Ekf(self.cfg, self.camera, 1 / self.fps, [0.0] * 3)
            self.ekf.s, self.ekf.c = np.array(s, float), np.array(c, float).reshape(6, 6)

    def step(self, r: FlightRow, low: bool) -> list[dict]:
        """States of the frames up to the row's; `low`: the image track is lowest there."""
        measured, has_3d = bool(r.measured) and r.u is not None, r.x3 is not None
        if self.ekf is None:
            if not (has_3d or measured):
                return []
            self.ekf = Ekf(self.cfg, self.camera, 1 / self.fps, [r.x3, r.y3, r.z3] if has_3d else [*self.to_court(r.u, r.v), 0.0])
            self.last = r.frame
            return [self._state(r.frame, self.ekf.s.copy(), self.ekf.c.copy(), False)]
        out, ekf = [], self.ekf
        for frame in range(self.last + 1, r.frame + 1):
            ekf.predict()
            prior, prior_c, broke = ekf.s.copy(), ekf.c.copy(), False
            if frame == r.frame:
                if measured:
                    ekf.see_2d(r.u, r.v, r.confidence or 0.05)
                if has_3d:
                    ekf.see_3d(np.array([r.x3, r.y3, r.z3]), np.array(r.std3 if r.std3 is not None else [0.3] * 3, float))
                if r.event_type == "floor_bounce":
                    if r.event_x is not None:
                        ekf.anchor(r.event_x, r.event_y)
                    ekf.flip()
                    broke = True
                elif low and ekf.s[2] < self.cfg.bounce_z:
                    if r.track_x is not None:
                        ekf.anchor(*self.to_court(r.track_x, r.track_y))
                    ekf.flip()
                    broke = True
            ekf.clamp()
            out.append(self._state(frame, prior, prior_c, broke))
        self.last = r.frame
        return out

    def _state(self, frame: int, prior: np.ndarray, prior_c: np.ndarray, broke: bool) -> dict:
        return {"frame": frame, "prior": prior, "prior_c": prior_c, "post": self.ekf.s.copy(), "post_c": self.ekf.c.copy(), "break": broke}


def lowest(frames: list[int], v: list[float]) -> set[int]:
    """Frames where the image track is lowest for a while."""
    return {frames[i] for i in peaks(np.array(v, float), 80.0, 5)} if len(v) > 2 else set()


class FixedLag:
    """Filter and smoother over a window of the last frames. A frame's place is given out once `lag` more frames are known; the window is
    worked through when it holds twice as many, so that each row is filtered twice. Low points are looked for among the window's
    rows and those measured before it, as far back as four lags.

    With a lag as long as the clip all is worked through at the end, as in `trajectory`."""

    def __init__(self, flight: Flight, lag: int):
        self.flight, self.lag = flight, lag
        self.rows: list[FlightRow] = []
        self.seen: list[tuple[int, float]] = []  # measured rows before the window

    def push(self, row: FlightRow) -> list[tuple[int, float, float, float]]:
        self.rows.append(row)
        return self._run(row.frame - self.lag) if row.frame - self.rows[0].frame >= 2 * self.lag else []

    def finish(self) -> list[tuple[int, float, float, float]]:
        return self._run(None)

    def _run(self, upto: int | None) -> list[tuple[int, float, float, float]]:
        marks = [(r.frame, r.v) for r in self.rows if r.measured and r.v is not None]
        low = lowest(*map(list, zip(*(self.seen + marks), strict=True))) if self.seen or marks else set()
        forward = [state for r in self.rows for state in self.flight.step(r, r.frame in low)]
        smoothed = smooth(forward, self.flight.ekf.f, self.flight.cfg.z_max) if forward else []
        given = [k for k, state in enumerate(forward) if upto is None or state["frame"] <= upto]
        if upto is not None:
            self.rows = [r for r in self.rows if r.frame > upto]
            self.seen = [m for m in self.seen + marks if upto - 4 * self.lag < m[0] <= upto]
            if given:
                last = forward[given[-1]]
                self.flight.restore(last["post"], last["post_c"].ravel(), last["frame"])
            elif forward:
                self.flight.restore(None, None, -1)
        else:
            self.rows = []
        return [(forward[k]["frame"], *map(float, smoothed[k][:3])) for k in given]


def flight_rows(pdf: pd.DataFrame) -> list[FlightRow]:
    columns = [pdf[name].tolist() for name in FlightRow._fields]
    return [FlightRow(int(r[0]), *(x if isinstance(x, (list, np.ndarray)) else none(x) for x in r[1:])) for r in zip(*columns, strict=True)]


class Flights:
    """Many clips' filters and smoothers, stepped together: `Flight` on arrays of clips. Each clip has a row of cells, one for each frame
    from its first with a place to its last; cells without a row are predicted through."""

    def __init__(self, cfg: EkfConfig, camera: np.ndarray, homography: Matrix, fps: float):
        self.cfg, self.p, self.h = cfg, camera, np.array(homography, float).reshape(3, 3)
        self.f = np.eye(6)
        self.f[:3, 3:] = np.eye(3) / fps
        dt = 1 / fps
        self.fall = np.array([0.0, 0.0, -0.5 * GRAVITY * dt**2, 0.0, 0.0, -GRAVITY * dt])
        self.q = np.diag([cfg.q_pos, cfg.q_pos, cfg.q_pos_z, cfg.q_vel, cfg.q_vel, cfg.q_vel_z])

    def on_floor(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Metres (n, 3) of pixels; the origin of the plane where a pixel has no place on it."""
        x, y, w = self.h @ np.stack([u, v, np.ones(len(u))])
        scale = np.where(w != 0, 1 / np.where(w != 0, w, 1), 0.0)
        return np.stack([x * scale, y * scale, np.zeros(len(u))], 1)

    def _update(self, at: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Of the clips `at`: (directions, innovations at the states before all of them, variances) of each number."""
        s, c = self.s[at], self.c[at]
        before = s
        for h, innovation, variance in rows:
            ch = np.einsum("nij,nj->ni", c, h)
            gain = ch / (np.einsum("ni,ni->n", h, ch) + variance)[:, None]
            s = s + gain * (innovation - np.einsum("ni,ni->n", h, s - before))[:, None]
            c = c - gain[:, :, None] * ch[:, None, :]
        self.s[at], self.c[at] = s, c

    def _see_place(self, at: np.ndarray, xyz: np.ndarray, variance: np.ndarray) -> None:
        s = self.s[at]
        self._update(at, [(np.broadcast_to(_AXES[i], (len(at), 6)), xyz[:, i] - s[:, i], variance[:, i]) for i in range(3)])

    def _see_2d(self, at: np.ndarray, u: np.ndarray, v: np.ndarray, confidence: np.ndarray) -> None:
        x, y, w = self.p[:, :3] @ self.s[at, :3].T + self.p[:, 3:]
        good = (w != 0) & np.isfinite(x) & np.isfinite(y) & np.isfinite(w)
        at, u, v, x, y, w, confidence = (a[good] for a in (at, u, v, x, y, w, confidence))
        variance = self.cfg.meas_px**2 / np.maximum(confidence, 0.05)
        slope = np.zeros((2, len(at), 6))
        slope[0, :, :3] = (self.p[0, :3] - (x / w)[:, None] * self.p[2, :3]) / w[:, None]
        slope[1, :, :3] = (self.p[1, :3] - (y / w)[:, None] * self.p[2, :3]) / w[:, None]
        self._update(at, [(slope[0], u - x / w, variance), (slope[1], v - y / w, variance)])

    def run(self, length: np.ndarray, cells: dict[str, np.ndarray]) -> np.ndarray:
        """Smoothed places (clips, frames, 3). `cells`: arrays (clips, frames) of what is seen; the first cell of each has a place."""
        n, most = cells["u"].shape
        has_3d, measured = ~np.isnan(cells["x3"]), cells["measured"]
        self.s, self.c = np.zeros((n, 6)), np.broadcast_to(np.diag(self.cfg.p0), (n, 6, 6)).copy()
        place = np.stack([cells[k] for k in ("x3", "y3", "z3")], 2)
        self.s[:, :3] = np.where(has_3d[:, 0, None], place[:, 0], self.on_floor(cells["u"][:, 0], cells["v"][:, 0]))
        prior, prior_c, post, post_c = (np.zeros((n, most, *shape)) for shape in ((6,), (6, 6), (6,), (6, 6)))
        broke = np.zeros((n, most), bool)
        for t in range(most):
            on = length > t
            if t:
                self.s = np.where(on[:, None], self.s @ self.f.T + self.fall, self.s)
                self.c = np.where(on[:, None, None], self.f @ self.c @ self.f.T + self.q, self.c)
            prior[:, t], prior_c[:, t] = self.s, self.c
            if t:
                cell = lambda name, at, t=t: cells[name][at, t]
                at = np.flatnonzero(on & measured[:, t])
                if len(at):
                    self._see_2d(at, cell("u", at), cell("v", at), cell("confidence", at))
                at = np.flatnonzero(on & has_3d[:, t])
                if len(at):
                    self._see_place(at, place[at, t], np.maximum(cells["std3"][at, t], 0.05) ** 2)
                bounce = on & cells["bounce"][:, t]
                low = on & ~bounce & cells["low"][:, t] & (self.s[:, 2] < self.cfg.bounce_z)
                at = np.flatnonzero(bounce & ~np.isnan(cells["event_x"][:, t]))
                if len(at):
                    self._see_place(at, np.stack([cell("event_x", at), cell("event_y", at), np.zeros(len(at))], 1), np.broadcast_to(ANCHOR_VARIANCE, (len(at), 3)))
                at = np.flatnonzero(low & ~np.isnan(cells["track_x"][:, t]))
                if len(at):
                    self._see_place(at, self.on_floor(cell("track_x", at), cell("track_y", at)), np.broadcast_to(ANCHOR_VARIANCE, (len(at), 3)))
                broke[:, t] = bounce | low
                self.s[broke[:, t], 5] = np.abs(self.cfg.restitution * self.s[broke[:, t], 5])
                z = np.clip(self.s[:, 2], 0.0, self.cfg.z_max)
                at = np.flatnonzero(on & (z != self.s[:, 2]))
                if len(at):
                    self._update(at, [(np.broadcast_to(_AXES[2], (len(at), 6)), z[at] - self.s[at, 2], np.full(len(at), CLAMP_VARIANCE))])
            post[:, t], post_c[:, t] = self.s, self.c
        for t in range(most - 2, -1, -1):  # gains frame by frame: those of all frames would take more than the states do
            later = prior_c[:, t + 1]
            chained = (length > t + 1) & ~broke[:, t + 1] & np.isfinite(later).all((1, 2))
            later = np.where(chained[:, None, None], later, np.eye(6))
            chained &= np.linalg.det(later) != 0
            later = np.where(chained[:, None, None], later, np.eye(6))
            gains = post_c[:, t] @ self.f.T @ np.linalg.inv(later)
            moved = post[:, t] + np.einsum("nij,nj->ni", gains, post[:, t + 1] - prior[:, t + 1])
            post[:, t] = np.where(chained[:, None], moved, post[:, t])
        post[:, :, 2] = np.clip(post[:, :, 2], 0.0, self.cfg.z_max)
        return post[:, :, :3]


#: Cells of clips that are stepped together at most (a cell takes about 700 bytes).
CELLS = 100_000


def in_cells(pdf: pd.DataFrame, clip: np.ndarray, most: int = CELLS) -> Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Clips of about one length at a time: their numbers, first frames, lengths, and the cells for `Flights.run`."""
    number = lambda name: pd.to_numeric(pdf[name]).to_numpy(float)
    frame = pdf["frame"].to_numpy(np.int64)
    u, x3, confidence = number("u"), number("x3"), number("confidence")
    measured = pdf["measured"].fillna(False).to_numpy(bool) & ~np.isnan(u)
    begun = np.flatnonzero(measured | ~np.isnan(x3))
    some, first = np.unique(clip[begun], return_index=True)
    if not len(some):
        return
    start = np.full(clip.max() + 1, np.iinfo(np.int64).max)
    start[some] = frame[begun[first]]
    place = frame - start[clip]
    length = np.zeros(len(start), np.int64)
    np.maximum.at(length, clip[place >= 0], place[place >= 0] + 1)
    std = np.full((len(pdf), 3), 0.3)
    for k in np.flatnonzero(~np.isnan(x3) & pdf["std3"].notna().to_numpy()).tolist():
        std[k] = pdf["std3"].iat[k]
    low = np.zeros(len(pdf), bool)
    v = number("v")
    seen = np.flatnonzero(measured & ~np.isnan(v))
    for part in np.split(seen, np.flatnonzero(np.diff(clip[seen])) + 1) if len(seen) else []:
        if len(part) > 2:
            low[part[peaks(v[part], 80.0, 5)]] = True
    values = {name: number(name) for name in ("v", "y3", "z3", "track_x", "track_y", "event_x", "event_y")} | {"u": u, "x3": x3}
    values["confidence"] = np.where(np.isnan(confidence) | (confidence == 0), 0.05, confidence)
    flags = {"measured": measured, "low": low, "bounce": (pdf["event_type"] == "floor_bounce").to_numpy()}
    order = some[np.argsort(length[some], kind="stable")]
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and length[order[end]] * (end + 1 - begin) <= most:
            end += 1
        which = np.sort(order[begin:end])
        at = np.full(len(start), -1)
        at[which] = np.arange(len(which))
        rows = np.flatnonzero((at[clip] >= 0) & (place >= 0))
        shape = (len(which), int(length[which].max()))
        cells: dict[str, np.ndarray] = {}
        for name, column in (values | flags).items():
            cells[name] = np.full(shape, False if column.dtype == bool else np.nan)
            cells[name][at[clip[rows]], place[rows]] = column[rows]
        cells["std3"] = np.full((*shape, 3), 0.3)
        cells["std3"][at[clip[rows]], place[rows]] = std[rows]
        yield which, start[which], length[which], cells
        begin = end


def trajectory(log: DataFrame, camera: np.ndarray, homography: Matrix, fps: float, keys: list[str], cfg: EkfConfig = EkfConfig(), most_cells: int = CELLS) -> DataFrame:
    """(keys, frame, x, y, z) of each clip by filter and smoother; a task steps its clips together.

    `log`: keys, frame, measured, u, v, confidence, track_x, track_y, x3, y3, z3, std3 (array, null where nothing is
    triangulated), event_type, event_x, event_y; a row a frame. Missing frames are filled in by prediction."""

    def fold(pdf: pd.DataFrame, clip: np.ndarray) -> Iterable[tuple[np.ndarray, pd.DataFrame]]:
        for which, start, length, cells in in_cells(pdf, clip, most_cells):
            path = Flights(cfg, camera, homography, fps).run(length, cells)
            row, t = np.nonzero(np.arange(path.shape[1]) < length[:, None])
            out = path[row, t]
            yield which[row], pd.DataFrame({"frame": (start[row] + t).astype(np.int32), "x": out[:, 0], "y": out[:, 1], "z": out[:, 2]})

    return many_clips(log.select(*keys, *FlightRow._fields), keys, ["frame"], fold, "frame int, x double, y double, z double", most_cells)


def fixed_lag(log: DataFrame, camera: np.ndarray, homography: Matrix, fps: float, keys: list[str], lag: int, cfg: EkfConfig = EkfConfig()) -> DataFrame:
    """`trajectory` with a smoother that looks `lag` to 2 * `lag` frames ahead only: what a stream gives."""
    to_court = court_map(homography)

    def fold(pdf: pd.DataFrame) -> Iterable[tuple]:
        window = FixedLag(Flight(cfg, camera, fps, to_court), lag)
        for r in flight_rows(pdf):
            yield from window.push(r)
        yield from window.finish()

    return per_clip(log, keys, ["frame"], fold, "frame int, x double, y double, z double")
