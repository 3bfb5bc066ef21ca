"""The batch folds of a clip as folds on a stream whose frames come in any order (`state.in_order`), with typed state: the ball's track
with its events, parked blobs, the smoothed flight with a fixed lag."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.geometry import Matrix
from ..operators.clips import none
from ..operators.physics import FLIGHT_ROW, FixedLag, Flight, FlightRow
from ..operators.tracking import TRACK, Blob, Events, Kalman, Suppressor, court_map
from ..schemas import EkfConfig, EventConfig, SuppressConfig, TrackerConfig
from .state import Fold, in_order


def found(pdf: pd.DataFrame) -> list[tuple[float, float, float]]:
    seen = pdf[pdf["u"].notna()]
    return list(zip(seen["u"].tolist(), seen["v"].tolist(), seen["confidence"].tolist(), strict=True))


def ball_fold(homography: Matrix | None, tracker: TrackerConfig = TrackerConfig(), cfg: EventConfig = EventConfig()) -> Fold:
    """`tracking.track` with the frame's event."""
    kept = "state array<double>, updates int, coast int, velocity array<double>, measured boolean, sign_y int, sign_x int, peak_down double, peak_side double, last int"

    def load(own: tuple[Kalman, Events], values: tuple) -> None:
        kalman, events = own
        kalman.state, kalman.updates, kalman.coast = None if values[0] is None else list(values[0]), values[1], values[2]
        events.velocity = tuple(values[3])
        events.measured, events.sign_y, events.sign_x, events.peak_down, events.peak_side, events.last = values[4:]

    def dump(own: tuple[Kalman, Events]) -> tuple:
        kalman, e = own
        return (kalman.state, kalman.updates, kalman.coast, [float(x) for x in e.velocity], bool(e.measured), e.sign_y, e.sign_x, float(e.peak_down), float(e.peak_side), e.last)

    def step(own: tuple[Kalman, Events], frame: int, pdf: pd.DataFrame) -> Iterable[tuple]:
        row = own[0].step(found(pdf))
        event = own[1].step(frame, row[1], row[2], row[3], row[4], row[6])
        yield (frame, *row, *((event[1], *event[4:]) if event else (None,) * 4))

    schema = TRACK.removeprefix("frame int, ") + ", event_type string, x_m double, y_m double, in_court boolean"
    return Fold(schema, kept, lambda _: (Kalman(tracker), Events(cfg, court_map(homography))), load, dump, step)


def parked_fold(cfg: SuppressConfig = SuppressConfig()) -> Fold:
    """`tracking.suppress_parked`."""

    def load(own: Suppressor, values: tuple) -> None:
        own.blobs = [Blob(u, v, last, first, streak, None if x is None else (x, y)) for u, v, last, first, streak, x, y in values[0]]

    def dump(own: Suppressor) -> tuple:
        return ([(float(b.u), float(b.v), b.last, b.first, b.streak, *(map(float, b.centre) if b.centre else (None, None))) for b in own.blobs],)

    def step(own: Suppressor, frame: int, pdf: pd.DataFrame) -> Iterable[tuple]:
        candidates = found(pdf)
        index = pdf.loc[pdf["u"].notna(), "cand_idx"].tolist()
        return [(frame, int(i), *r, kept) for i, r, kept in zip(index, candidates, own.step(frame, candidates), strict=True)]

    kept = "blobs array<struct<u: double, v: double, last: int, first: int, streak: int, x: double, y: double>>"
    return Fold("cand_idx int, u double, v double, confidence double, kept boolean", kept, lambda _: Suppressor(cfg), load, dump, step)


def flight_fold(camera: np.ndarray, homography: Matrix, fps: float, lag: int, cfg: EkfConfig = EkfConfig()) -> Fold:
    """`physics.fixed_lag`: each frame's place once some `lag` to twice `lag` more frames are known; the last ones when the clip ends."""
    names = [c.split()[0] for c in FLIGHT_ROW.split(", ")]
    row_type = FLIGHT_ROW.replace(" ", ": ").replace(",: ", ", ")

    def load(own: FixedLag, values: tuple) -> None:
        s, c, last, rows, seen = values
        own.flight.restore(s, c, last)
        own.rows, own.seen = [FlightRow(*r) for r in rows], [tuple(x) for x in seen]

    def dump(own: FixedLag) -> tuple:
        return (*own.flight.saved(), [tuple(r) for r in own.rows], [(int(f), float(v)) for f, v in own.seen])

    def step(own: FixedLag, frame: int, pdf: pd.DataFrame) -> Iterable[tuple]:
        for r in pdf[names].itertuples(index=False):
            yield from own.push(FlightRow(*(list(x) if isinstance(x, (list, tuple, np.ndarray)) else none(x) for x in r)))

    kept = f"s array<double>, c array<double>, last int, rows array<struct<{row_type}>>, seen array<struct<frame: int, v: double>>"
    return Fold("x double, y double, z double", kept, lambda _: FixedLag(Flight(cfg, camera, fps, court_map(homography)), lag), load, dump, step, lambda own: own.finish())


def track_in_order(candidates: DataFrame, homography: Matrix | None, tracker: TrackerConfig = TrackerConfig(), cfg: EventConfig = EventConfig(), late: str = "2 seconds", idle_ms: int = 600_000) -> DataFrame:
    """TRACK rows with the frame's event, of a stream of clip, frame, cand_idx, u, v, confidence, ts."""
    return in_order(candidates, "clip", "cand_idx", ball_fold(homography, tracker, cfg), late, idle_ms)


def suppress_in_order(candidates: DataFrame, cfg: SuppressConfig = SuppressConfig(), late: str = "2 seconds", idle_ms: int = 600_000) -> DataFrame:
    """Candidates with `kept`, false near a parked blob."""
    return in_order(candidates, "clip", "cand_idx", parked_fold(cfg), late, idle_ms)


def flight_in_order(log: DataFrame, camera: np.ndarray, homography: Matrix, fps: float, lag: int, cfg: EkfConfig = EkfConfig(), late: str = "2 seconds", idle_ms: int = 600_000) -> DataFrame:
    """clip, frame, x, y, z of a stream with the columns that `physics.trajectory` reads, and ts."""
    return in_order(log, "clip", "frame", flight_fold(camera, homography, fps, lag, cfg), late, idle_ms)
