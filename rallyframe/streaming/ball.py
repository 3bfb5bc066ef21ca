"""Folds over clips on a stream, with the same steps as the batch form: the ball's track and events, parked blobs.

State per key: the fold's numbers. Rows of a micro-batch are sorted by frame; frames at or before the last one that a key
has taken come too late and are dropped, as state can't be unrolled."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Matrix
from ..operators.clips import stretches
from ..operators.tracking import TRACK, Blob, Events, Kalman, Suppressor, court_map
from ..schemas import EventConfig, SuppressConfig, TrackerConfig


def stateful(rows: DataFrame, key: str, order: str, schema: str, begin: Callable[[Any], Any], load: Callable[[Any, Any], None], dump: Callable[[Any], Any], step: Callable[[Any, int, pd.DataFrame], Iterable[tuple]], idle_ms: int | None) -> DataFrame:
    """Fold each key's frames over a micro-batch, with the state kept as JSON: `begin` makes it, `load` and `dump` turn it from
    and to plain values, `step` takes a frame's rows and gives rows of `schema` behind key and frame."""
    kind = dict(rows.dtypes)[key]
    names = [key, "frame", *(c.split()[0] for c in schema.split(", "))]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own, done, out = begin(k[0]), -1, []
        if state.exists:
            saved = json.loads(state.get[0])
            done = saved["done"]
            load(own, saved["own"])
        pdf = pd.concat(list(batches)).sort_values(["frame", order], kind="stable", ignore_index=True)
        for frame, first, last in stretches(pdf["frame"]):
            if frame > done:
                out += [(*k, frame, *row) for row in step(own, frame, pdf.iloc[first:last])]
                done = frame
        state.update((json.dumps({"done": done, "own": dump(own)}),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        table = pd.DataFrame(out, columns=names)
        yield table.astype(object).where(table.notna(), None)

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, frame int, {schema}", "saved string", "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def _found(pdf: pd.DataFrame) -> list[tuple[float, float, float]]:
    seen = pdf[pdf["u"].notna()]
    return list(zip(seen["u"].tolist(), seen["v"].tolist(), seen["confidence"].tolist(), strict=True))


def track_stream(candidates: DataFrame, homography: Matrix | None, tracker: TrackerConfig = TrackerConfig(), cfg: EventConfig = EventConfig(), idle_ms: int | None = 600_000) -> DataFrame:
    """TRACK rows with the frame's event. `candidates` is a stream of clip, frame, cand_idx, u, v, confidence; a clip's
    state is dropped when nothing has come for `idle_ms`."""

    def load(own: tuple[Kalman, Events], saved: dict) -> None:
        for part, values in zip(own, saved, strict=True):
            for name, value in values.items():
                setattr(part, name, tuple(value) if name == "velocity" else value)

    def dump(own: tuple[Kalman, Events]) -> list[dict]:
        return [{k: v for k, v in vars(part).items() if k not in ("cfg", "to_court")} for part in own]

    def step(own: tuple[Kalman, Events], frame: int, pdf: pd.DataFrame) -> Iterable[tuple]:
        row = own[0].step(_found(pdf))
        event = own[1].step(frame, row[1], row[2], row[3], row[4], row[6])
        yield (*row, *((event[1], *event[4:]) if event else (None,) * 4))

    schema = TRACK.removeprefix("frame int, ") + ", event_type string, x_m double, y_m double, in_court boolean"
    return stateful(candidates, "clip", "cand_idx", schema, lambda _: (Kalman(tracker), Events(cfg, court_map(homography))), load, dump, step, idle_ms)


def suppress_stream(candidates: DataFrame, cfg: SuppressConfig = SuppressConfig(), idle_ms: int | None = 600_000) -> DataFrame:
    """Candidates with `kept`, false near a parked blob: `tracking.suppress_parked` on a stream."""

    def load(own: Suppressor, saved: list[dict]) -> None:
        own.blobs = [Blob(**b) for b in saved]

    def step(own: Suppressor, frame: int, pdf: pd.DataFrame) -> Iterable[tuple]:
        found = _found(pdf)
        index = pdf.loc[pdf["u"].notna(), "cand_idx"].tolist()
        return [(int(i), *r, kept) for i, r, kept in zip(index, found, own.step(frame, found), strict=True)]

    return stateful(candidates, "clip", "cand_idx", "cand_idx int, u double, v double, confidence double, kept boolean", lambda _: Suppressor(cfg), load, lambda own: [vars(b) for b in own.blobs], step, idle_ms)


def detections_by_window(candidates: DataFrame, late: str = "10 seconds", window: str = "1 minute") -> DataFrame:
    """Candidates and clips by window of event time; rows later than the watermark are dropped. `ts` must be a timestamp."""
    return candidates.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("clip").alias("clips")).select("w.start", "w.end", "n", "clips")


