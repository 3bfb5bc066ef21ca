"""Identities of players on a stream, with typed state in the state store.

Of each match the store holds a map of its profiles (colour, last frame, whether missing), a map of their places, which expire
by themselves when a stream stands still, and the last frame taken. Saved profiles are the initial state of the first batch;
a snapshot of a running or stopped stream is read from its checkpoint and can be the profiles of a later one."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.clips import none, stretches
from ..operators.players import Identities, Profile
from ..schemas import IdentityConfig
from .state import typed_state

COLOURS = "hist array<double>, last int, missing boolean"
PLACES = "x double, y double"
FOUND = "frame int, det_idx int, player_id int, cost double, pos_dist_m double, color_dist double, reentry boolean"


def _array(values: Any) -> np.ndarray | None:
    return None if values is None else np.asarray(values, float)


class MatchState(StatefulProcessor):
    """`Identities` of a match. A match's state goes when nothing has come for `idle_ms`; a place goes `place_ms` after it was set."""

    def __init__(self, cfg: IdentityConfig, idle_ms: int | None, place_ms: int | None):
        self.cfg, self.idle_ms, self.place_ms = cfg, idle_ms, place_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profiles = handle.getMapState("profiles", "player_id int", COLOURS)
        self.places = handle.getMapState("places", "player_id int", PLACES, self.place_ms)
        self.done = handle.getValueState("done", "frame int, expires long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        for r in initialState.itertuples(index=False):
            hist = _array(r.hist)
            self.profiles.updateValue((int(r.player_id),), (None if hist is None else hist.tolist(), -1, True))
            if none(r.x) is not None:
                self.places.updateValue((int(r.player_id),), (float(r.x), float(r.y)))

    def _load(self) -> Identities:
        places = {k[0]: tuple(v) for k, v in self.places.iterator()}
        return Identities(self.cfg, {k[0]: Profile(_array(v[0]), places.get(k[0]), v[1], v[2]) for k, v in sorted(self.profiles.iterator())})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own, (done, expires) = self._load(), self.done.get() if self.done.exists() else (-1, None)
        pdf = pd.concat(list(rows)).sort_values(["frame", "det_idx"], kind="stable", ignore_index=True)
        index, out = pdf["det_idx"].tolist(), []
        values = [(none(x), none(y), _array(h)) for x, y, h in zip(pdf["x"].tolist(), pdf["y"].tolist(), pdf["hist"].tolist(), strict=True)]
        for frame, first, last in stretches(pdf["frame"]):
            if frame > done:
                out += [(key[0], frame, int(index[first + j]), *rest) for j, *rest in own.step(frame, values[first:last])]
                done = frame
        for k, p in own.profiles.items():
            self.profiles.updateValue((k,), (None if p.hist is None else p.hist.tolist(), p.last, p.missing))
            if p.pos is not None:
                self.places.updateValue((k,), (float(p.pos[0]), float(p.pos[1])))
        if self.idle_ms:
            if expires is not None:
                self.handle.deleteTimer(expires)
            expires = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(expires)
        self.done.update((done, expires))
        table = pd.DataFrame(out, columns=["match", *(c.split()[0] for c in FOUND.split(", "))])
        yield table.astype(object).where(table.notna(), None)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.profiles, self.places, self.done):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def identify_stream(detections: DataFrame, profiles: DataFrame, cfg: IdentityConfig = IdentityConfig(), idle_ms: int | None = 600_000, place_ms: int | None = 600_000) -> DataFrame:
    """`players.identify` on a stream of match, frame, det_idx, x, y, hist. `profiles`: match, player_id, hist, x, y of the enrolled
    players or of a snapshot, read once when the stream begins. Frames at or before a match's last one are dropped;
    `state.in_order` before this puts late ones in their place."""
    typed_state(detections.sparkSession)
    rows = detections.select("match", "frame", "det_idx", "x", "y", "hist")
    known = profiles.select("match", "player_id", "hist", "x", "y").groupBy("match")
    kind = dict(rows.dtypes)["match"]
    return rows.groupBy("match").transformWithStateInPandas(MatchState(cfg, idle_ms, place_ms), f"match {kind}, {FOUND}", "Append", "ProcessingTime", known)


def identity_snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Profiles in a stream's checkpoint after its last batch, as `players.identity_states` gives them: match, player_id, hist, x, y,
    last_seen, state."""
    typed_state(spark)
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).option("flattenCollectionTypes", "true").load()
    key = [F.col("key.match").alias("match"), F.col("user_map_key.player_id").alias("player_id")]
    colours = read("profiles").select(*key, F.col("user_map_value.hist").alias("hist"), F.col("user_map_value.last").alias("last_seen"), F.when(F.col("user_map_value.missing"), "missing").otherwise("active").alias("state"))
    places = read("places").select(*key, _unwrapped("x"), _unwrapped("y"))
    return colours.join(places, ["match", "player_id"], "left").select("match", "player_id", "hist", "x", "y", "last_seen", "state")


def _unwrapped(name: str):
    """A value with a time to live lies in a struct beside that time."""
    return F.col(f"user_map_value.value.{name}").alias(name)
