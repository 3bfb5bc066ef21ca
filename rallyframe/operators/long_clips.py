"""The ball's filter on clips that are longer than a task's memory: parallel in time.

Without a gate and with one measurement a frame the filter is linear, so what a stretch of frames does to the state before it
is itself a small affine map with Gaussian noise, and such maps compose (filtering elements of the associative scan of
Särkkä and García-Fernández). Clips are cut in chunks of frames. Each chunk is composed to one element in a task of its own; along
a clip the elements, one row a chunk, give the state at each chunk's begin; then each chunk is filtered from there. A
track that is lost for too long begins anew, so a chunk also tells what it comes to by itself.

Smoothing goes the other way with the same cut: what a chunk does to the smoothed state after it is an affine map of four
numbers, those of all chunks give the smoothed state at each chunk's end, and each chunk is smoothed from there."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TrackerConfig
from .clips import many_clips, per_clip
from .tracking import TRACK, Kalman, _frames

#: Frames of a chunk.
CHUNK = 4096
Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # A, b, C, eta, J; b and eta have a column for each axis


def elements(measured: np.ndarray, noise: np.ndarray, cfg: TrackerConfig) -> Element:
    """Of single frames. `measured`: places (n, 2), NaN where there are none; `noise`: their variances."""
    n, dt, q = len(measured), cfg.dt, cfg.q
    f = np.array([[1.0, dt], [0.0, 1.0]])
    c = np.array([[q * dt**4 / 4, q * dt**3 / 2], [q * dt**3 / 2, q * dt**2]])
    there = ~np.isnan(measured[:, 0])
    s = np.where(there, c[0, 0] + np.where(there, noise, 1.0), np.inf)[:, None, None]
    y = np.where(there[:, None], measured, 0.0)[:, None, :]
    gain = c[:, :1] / s
    left = np.eye(2) - gain * np.array([[1.0, 0.0]])
    seen = f[:1]  # what is measured of the state before
    return left @ f, gain * y, left @ c, (seen.T / s) * y, np.broadcast_to(seen.T @ seen, (n, 2, 2)) / s


def compose(i: Element, j: Element) -> Element:
    """First i, then j; of single elements or of lists of them."""
    a, b, c, eta, info = i
    a2, b2, c2, eta2, info2 = j
    turn = lambda m: np.swapaxes(m, -1, -2)
    d, e = a2 @ np.linalg.inv(np.eye(2) + c @ info2), turn(a) @ np.linalg.inv(np.eye(2) + info2 @ c)
    return d @ a, d @ (b + c @ eta2) + b2, d @ c @ turn(a2) + c2, e @ (eta2 - info2 @ b) + eta, e @ info2 @ a + info


def composed(many: Element) -> Element:
    """All of a list, pair by pair."""
    while len(many[0]) > 1:
        odd = [x[-1:] for x in many] if len(many[0]) % 2 else None
        even = len(many[0]) // 2 * 2
        half = compose(tuple(x[:even:2] for x in many), tuple(x[1:even:2] for x in many))
        many = tuple(np.concatenate([x, o]) for x, o in zip(half, odd, strict=True)) if odd else half
    return tuple(x[0] for x in many)


def composed_by(many: Element, of: np.ndarray) -> Element:
    """`composed` for each stretch of equal numbers in `of` (0, 1, ...), all stretches together."""
    while len(of):
        first = np.searchsorted(of, of)
        even = (np.arange(len(of)) - first) % 2 == 0
        i = np.flatnonzero(even[:-1] & (of[:-1] == of[1:]))
        if not len(i):
            break
        half = compose(tuple(x[i] for x in many), tuple(x[i + 1] for x in many))
        many = tuple(x.copy() for x in many)
        for x, h in zip(many, half, strict=True):
            x[i] = h
        many, of = tuple(x[even] for x in many), of[even]
    return many


def carried(state: list[float], element: Element) -> list[float]:
    """The filter's state (x, y, vx, vy, p11, p12, p22) after an element."""
    x, y, vx, vy, p11, p12, p22 = state
    m, p = np.array([[x, y], [vx, vy]]), np.array([[p11, p12], [p12, p22]])
    a, b, c, eta, info = element
    d = a @ np.linalg.inv(np.eye(2) + p @ info)
    m, p = d @ (m + p @ eta) + b, d @ p @ a.T + c
    return [*m.ravel().tolist(), float(p[0, 0]), float(p[0, 1]), float(p[1, 1])]


def linear(cfg: TrackerConfig) -> TrackerConfig:
    """The filter without gate, which takes a frame's surest candidate wherever it is."""
    return replace(cfg, gate=0.0, associate_px=-1.0)


SUMMARY = "frames int, lead int, tail int, again boolean, element array<double>, state array<double>, coast int"


def _by_frame(pdf: pd.DataFrame, clip: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, float, float]]]]:
    """Of the frames of several chunks: chunk, number, candidates."""
    frame = pdf["frame"].to_numpy(np.int64)
    begin = np.flatnonzero((np.diff(clip, prepend=-1) != 0) | (np.diff(frame, prepend=0) != 0))
    rows = list(zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["confidence"].tolist(), strict=True))
    ends = [*begin[1:].tolist(), len(rows)]
    return clip[begin], frame[begin], [[r for r in rows[a:b] if r[0] is not None and r[0] == r[0]] for a, b in zip(begin.tolist(), ends, strict=True)]


def summaries(pdf: pd.DataFrame, clip: np.ndarray, cfg: TrackerConfig) -> Iterable[tuple[np.ndarray, pd.DataFrame]]:
    """A row of SUMMARY for each chunk: frames; those before the first measurement and after the last; whether the track is lost and
    begun anew in between; else the chunk's element; state and coast of a filter that begins with the chunk. The elements of all
    chunks are composed together."""
    of, _, candidates = _by_frame(pdf, clip)
    u = np.array([max(found, key=lambda k: k[2]) if found else (np.nan,) * 3 for found in candidates], float)
    edge = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    out, whole = [], np.zeros(len(edge) - 1, bool)
    for k, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        own = Kalman(cfg)
        for found in candidates[lo:hi]:
            own.step(found)
        there = np.flatnonzero(~np.isnan(u[lo:hi, 0]))
        n = hi - lo
        lead = int(there[0]) if len(there) else n
        tail = n - 1 - int(there[-1]) if len(there) else n
        again = bool(len(there) and max(int(np.diff(there).max(initial=1)) - 1, tail) > cfg.max_coast)
        whole[k] = not again and lead <= cfg.max_coast
        out.append([n, lead, tail, again, None, own.state, own.coast])
    some = np.flatnonzero(whole[of])
    if len(some):
        noise = cfg.r * cfg.conf_ref / np.maximum(u[some, 2], cfg.conf_floor)
        made = composed_by(elements(u[some, :2], noise, cfg), of[some])
        for k, element in zip(np.flatnonzero(whole).tolist(), np.concatenate([x.reshape(len(x), 4) for x in made], 1).tolist(), strict=True):
            out[k][4] = element
    yield np.arange(len(out)), pd.DataFrame(out, columns=[c.split()[0] for c in SUMMARY.split(", ")])


def after(state: list[float] | None, coast: int, row: tuple, cfg: TrackerConfig) -> tuple[list[float] | None, int]:
    """State and coast after a chunk, from those before it and the chunk's summary."""
    frames, lead, tail, again, element, own, own_coast = row
    survives = state is not None and coast + lead <= cfg.max_coast
    if survives and not again:
        parts = np.split(np.array(element), np.cumsum([4, 4, 4, 4]))
        return carried(state, tuple(p.reshape(2, 2) for p in parts)), coast + frames if lead == frames else tail
    return own, own_coast


def _begun(candidates: DataFrame, cfg: TrackerConfig, keys: list[str], chunk: int) -> DataFrame:
    """Candidates with their chunk and the filter's state before it (start, start_coast)."""
    rows = candidates.withColumn("chunk", F.floor(F.col("frame") / chunk).cast("long"))
    sums = many_clips(rows, [*keys, "chunk"], ["frame", "cand_idx"], lambda pdf, clip: summaries(pdf, clip, cfg), SUMMARY)

    def along(pdf: pd.DataFrame) -> Iterable[tuple]:
        state, coast = None, 0
        for part, row in zip(pdf["chunk"].tolist(), pdf[[c.split()[0] for c in SUMMARY.split(", ")]].itertuples(index=False, name=None), strict=True):
            yield (part, state, coast)
            state, coast = after(state, coast, (*row[:5], None if row[5] is None else list(row[5]), row[6]), cfg)

    starts = per_clip(sums, keys, ["chunk"], along, "chunk long, start array<double>, start_coast int")
    return rows.join(starts, [*keys, "chunk"])


def _filter_of(pdf: pd.DataFrame, cfg: TrackerConfig) -> Kalman:
    kalman, start = Kalman(cfg), pdf["start"].iloc[0]
    if start is not None:
        kalman.state, kalman.coast = list(start), int(pdf["start_coast"].iloc[0])
    return kalman


def track_long(candidates: DataFrame, cfg: TrackerConfig = TrackerConfig(), keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """`tracking.track` without gate, each frame's surest candidate taken, for clips of any length: a task sees a chunk of frames, or
    one row for each chunk of a clip. A frame without candidates is a row with null u, as there."""
    keys, cfg = keys or ["clip"], linear(cfg)

    def fold(pdf: pd.DataFrame) -> Iterable[tuple]:
        kalman = _filter_of(pdf, cfg)
        for frame, found in _frames(pdf):
            yield (frame, *kalman.step(found))

    return per_clip(_begun(candidates, cfg, keys, chunk), [*keys, "chunk"], ["frame", "cand_idx"], fold, TRACK).drop("chunk")


def back_gains(states: np.ndarray, cfg: TrackerConfig) -> np.ndarray:
    """How much of the correction of the next frame's state comes back to each of these (n, 2, 2), for either axis."""
    dt, q = cfg.dt, cfg.q
    p, f = states[:, [4, 5, 5, 6]].reshape(-1, 2, 2), np.array([[1.0, dt], [0.0, 1.0]])
    ahead = f @ p @ f.T + np.array([[q * dt**4 / 4, q * dt**3 / 2], [q * dt**3 / 2, q * dt**2]])
    return p @ f.T @ np.linalg.inv(ahead)


class Backwards:
    """Filtered states of the frames of several chunks, and the maps from the smoothed state of the frame after each to its own; all
    chunks are gone through together, from their ends."""

    def __init__(self, pdf: pd.DataFrame, clip: np.ndarray, cfg: TrackerConfig):
        self.of, self.frames, candidates = _by_frame(pdf, clip)
        self.edge = np.flatnonzero(np.diff(self.of, prepend=-1, append=-1))
        self.first, self.length = self.edge[:-1], np.diff(self.edge)
        n = len(self.frames)
        states, self.there, self.chained = np.zeros((n, 7)), np.zeros(n, bool), np.zeros(n, bool)  # chained: to the frame before
        begin = np.searchsorted(clip, np.arange(len(self.first)))
        starts, coasts = pdf["start"].to_numpy(), pdf["start_coast"].to_numpy()
        for row, lo, hi in zip(begin.tolist(), self.first.tolist(), self.edge[1:].tolist(), strict=True):
            kalman = Kalman(cfg)
            if starts[row] is not None:
                kalman.state, kalman.coast = list(starts[row]), int(coasts[row])
            was = kalman.state
            for i in range(lo, hi):
                kalman.step(candidates[i])
                self.chained[i] = was is not None and kalman.state is not None
                was = kalman.state
                if was is not None:
                    states[i], self.there[i] = was, True
        self.alone = states[:, :4].reshape(n, 2, 2)
        self.e, self.g = np.zeros((n, 2, 2)), np.zeros((n, 2, 2))
        some, f = np.flatnonzero(self.there), np.array([[1.0, cfg.dt], [0.0, 1.0]])
        self.e[some] = back_gains(states[some], cfg)
        self.g[some] = self.alone[some] - self.e[some] @ (f @ self.alone[some])

    def _steps(self) -> Iterable[tuple[np.ndarray, np.ndarray]]:
        """Chunks that have a frame left, and these frames, from the last to the first."""
        for k in range(int(self.length.max(initial=0)) - 1, -1, -1):
            at = np.flatnonzero(self.length > k)
            yield at, self.first[at] + k

    def smoothed(self, after_: np.ndarray, has: np.ndarray) -> np.ndarray:
        """Smoothed states (2 x 2: place and speed by axis) of the frames that are `there`, from the smoothed states of the frames after
        the chunks; `has`: whether there is one that is chained."""
        out, now, has = np.zeros(self.e.shape), after_.copy(), has.copy()
        for at, i in self._steps():
            out[i] = np.where(has[at, None, None], self.e[i] @ now[at] + self.g[i], self.alone[i])
            now[at], has[at] = out[i], self.chained[i]
        return out

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk: whether a smoothed state after it reaches its first frame; whether the first frame goes on with the track before;
        the first frame's smoothed state as map of the state after: (E, g)."""
        e, g = np.broadcast_to(np.eye(2), (len(self.first), 2, 2)).copy(), np.zeros((len(self.first), 2, 2))
        for at, i in self._steps():
            e[at], g[at] = self.e[i] @ e[at], self.e[i] @ g[at] + self.g[i]
        links = self.chained.copy()
        links[self.first] = True
        through = np.logical_and.reduceat(self.there & links, self.first)
        e[~through], g[~through] = 0.0, 0.0
        return through, self.chained[self.first], e, g


MAPS = "through boolean, goes_on boolean, e array<double>, g array<double>, first array<double>"


def smooth_long(candidates: DataFrame, cfg: TrackerConfig = TrackerConfig(), keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(keys, frame, x, y, vx, vy): the track of `track_long` smoothed backwards, for frames with a track. A track that is lost and begun
    anew is smoothed apart."""
    keys, cfg = keys or ["clip"], linear(cfg)
    begun = _begun(candidates, cfg, keys, chunk)

    def told(pdf: pd.DataFrame, clip: np.ndarray) -> Iterable[tuple[np.ndarray, pd.DataFrame]]:
        part = Backwards(pdf, clip, cfg)
        through, goes_on, e, g = part.whole()
        n = len(through)
        first = part.smoothed(np.zeros((n, 2, 2)), np.zeros(n, bool))[part.first]
        flat = lambda m: m.reshape(n, 4).tolist()
        begun_ = [x if there else None for x, there in zip(flat(first), part.there[part.first].tolist(), strict=True)]
        yield np.arange(n), pd.DataFrame({"through": through, "goes_on": goes_on, "e": flat(e), "g": flat(g), "first": pd.Series(begun_, dtype=object)})

    def along(pdf: pd.DataFrame) -> Iterable[tuple]:
        """From the last chunk to the first: the smoothed state of the frame after each, if its last frame is chained to it."""
        later: np.ndarray | None = None
        square = lambda x: np.array(x, float).reshape(2, 2)
        for r in reversed(list(pdf.itertuples(index=False))):
            yield (r.chunk, None if later is None else later.ravel().tolist())
            if r.through and later is not None:
                own = square(r.e) @ later + square(r.g)
            else:
                own = None if r.first is None else square(r.first)
            later = own if r.goes_on else None

    ends = per_clip(many_clips(begun, [*keys, "chunk"], ["frame", "cand_idx"], told, MAPS), keys, ["chunk"], along, "chunk long, later array<double>")

    def fold(pdf: pd.DataFrame, clip: np.ndarray) -> Iterable[tuple[np.ndarray, pd.DataFrame]]:
        part = Backwards(pdf, clip, cfg)
        later = pdf["later"].to_numpy()[np.searchsorted(clip, np.arange(len(part.first)))]
        has = np.array([x is not None for x in later], bool)
        s = part.smoothed(np.array([np.zeros(4) if x is None else x for x in later], float).reshape(-1, 2, 2), has)
        on = np.flatnonzero(part.there)
        yield part.of[on], pd.DataFrame({"frame": part.frames[on].astype(np.int32), "x": s[on, 0, 0], "y": s[on, 0, 1], "vx": s[on, 1, 0], "vy": s[on, 1, 1]})

    return many_clips(begun.join(ends, [*keys, "chunk"]), [*keys, "chunk"], ["frame", "cand_idx"], fold, "frame int, x double, y double, vx double, vy double").drop("chunk")
