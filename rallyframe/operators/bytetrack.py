"""Player tracks by the published two-round method: a Kalman filter of the box for each track, sure boxes linked before unsure ones,
new tracks confirmed by a second sighting, lost ones kept for a while, duplicates removed.

A box is centre, aspect (width over height) and height; each of the four has a velocity. All noise is per number, so a
filter is four of two numbers each, and those of all tracks of a task's clips are stepped together as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clips import picked_rows
from .players import assign


@dataclass(frozen=True)
class ByteConfig:
    """Fixed by the method: `position` and `velocity` (noise over height), `aspect`, the limits of 1 - overlap by round."""

    high: float = 0.25
    low: float = 0.1
    begin: float = 0.35
    lost: int = 30
    first: float = 0.8
    second: float = 0.5
    unconfirmed: float = 0.7
    duplicate: float = 0.15
    confirm: int = 2
    position: float = 1 / 20
    velocity: float = 1 / 160


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes, pair by pair."""
    side = np.maximum(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0)
    both = side[:, 0] * side[:, 1]
    wa, wb = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
    return both / np.maximum(wa[:, 0] * wa[:, 1] + wb[:, 0] * wb[:, 1] - both, 1e-9)


def pairs_within(a: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in `a`, place) of things whose clips `a` tells with those that lie at first[clip] to first[clip] + n[clip]."""
    many = n[a]
    i = np.repeat(np.arange(len(a)), many)
    return i, first[a][i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)


def as_measured(boxes: np.ndarray) -> np.ndarray:
    out = np.empty((len(boxes), 4))
    out[:, :2], out[:, 2:] = (boxes[:, :2] + boxes[:, 2:]) / 2, boxes[:, 2:] - boxes[:, :2]
    out[:, 2] /= np.maximum(out[:, 3], 1e-9)
    return out


PLACE, SPEED, P11, P12, P22 = range(5)
ID, SEEN, BEGAN, STREAK, TRACKED, CONFIRMED, CLIP = range(7)


class ByteTracks:
    """The tracks of several clips, stepped together. `step` takes a frame of each clip that has one left: its boxes (x1, y1, x2, y2) and
    their confidence, and gives the track of each box, 0 for none.

    All tracks' filters are one array, their marks another; pairs of tracks and boxes are formed within clips."""

    #: Standard deviations of the aspect, which don't follow the height: of its steps, of its speed's, of its measurements.
    STEP, SPEED_STEP, MEASURED = (np.array([0.0, 0.0, x, 0.0]) for x in (1e-2, 1e-5, 1e-1))

    def __init__(self, cfg: ByteConfig, clips: int):
        self.cfg, self.clips = cfg, clips
        self.frame, self.begun, self.ids = np.zeros(clips, np.int64), np.zeros(clips, bool), np.zeros(clips, np.int64)
        self.filters, self.marks = np.zeros((0, 5, 4)), np.zeros((0, 7), np.int64)
        height = np.array([1.0, 1.0, 0.0, 1.0])
        self.by_place, self.by_speed = cfg.position * height, cfg.velocity * height

    def _keep(self, which: np.ndarray) -> None:
        if not which.all():
            self.filters, self.marks = self.filters[which], self.marks[which]

    def _predict(self, which: np.ndarray) -> None:
        z = self.filters if which.all() else self.filters[which]
        h = z[:, PLACE, 3:]
        step, speed_step = (h * self.by_place + self.STEP) ** 2, (h * self.by_speed + self.SPEED_STEP) ** 2
        z[self.marks[which, TRACKED] == 0, SPEED, 3] = 0.0
        z[:, PLACE] += z[:, SPEED]
        z[:, P11] += 2 * z[:, P12] + z[:, P22] + step
        z[:, P12] += z[:, P22]
        z[:, P22] += speed_step
        if z is not self.filters:
            self.filters[which] = z

    def _update(self, tracks: np.ndarray, measured: np.ndarray) -> None:
        z, m = self.filters[tracks], self.marks[tracks]
        noise = (z[:, PLACE, 3:] * self.by_place + self.MEASURED) ** 2
        gain = z[:, P11:P22] / (z[:, P11] + noise)[:, None]
        off = measured - z[:, PLACE]
        z[:, PLACE:P11] += gain * off[:, None]
        z[:, P22] -= gain[:, 1] * z[:, P12]
        z[:, P11:P22] *= 1 - gain[:, :1]
        self.filters[tracks] = z
        m[:, STREAK] = m[:, STREAK] * m[:, TRACKED] + 1
        m[:, SEEN], m[:, TRACKED] = self.frame[m[:, CLIP]], 1
        self.marks[tracks] = m

    def _begin(self, measured: np.ndarray, clip: np.ndarray, confirmed: np.ndarray) -> None:
        new, h = np.zeros((len(measured), 5, 4)), measured[:, 3:]
        new[:, PLACE] = measured
        new[:, P11], new[:, P22] = (2 * h * self.by_place + self.STEP) ** 2, (10 * h * self.by_speed + self.SPEED_STEP) ** 2
        now, one = self.frame[clip], np.ones(len(clip), np.int64)
        marks = np.stack([0 * one, now, now, one, one, confirmed.astype(np.int64), clip], 1)
        self.filters, self.marks = np.concatenate([self.filters, new]), np.concatenate([self.marks, marks])

    def boxes(self) -> np.ndarray:
        place = self.filters[:, PLACE]
        out = np.empty((len(place), 4))
        half = place[:, 2:] / 2
        half[:, 0] *= place[:, 3]
        out[:, :2], out[:, 2:] = place[:, :2] - half, place[:, :2] + half
        return out

    def _advance(self, clips: np.ndarray, frame: np.ndarray) -> None:
        c, passed = self.cfg, np.zeros(self.clips, np.int64)
        passed[clips] = np.where(self.begun[clips], frame - self.frame[clips], 1)
        self.frame[clips] = frame
        if not len(self.marks):
            return
        clip = self.marks[:, CLIP]
        gap = passed[clip]  # 0: the clip is over
        if gap.max() == gap.min() == 1:
            self._predict(gap > 0)
        else:  # through frames without boxes: all are lost there, the unconfirmed go
            self._keep((gap > 0) & ((gap == 1) | ((self.marks[:, CONFIRMED] == 1) & (self.frame[clip] - self.marks[:, SEEN] <= c.lost))))
            gap = passed[self.marks[:, CLIP]]
            for k in range(int(gap.max(initial=0))):
                self._predict(gap > k)
                self.marks[gap > k + 1, TRACKED] = 0
        self._keep(self.frame[self.marks[:, CLIP]] - self.marks[:, SEEN] <= c.lost)

    def step(self, clips: np.ndarray, frame: np.ndarray, box_clip: np.ndarray, boxes: np.ndarray, conf: np.ndarray) -> np.ndarray:
        """`box_clip`: the clip of each box; boxes of a clip lie together."""
        c, first_frame = self.cfg, ~self.begun
        self._advance(clips, frame)
        self.begun[clips] = True
        measured, given = as_measured(boxes), np.full(len(boxes), -1)
        sure, unsure = conf >= c.high, (conf >= c.low) & (conf < c.high)
        stays = np.ones(len(self.marks), bool)
        if len(self.marks) and len(boxes):
            n = np.bincount(box_clip, minlength=self.clips)
            first = np.zeros(self.clips, np.int64)
            first[box_clip[::-1]] = np.arange(len(boxes))[::-1]
            track, box = pairs_within(self.marks[:, CLIP], first, n)
            share = overlaps(self.boxes()[track], boxes[box])
        else:
            track = box = np.zeros(0, np.int64)
            share = np.zeros(0)
        fused = share * conf[box]

        def link(of: np.ndarray, some: np.ndarray, likeness: np.ndarray, limit: float) -> None:
            gain = likeness - (1 - limit)
            at = np.flatnonzero((gain > 0) & of[track] & some[box])
            if not len(at):
                return
            i, j = track[at], box[at]
            alone = (np.bincount(i, minlength=len(of))[i] == 1) & (np.bincount(j, minlength=len(some))[j] == 1)
            if not alone.all():
                alone[disputed(i, j, gain[at], self.marks[i, CLIP], np.flatnonzero(~alone))] = True
                i, j = i[alone], j[alone]
            given[j] = i
            self._update(i, measured[j])

        known, was = self.marks[:, CONFIRMED] == 1, self.marks[:, TRACKED] == 1
        now = self.frame[self.marks[:, CLIP]]
        link(known, sure, fused, c.first)
        link(known & was & (self.marks[:, SEEN] != now), unsure, share, c.second)
        self.marks[known & (self.marks[:, SEEN] != now), TRACKED] = 0
        if not known.all():
            link(~known, sure & (given < 0), fused, c.unconfirmed)
            stays = known | (self.marks[:, SEEN] == now)
            self.marks[self.marks[:, STREAK] >= c.confirm, CONFIRMED] = 1
        begin = np.flatnonzero(sure & (given < 0) & (conf >= c.begin))
        if len(begin):
            given[begin] = len(self.marks) + np.arange(len(begin))
            self._begin(measured[begin], box_clip[begin], first_frame[box_clip[begin]] | (c.confirm <= 1))
            stays = np.concatenate([stays, np.ones(len(begin), bool)])
        stays &= ~self._doubles()
        new = np.flatnonzero((self.marks[:, CONFIRMED] == 1) & (self.marks[:, ID] == 0) & stays)
        if len(new):
            new = new[np.argsort(self.marks[new, CLIP], kind="stable")]
            of = self.marks[new, CLIP]
            self.marks[new, ID] = self.ids[of] + 1 + np.arange(len(new)) - np.searchsorted(of, of)
            self.ids += np.bincount(of, minlength=self.clips)
        out = np.zeros(len(boxes), int)
        found = np.flatnonzero(given >= 0)
        out[found] = np.where(stays[given[found]], self.marks[given[found], ID], 0)
        self._keep(stays)
        return out

    def _doubles(self) -> np.ndarray:
        """Of a tracked and a lost track in one place the younger."""
        out = np.zeros(len(self.marks), bool)
        here, there = self.marks[:, CONFIRMED] == 1, self.marks[:, TRACKED] == 1
        lost, now = np.flatnonzero(here & ~there), np.flatnonzero(here & there)
        if len(lost) and len(now):
            now = now[np.argsort(self.marks[now, CLIP], kind="stable")]
            of = self.marks[now, CLIP]
            n = np.bincount(of, minlength=self.clips)
            i, j = pairs_within(self.marks[lost, CLIP], np.cumsum(n) - n, n)
            boxes = self.boxes()
            near = overlaps(boxes[lost[i]], boxes[now[j]]) > 1 - self.cfg.duplicate
            if near.any():
                i, j = lost[i[near]], now[j[near]]
                life = self.marks[:, SEEN] - self.marks[:, BEGAN]
                out[np.where(life[j] > life[i], i, j)] = True
        return out


def disputed(i: np.ndarray, j: np.ndarray, gain: np.ndarray, clip: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of the pairs `which`, those that together gain most in each clip."""
    which = which[np.argsort(clip[which], kind="stable")]
    chosen: list[int] = []
    for part in np.split(which, np.flatnonzero(np.diff(clip[which])) + 1):
        pairs = {(t, k): p for t, k, p in zip(i[part].tolist(), j[part].tolist(), part.tolist(), strict=True)}
        tracks, boxes = list(dict.fromkeys(t for t, _ in pairs)), list(dict.fromkeys(k for _, k in pairs))
        cost = np.array([[-gain[pairs[t, k]] if (t, k) in pairs else 0.0 for k in boxes] for t in tracks])
        chosen += [pairs[tracks[a], boxes[b]] for a, b in assign(cost) if (tracks[a], boxes[b]) in pairs]
    return np.array(chosen, np.int64)


class ByteTrack(ByteTracks):
    """The tracks of one clip."""

    def __init__(self, cfg: ByteConfig):
        super().__init__(cfg, 1)

    def step(self, frame: int, boxes: np.ndarray, conf: np.ndarray) -> np.ndarray:
        return super().step(np.zeros(1, int), np.array([frame]), np.zeros(len(boxes), int), boxes, conf)


def tracked_boxes(boxes: DataFrame, keys: list[str], order: list[str], carry: list[str], cfg: ByteConfig = ByteConfig()) -> DataFrame:
    """The boxes on confirmed tracks: keys, the columns `carry`, track_id, and begins (it is the track's first). `boxes`: keys, frame,
    x1, y1, x2, y2, conf, `carry` and `order`, by which those of a frame are taken; frames without boxes just pass. Tracks are numbered
    from 1 in each clip, in the order in which they are confirmed; those that begin in a clip's first frame are confirmed at once."""
    columns = ["frame", "x1", "y1", "x2", "y2", "conf"]

    def fold(pdf: pd.DataFrame, clip: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        place, conf, frame = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["conf"].to_numpy(float), pdf["frame"].to_numpy(np.int64)
        begins = np.flatnonzero((np.diff(clip, prepend=-1) != 0) | (np.diff(frame, prepend=0) != 0))  # of frames of clips
        ends, of = np.append(begins[1:], len(pdf)), clip[begins]
        turn = np.arange(len(begins)) - np.searchsorted(of, of)  # a frame's number in its clip
        order = np.argsort(turn, kind="stable")
        tracks, found = ByteTracks(cfg, int(clip[-1]) + 1), np.zeros(len(pdf), np.int64)
        for part in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
            many = ends[part] - begins[part]
            rows = np.repeat(begins[part] - np.cumsum(many) + many, many) + np.arange(many.sum())
            found[rows] = tracks.step(of[part], frame[begins[part]], clip[rows], place[rows], conf[rows])
        on = np.flatnonzero(found)
        track, first = found[on], np.zeros(len(on), bool)
        first[np.unique(clip[on] * (found.max() + 1) + track, return_index=True)[1]] = True
        return on, pd.DataFrame({"track_id": track.astype(np.int32), "begins": first})

    rows = boxes.select(*dict.fromkeys([*keys, *columns, *order, *carry]))
    return picked_rows(rows, keys, ["frame", *order], columns, carry, fold, "track_id int, begins boolean", 400_000)


def track_players(boxes: DataFrame, keys: list[str], cfg: ByteConfig = ByteConfig()) -> DataFrame:
    """(keys, frame, det_idx, track_id) of the boxes on confirmed tracks (see `tracked_boxes`). `boxes`: keys, frame, det_idx, x1, y1, x2,
    y2, conf."""
    rows = tracked_boxes(boxes, keys, ["det_idx"], ["frame", "det_idx"], cfg)
    return rows.select(*keys, *(F.col(c).cast("int").alias(c) for c in ("frame", "det_idx")), "track_id")
