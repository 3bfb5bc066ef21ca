"""Player tracks: the box filter against matrices, and cases of the published method worked by hand."""

import numpy as np
import pytest
from rallyframe.operators.bytetrack import ID, PLACE, TRACKED, ByteConfig, ByteTrack, as_measured, disputed, overlaps, track_players

BOX = "clip long, frame int, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double"


def box(x, y=100.0, w=60.0, h=150.0):
    return [x, y, x + w, y + h]


def run(frames, cfg=ByteConfig()):
    """Ids of each frame's boxes; frames: list of lists of (box, confidence)."""
    tracks = ByteTrack(cfg)
    return [tracks.step(f, np.array([b for b, _ in found], float).reshape(-1, 4), np.array([c for _, c in found], float)).tolist() for f, found in enumerate(frames)]


def test_filter_against_matrices():
    cfg, rng = ByteConfig(), np.random.default_rng(1)
    tracks = ByteTrack(cfg)
    f = np.eye(8) + np.eye(8, k=4)
    h = np.eye(4, 8)
    x = p = None
    for frame in range(12):
        z = as_measured(np.array([box(100 + 7 * frame + rng.normal(), 50 + 3 * frame, 60, 150 + frame)]))[0]
        std = lambda k, pos, a, vel, b: np.array([pos * k, pos * k, a, pos * k, vel * k, vel * k, b, vel * k])
        if x is None:
            x, p = np.r_[z, np.zeros(4)], np.diag(std(z[3], 2 * cfg.position, 1e-2, 10 * cfg.velocity, 1e-5) ** 2)
        else:
            q = np.diag(std(x[3], cfg.position, 1e-2, cfg.velocity, 1e-5) ** 2)
            x, p = f @ x, f @ p @ f.T + q
            r = np.diag(np.array([cfg.position * x[3]] * 2 + [1e-1] + [cfg.position * x[3]]) ** 2)
            gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
            x, p = x + gain @ (z - h @ x), (np.eye(8) - gain @ h) @ p
        assert tracks.step(frame, np.array([[z[0] - z[2] * z[3] / 2, z[1] - z[3] / 2, z[0] + z[2] * z[3] / 2, z[1] + z[3] / 2]]), np.array([0.9])).tolist() == [1]
        place, speed, p11, p12, p22 = tracks.filters[0]
        assert np.allclose(np.r_[place, speed], x) and np.allclose(p11, np.diag(p)[:4]) and np.allclose(p12, np.diag(p[:4, 4:]), atol=1e-12) and np.allclose(p22, np.diag(p)[4:])


def test_a_player_behind_another_keeps_the_id():
    """Two players cross; the farther, smaller one isn't seen for 20 frames, and both go on at their speeds."""
    frames = []
    for f in range(80):
        front, behind = box(300 + 5.0 * f), box(700 - 5.0 * f, 110.0, 40.0, 100.0)
        frames.append([(front, 0.9)] if 30 <= f < 50 else [(front, 0.9), (behind, 0.9)])
    ids = run(frames)
    assert ids[29] == [1, 2] and ids[40] == [1] and all(i == [1, 2] for i in ids[50:])


def test_a_player_away_for_too_long_is_another():
    frames = [[(box(100.0), 0.9)]] * 5 + [[]] * 31 + [[(box(100.0), 0.9)]] * 3
    assert run(frames)[-1] == [2]
    assert run([[(box(100.0), 0.9)]] * 5 + [[]] * 29 + [[(box(100.0), 0.9)]] * 3)[-1] == [1]


def test_unsure_boxes_go_on_but_don_t_begin_tracks():
    frames = [[(box(100.0), 0.9), (box(500.0), 0.2)]] + [[(box(100.0 + f), 0.9 if f % 2 else 0.15), (box(500.0), 0.2)] for f in range(1, 10)]
    assert run(frames) == [[1, 0]] * 10
    lost_first = [[(box(100.0), 0.9)]] * 4 + [[]] + [[(box(100.0), 0.2)]] * 3 + [[(box(100.0), 0.9)]]
    assert [i for i in run(lost_first)[5:]] == [[0], [0], [0], [1]]  # lost tracks take sure boxes only


def test_new_tracks_are_confirmed_by_a_second_sighting():
    one = (box(100.0), 0.9)
    frames = [[one], [one, (box(500.0), 0.9)], [one], [one, (box(900.0), 0.9)], [one, (box(902.0), 0.9)], [one, (box(904.0), 0.3)]]
    assert run(frames) == [[1], [1, 0], [1], [1, 0], [1, 2], [1, 2]]
    assert run(frames, ByteConfig(confirm=1))[1:4] == [[1, 2], [1], [1, 3]]
    assert run([[one], [one, (box(500.0), 0.3)], [one, (box(500.0), 0.3)]])[-1] == [1, 0]  # not sure enough to begin


def test_of_two_tracks_in_one_place_the_older_stays():
    tracks = ByteTrack(ByteConfig(confirm=1))
    for f in range(6):
        tracks.step(f, np.array([box(100.0)]), np.array([0.9]))
    tracks.step(6, np.zeros((0, 4)), np.zeros(0))
    tracks.step(7, np.array([box(160.0)]), np.array([0.9]))
    assert tracks.marks[:, ID].tolist() == [1, 2] and tracks.marks[:, TRACKED].tolist() == [0, 1]
    tracks.filters[1, PLACE] = tracks.filters[0, PLACE]
    assert tracks._doubles().tolist() == [False, True]


def test_links_have_the_largest_total_gain():
    """Greedily the second box would take the first track, and the first box none."""
    frames = [[([0.0, 0.0, 10.0, 10.0], 0.9), ([6.0, 0.0, 16.0, 10.0], 0.9)], [([3.2, 0.0, 13.2, 10.0], 0.9), ([-3.0, 0.0, 7.0, 10.0], 0.9)]]
    assert run(frames) == [[1, 2], [2, 1]]
    i, j, gain = np.array([0, 0, 1, 5]), np.array([0, 1, 0, 7]), np.array([0.5, 0.4, 0.45, 0.1])
    assert sorted(disputed(i, j, gain, np.zeros(4, int), np.arange(3)).tolist()) == [1, 2]
    assert overlaps(np.array([[0, 0, 2, 2.0]] * 2), np.array([[1, 1, 3, 3.0], [5, 5, 6, 6]])).tolist() == [pytest.approx(1 / 7), 0.0]


def test_clips_of_a_table(spark):
    rows = [(c, f, i, *box(100.0 + 300 * i + 4 * f), 0.9 if f % 4 else 0.15) for c in (1, 2) for f in range(40) if not 8 <= f <= 10 for i in range(3)]
    got = track_players(spark.createDataFrame(rows[::-1], BOX), ["clip"]).toPandas()
    assert got[got.frame > 2].groupby(["clip", "det_idx"]).track_id.agg(["nunique", "size"]).values.tolist() == [[1, 34]] * 6
    assert track_players(spark.createDataFrame([], BOX), ["clip"]).count() == 0


def test_clips_stepped_together_are_as_alone(spark):
    """Clips of several lengths with gaps and crowded frames, in one task, against one clip at a time."""
    rng, rows, want = np.random.default_rng(5), [], set()
    for c in range(12):
        tracks, frame = ByteTrack(ByteConfig()), 0
        for _ in range(int(rng.integers(1, 120))):
            frame += int(rng.choice([1, 1, 1, 1, 2, 7, 40]))
            found = [([*(p := rng.uniform(0, 300, 2)), p[0] + 60 + rng.uniform(0, 40), p[1] + 90 + rng.uniform(0, 60)], float(rng.choice([0.05, 0.2, 0.3, 0.6, 0.9]))) for _ in range(int(rng.integers(1, 9)))]
            ids = tracks.step(frame, np.array([b for b, _ in found]), np.array([k for _, k in found]))
            rows += [(c, frame, i, *map(float, b), k) for i, (b, k) in enumerate(found)]
            want |= {(c, frame, i, int(t)) for i, t in enumerate(ids) if t}
    got = {tuple(r) for r in track_players(spark.createDataFrame(rows, BOX).repartition(3), ["clip"]).collect()}
    assert got == want and max(t for *_, t in want) > 3
