"""Tracking scenes: identity across gaps, crossings and weak detections; splitting changes nothing."""

import itertools

import numpy as np
import pandas as pd
import pytest

from skyreel.operators import tracking
from skyreel.operators.tracking import Motion, Tracker, assign

W, H = 1920, 1080


def box(x, y, confidence=90):
    return ([x, y, x + 79, y + 79], confidence)


def see(tracker, frame, *boxes):
    tracker.update(frame * 40, np.array([b for b, _ in boxes]).reshape(-1, 4), np.array([float(c) for _, c in boxes]), ["Vehicle"] * len(boxes))
    return tracker.reported()


def test_a_mover_seen_every_fifth_frame_keeps_its_id():
    tracker = Tracker(W, H)
    for frame in range(1, 61):
        x = 100 + 6 * frame
        tracks = see(tracker, frame, box(x, 500)) if frame % 5 == 1 else (tracker.predict(), tracker.reported())[1]
        assert [t[0] for t in tracks] == [1]
        if frame > 30:
            assert abs((tracks[0][1] + tracks[0][3]) // 2 - (x + 40)) <= 6


def test_crossing_objects_keep_their_ids():
    tracker = Tracker(W, H)
    for frame in range(1, 81):
        tracks = see(tracker, frame, box(100 + 8 * frame, 300), box(740 - 8 * frame, 330))
        assert sorted(t[0] for t in tracks) == [1, 2]
    assert {t[0]: t[1] > 500 for t in tracks} == {1: True, 2: False}


@pytest.mark.parametrize("gap, same", [(10, True), (40, False)])
def test_occlusion(gap, same):
    tracker = Tracker(W, H)
    for frame in range(1, 21):
        before = see(tracker, frame, box(100 + 4 * frame, 300))[0][0]
    for frame in range(21, 21 + gap):
        assert see(tracker, frame) == []
    for frame in range(21 + gap, 26 + gap):
        after = see(tracker, frame, box(100 + 4 * frame, 300))
    assert (after[0][0] == before) is same


def test_weak_boxes_sustain_but_never_start():
    tracker = Tracker(W, H)
    for frame in range(1, 11):
        assert see(tracker, frame, box(100, 100, 30), box(600, 600, 65)) == []
    for frame in range(11, 16):
        tracks = see(tracker, frame, box(100 + 4 * frame, 100))
    (first,) = tracks
    for frame in range(16, 41):
        (track,) = see(tracker, frame, box(100 + 4 * frame, 100, 30))
        assert track[0] == first[0] and track[5] == 30
    assert see(tracker, 41, box(100 + 4 * 41, 100, 5)) == []


def test_motion():
    motion = Motion()
    motion.add(np.array([[100.0, 200, 1, 50]]))
    motion.advance(np.array([False]))
    assert motion.at[0].tolist() == [100, 200, 1, 50]
    motion.speed[0] = [3, -2, 0, 4]
    motion.advance(np.array([False]))
    assert motion.at[0].tolist() == [103, 198, 1, 54]
    motion.advance(np.array([True]))
    assert motion.at[0].tolist() == [106, 196, 1, 54]


def full_filter(observations):
    """The eight-state filter with whole matrices, to hold the four pairs against."""
    first = observations[0]
    mean, h = np.array([*first, 0, 0, 0, 0], float), first[3]
    std = lambda a, b, c, d: np.array([a * h, a * h, c, a * h, b * h, b * h, d, b * h]) ** 2
    cov = np.diag(std(2 / 20, 10 / 160, 1e-2, 1e-5))
    move = np.eye(8) + np.diag(np.ones(4), 4)
    see_ = np.eye(4, 8)
    for seen in observations[1:]:
        h = mean[3]
        mean, cov = move @ mean, move @ cov @ move.T + np.diag(std(1 / 20, 1 / 160, 1e-2, 1e-5))
        h = mean[3]
        noise = np.diag(np.array([h / 20, h / 20, 1e-1, h / 20]) ** 2)
        gain = cov @ see_.T @ np.linalg.inv(see_ @ cov @ see_.T + noise)
        mean, cov = mean + gain @ (np.array(seen) - see_ @ mean), cov - gain @ (see_ @ cov @ see_.T + noise) @ gain.T
    return mean


def test_four_pairs_equal_the_whole_filter():
    rng = np.random.default_rng(0)
    seen = [[100 + 5 * i + rng.normal(), 200 - i, 1 + 0.01 * i, 50 + rng.normal()] for i in range(15)]
    motion = Motion()
    motion.add(np.array([seen[0]]))
    for observation in seen[1:]:
        motion.advance(np.array([False]))
        motion.correct(np.array([0]), np.array([observation]))
    np.testing.assert_allclose([*motion.at[0], *motion.speed[0]], full_filter(seen), rtol=1e-9)


def test_assignment_is_optimal():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n, m = (int(v) for v in rng.integers(1, 5, 2))
        cost, limit = rng.random((n, m)), rng.choice([0.3, 0.5, 0.8])
        pairs = assign(cost, limit)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        spent = sum(cost[p] for p in pairs) + limit * (n - len(pairs))
        best = min(
            sum(cost[r, c] if c < m else limit for r, c in enumerate(choice))
            for choice in itertools.permutations(range(m + n), n)
        )
        assert spent == pytest.approx(best)


def random_scene(seed=1, frames=260):
    rng = np.random.default_rng(seed)
    rows, shots = [], []
    for stream in ("hot", "cold"):
        for seq in range(1, frames if stream == "hot" else 40):
            size = (1920, 1080) if seq < 200 else (1280, 720)
            shots.append((stream, seq, seq * 40 if seq != 150 else 10, *size, int(rng.integers(0, 3))))
            quiet = 30 <= seq % 100 < 75
            for det in range(0 if quiet else int(rng.integers(0, 4))):
                x, y = 100 + det * 200 + seq % 50 * 4, 100 + det * 60
                sure = None if rng.random() < 0.1 else int(rng.integers(5, 100))
                rows.append((stream, seq, det, x, y, x + 79, y + 79, sure, "car"))
    frames_ = pd.DataFrame(shots, columns=["stream", "seq", "pts", "width", "height", "steps_before"])
    boxes = pd.DataFrame(rows, columns=["stream", "seq", "det", "left", "top", "right", "bottom", "confidence", "class_name"])
    return frames_, boxes.assign(confidence=boxes["confidence"].astype("Int32"))


def one_pass(frames, boxes):
    out = []
    for stream, shots in frames.groupby("stream"):
        tracker, last, epoch = None, None, 0
        for shot in shots.itertuples():
            size = (shot.width, shot.height)
            if tracker is None or shot.pts < last or size != (tracker.width, tracker.height):
                tracker, epoch = Tracker(*size), epoch + 1
            else:
                for _ in range(shot.steps_before):
                    tracker.predict()
            last = shot.pts
            seen = boxes[(boxes["stream"] == stream) & (boxes["seq"] == shot.seq)]
            tracker.update(
                shot.pts, seen[["left", "top", "right", "bottom"]].to_numpy(float), seen["confidence"].astype(float).to_numpy(), seen["class_name"].tolist()
            )
            out.extend((stream, epoch, shot.seq, t[0], *t[1:5]) for t in tracker.reported())
    return sorted(out)


def test_splitting_where_the_tracker_is_empty_changes_nothing(spark):
    frames, boxes = random_scene()
    schema = "stream string, seq long, det int, left int, top int, right int, bottom int, confidence int, class_name string"
    plain = lambda v: None if v is pd.NA else v if isinstance(v, str) else int(v)
    rows = [tuple(plain(v) for v in r) for r in boxes.itertuples(index=False, name=None)]
    got = tracking.track_objects(spark.createDataFrame(frames), spark.createDataFrame(rows, schema), block_rows=23)
    columns = ["stream", "epoch", "seq", "track_id", "left", "top", "right", "bottom"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == one_pass(frames, boxes)


def lanes_scene(seed, frames=160, lanes=5, wanderer=False):
    """Objects that keep to lanes of their own, so that no tracker is ever empty; one may break off towards another lane and vanish."""
    rng = np.random.default_rng(seed)
    shots, rows = [], []
    for seq in range(1, frames):
        shots.append(("hot", seq, seq * 40, 1920, 1080, int(rng.integers(0, 2))))
        det = 0
        for lane in range(lanes):
            if rng.random() < 0.25 or (lane == 2 and 60 <= seq % 120 < 80):
                continue
            x, y = 40 + (seq * (3 + lane)) % 1600, 20 + lane * 210
            if wanderer and lane == 1 and seq % 40 > 30:
                y += (seq % 40 - 30) * 12
            rows.append(("hot", seq, det, x, y, x + 59, y + 59, None if rng.random() < 0.1 else int(rng.integers(5, 100)), "car"))
            det += int(rng.integers(1, 3))
            if rng.random() < 0.3:
                rows.append(("hot", seq, det, x + 30, y + 10, x + 89, y + 69, int(rng.integers(50, 100)), "van"))
                det += 1
    order = rng.permutation(len(rows))
    numbers = {}
    for k in order:  # boxes are numbered in any order, so ids of different lanes interleave
        seq = rows[k][1]
        numbers[seq] = numbers.get(seq, 0) + 1
        rows[k] = (*rows[k][:2], numbers[seq], *rows[k][3:])
    rows.sort(key=lambda r: (r[1], r[2]))
    frames_ = pd.DataFrame(shots, columns=["stream", "seq", "pts", "width", "height", "steps_before"])
    boxes = pd.DataFrame(rows, columns=["stream", "seq", "det", "left", "top", "right", "bottom", "confidence", "class_name"])
    return frames_, boxes.assign(confidence=boxes["confidence"].astype("Int32"))


@pytest.mark.parametrize("seed, cell, wanderer, split", [(1, 64, False, True), (2, 32, False, True), (3, 64, True, None), (4, 16, True, None), (5, 2_000, False, False)])
def test_a_busy_scene_in_parts_is_the_one_pass_result(spark, monkeypatch, seed, cell, wanderer, split):
    frames, boxes = lanes_scene(seed, wanderer=wanderer)
    found = []
    whole = tracking._in_parts
    monkeypatch.setattr(tracking, "_in_parts", lambda *a: found.append(whole(*a)) or found[-1])
    schema = "stream string, seq long, det int, left int, top int, right int, bottom int, confidence int, class_name string"
    plain = lambda v: None if v is pd.NA else v if isinstance(v, str) else int(v)
    rows = [tuple(plain(v) for v in r) for r in boxes.itertuples(index=False, name=None)]
    got = tracking.track_objects(spark.createDataFrame(frames), spark.createDataFrame(rows, schema), block_rows=41, cell=cell, busy=10)
    columns = ["stream", "epoch", "seq", "track_id", "left", "top", "right", "bottom"]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == one_pass(frames, boxes)
    parts = 0 if found[0] is None else found[0][1].count()
    assert split is None or (parts > 0) == split


def test_labels_of_cells():
    cells = pd.DataFrame({"stream": "s", "epoch": 1, "run": 1, "across": 10, "cell": [0, 1, 12, 5, 25, 34, 78]})
    got = dict(tracking._labelled(cells)[["cell", "part"]].itertuples(index=False, name=None))
    assert got[0] == got[1] == got[12] and got[25] == got[34] and len(set(got.values())) == 4
