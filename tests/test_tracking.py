import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.operators import sequences
from ravelin.operators.config import DetectorConfig, TrackConfig
from ravelin.operators.detect import Detector, label_components, open_and_close
from ravelin.operators.tracker import Track, Tracker, associate, gap, live_event, merge_fragments, overlap, summarise

CONFIG = TrackConfig()
box = lambda x, y, w=4, h=4, d=50.0: (x, y, x + w, y + h, d, w * h)
boxes = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 6), st.integers(1, 6)).map(lambda t: box(*t)), max_size=8)


def test_unknown_parameter():
    with pytest.raises(KeyError):
        DetectorConfig.of(no_such=1)


def test_merge_at_the_gap_and_beyond():
    assert len(merge_fragments([box(0, 0), box(7, 0)], 3)) == 1
    assert len(merge_fragments([box(0, 0), box(8, 0)], 3)) == 2
    assert merge_fragments([box(0, 0, d=5.0), box(14, 0), box(7, 0, d=9.0)], 3) == [(0, 0, 18, 4, 50.0, 48)]


def test_merged_boxes_are_not_merged_again():
    # The union of the first two covers the third, which is near neither.
    assert len(merge_fragments([(0, 0, 2, 30, 1.0, 1), (4, 28, 40, 30, 1.0, 1), (20, 5, 22, 7, 1.0, 1)], 3)) == 2


@given(boxes)
@settings(max_examples=50, deadline=None)
def test_merge_is_single_linkage_and_ignores_order(own):
    found = merge_fragments(own, 3)
    assert sum(b[5] for b in found) == sum(b[5] for b in own)
    mixed = own[:]
    random.Random(1).shuffle(mixed)
    assert sorted(merge_fragments(mixed, 3)) == sorted(found)


def slow_pairs(tracks, found, diagonal):
    """Of all pairs within the gate the cheapest, then the cheapest of what that leaves free, and so on."""
    reach = CONFIG.max_dist_frac * diagonal
    free = []
    for i, t in enumerate(tracks):
        for j, b in enumerate(found):
            d = float(np.hypot((b[0] + b[2]) / 2 - t.x, (b[1] + b[3]) / 2 - t.y))
            if d <= reach:
                free.append((d / reach - CONFIG.iou_weight * overlap(t.box, b), i, j))
    out = []
    while free:
        out.append(min(free))
        free = [p for p in free if p[1] != out[-1][1] and p[2] != out[-1][2]]
    return out


@given(boxes, boxes)
@settings(max_examples=50, deadline=None)
def test_association_is_one_to_one_and_gated(a, b):
    tracks = [Track.begin(i, 0, x, CONFIG) for i, x in enumerate(a)]
    owner = associate(tracks, b, CONFIG, 50.0)
    assert len(set(owner.values())) == len(owner) and set(owner) <= set(range(len(b)))
    assert list(owner.items()) == [(j, i) for _, i, j in slow_pairs(tracks, b, 50.0)]
    for j, i in owner.items():
        assert math.dist(((a[i][0] + a[i][2]) / 2, (a[i][1] + a[i][3]) / 2), ((b[j][0] + b[j][2]) / 2, (b[j][1] + b[j][3]) / 2)) <= 8.0


def test_overlap_and_gap_are_symmetric():
    assert overlap(box(0, 0), box(2, 2)) == overlap(box(2, 2), box(0, 0)) == 4 / 28
    assert gap(box(0, 0), box(7, 8)) == gap(box(7, 8), box(0, 0)) == 5.0


def test_a_track_ends_at_the_thirteenth_miss():
    t = Tracker(160, 120, CONFIG, 3)
    for n in range(3):
        assert t.step(n, [box(50 + n, 50)]) == []
    for n in range(3, 15):
        assert t.step(n, []) == []
    assert len(t.overlay()) == 1
    ended = t.step(15, [])
    assert len(ended) == 1 and ended[0].hits == 3 and not t.active


def test_unreported_tracks_use_up_numbers():
    t = Tracker(160, 120, TrackConfig.of(max_age=0), 2)
    t.step(0, [box(0, 0)])
    t.step(1, [box(100, 100)])
    t.step(2, [box(100, 100)])
    assert [x.id for x in t.flush()] == [1]


def test_kalman_is_the_matrix_form():
    rng = np.random.default_rng(0)
    t = Track.begin(1, 0, box(10, 20), CONFIG)
    x, p = np.array([12.0, 22.0, 0, 0]), np.diag([6.0, 6.0, 100.0, 100.0])
    f, h = np.eye(4), np.eye(2, 4)
    f[0, 2] = f[1, 3] = 1
    for n in range(1, 60):
        t.predict()
        x, p = f @ x, f @ p @ f.T + 4 * np.eye(4)
        if rng.random() < 0.7:
            b = box(int(rng.integers(0, 100)), int(rng.integers(0, 100)))
            t.update(n, b)
            z = np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2])
            k = p @ h.T @ np.linalg.inv(h @ p @ h.T + 6 * np.eye(2))
            x, p = x + k @ (z - h @ x), (np.eye(4) - k @ h) @ p
        assert np.allclose([t.x, t.y, t.vx, t.vy], x) and np.allclose([t.p00, t.p01, t.p11], [p[0, 0], p[0, 2], p[2, 2]])


def test_peak_is_the_first_of_equals_and_strength_is_unrounded_live():
    t = Track.begin(1, 5, box(10, 10, d=34.996), CONFIG)
    t.update(6, box(30, 10, d=34.996))
    assert live_event(t, 10, DetectorConfig()) is None
    row = summarise(t, 10, 160, 120, CONFIG)
    assert row["peak_frame"] == 5 and row["start_frame"] == 5 and row["confidence"] == "low"


def test_components_touch_at_corners():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]], bool)
    assert label_components(m).tolist() == [[1, 0, 0, 2], [0, 1, 0, 0], [0, 0, 0, 3], [4, 0, 0, 3]]
    snake = np.zeros((9, 9), bool)
    snake[::2] = True
    snake[1::4, 8] = snake[3::4, 0] = True
    assert label_components(snake).max() == 1


def test_opening_drops_specks_and_keeps_blocks():
    m = np.zeros((9, 9), bool)
    m[1, 1] = True
    m[4:8, 4:8] = True
    out = open_and_close(m, 3)
    assert not out[1, 1] and out[5, 5] and open_and_close(m, 1) is m


def test_detector_warms_up_then_finds_and_freezes():
    d = Detector((20, 20), DetectorConfig.of(warmup=3, morph_kernel=1))
    flat = np.full((20, 20), 100, np.float32)
    hot = flat.copy()
    hot[5:8, 5:8] = 160
    assert [d.step(x) for x in (flat, flat, hot)] == [[], [], []]
    (b,) = d.step(hot)
    assert b[:4] == (5, 5, 8, 8) and b[5] == 9
    before = d.background[6, 6]
    d.step(hot)
    assert d.background[6, 6] == before  # under the mask


def test_exactly_the_threshold_is_not_hot():
    d = Detector((10, 10), DetectorConfig.of(warmup=0, morph_kernel=1, min_mean_delta=0, max_area_frac=1.0))
    d.step(np.zeros((10, 10)))
    frame = np.zeros((10, 10))
    frame[2:4, 2:4] = 22
    assert d.step(frame) == []


def test_too_many_blobs_give_none():
    d = Detector((20, 20), DetectorConfig.of(warmup=0, morph_kernel=1, max_blobs=1))
    d.step(np.zeros((20, 20)))
    frame = np.zeros((20, 20))
    frame[1:4, 1:4] = frame[10:13, 10:13] = 90
    assert d.step(frame) == []


def test_throttles():
    times = [0, 4, 8, 12, 16, 20, 24]
    assert list(sequences.drift_throttle(times, 5)) == [True, False, True, False, True, False, True]
    assert sum(sequences.catch_up_throttle(times, 5)) == 5
    assert all(sequences.catch_up_throttle(times, 0))


def test_clips_extend_and_close_at_the_post_roll():
    rows = [(0, False, None), (5, True, 5), (10, False, 5), (14, True, 14), (20, False, 14), (24, False, 14), (30, True, 30)]
    assert list(sequences.clips(rows, 5, 10)) == [(5, 5, 0, 24, 6, "post-roll elapsed"), (30, 30, 30, 30, 1, "shutdown")]


def test_segments_and_statistics():
    assert list(sequences.segments([0, 5, 10, 12, 25], 10)) == [0, 0, 1, 1, 2]
    assert list(sequences.statistics_windows([0, 30, 60, 90, 125], 60)) == [(0, 60, 3), (60, 125, 2)]


def test_reported_digits():
    t = Track.begin(0, 0, box(10, 10, d=61.23456), CONFIG)
    for n in range(1, 8):
        t.update(n, box(10 + 7 * n, 10 + 3 * n, d=60.0))
    row, event = summarise(t, 9.0, 160, 120, CONFIG), live_event(t, 9.0, DetectorConfig())
    for r in (row, event):
        assert r["track_id"] == 0 and r["peak_mean_delta"] == 61.23 and r["displacement_px"] == 53.3 and r["duration_s"] == 0.78
        assert r["path_px"] == 53.3 and r["speed_px_s"] == 68.54 and r["peak_box"] == [10, 10, 14, 14]
    assert row["score"] == round(61.23456 * 4 * (1 + math.hypot(49, 21) / 20), 1) and row["continuity"] == 1.0


def test_a_missing_frame_is_stepped_over():
    from ravelin.streaming.tracking import Follower

    frames = [(n, [box(20 + n // 4, 30)] if n < 150 else [], n == 199) for n in range(200) if n not in (50, 51, 198)]
    want = Tracker(160, 120, CONFIG, 3)
    ended = [x for n, b, _ in frames for x in want.step(n, b)] + want.flush()
    expected = [live_event(t, 10.0, DetectorConfig()) for t in ended]
    for horizon in (5, 20, 1000):
        rng = random.Random(horizon)
        order = sorted(frames, key=lambda f: f[0] + (rng.random() * min(horizon, 40)))  # none is later than the horizon
        f = Follower(160, 120, 10.0, DetectorConfig(), CONFIG, horizon)
        got = [e for n, b, last in order for e in f.take(n, b, last)]
        assert len(f.early) <= horizon
        got += f.drain()
        assert got == expected != [] and f.done and not f.early


def test_detection_in_the_hot_part_is_that_of_whole_frames():
    import numpy as np
    from ravelin.operators import detect

    rng = np.random.default_rng(2)
    for _ in range(300):
        height, width = rng.integers(1, 30, 2)
        size = int(rng.integers(2, 7))
        mask = rng.random((height, width)) < rng.choice((0.02, 0.1, 0.4, 0.9))
        own = detect.ellipse(size)
        assert (detect.erode(detect.dilate(detect.dilate(detect.erode(mask, own), own), own), own) == detect.open_and_close(mask, size)).all()
        delta, label, want = rng.normal(size=(height, width)).astype(np.float32), detect.label_components(mask), []
        for n in range(1, int(label.max(initial=0)) + 1):
            ys, xs = np.nonzero(label == n)
            want.append((int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1, float(delta[ys, xs].mean()), len(xs)))
        assert detect.blobs(mask, delta) == want
        assert detect.blobs(mask, delta, 2, 5) == [b for b in want if 2 <= b[5] <= 5]
