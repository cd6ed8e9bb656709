import pytest
from compare import same

from ravelin.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLES[name]) > 0


def test_full_tracking_has_graded_tracks(spark, sf_dir):
    rows = catalog.full_tracking(spark, sf_dir).collect()
    assert rows and {r.confidence for r in rows} <= {"high", "medium", "low"}
    assert all(r.n_detections >= 3 and 0 < r.continuity <= 1 and 0 <= r.edge_frac <= 1 for r in rows)


def test_full_detect_track_is_the_plain_python_pipeline(spark, sf_dir):
    import numpy as np
    from ravelin.operators.config import DetectorConfig, TrackConfig
    from ravelin.operators.detect import Detector
    from ravelin.operators.tracker import Tracker, live_event

    config = DetectorConfig.of(warmup=5, min_delta=0.1, sigma_k=0.0, min_mean_delta=0.0, max_area_frac=0.19, max_blobs=3, morph_kernel=1, min_track_frames=2, min_event_delta=0.0)
    streams = {}
    for r in catalog.px2(spark, sf_dir).orderBy("stream_id", "frame_no").collect():
        streams.setdefault(r.stream_id, []).append(r.px)
    want = set()
    for s, frames in streams.items():
        detector, tracker = Detector((8, 8), config), Tracker(8, 8, TrackConfig.of(max_dist_frac=0.4, max_age=3), 2)
        ended = [t for n, px in enumerate(frames) for t in tracker.step(n, detector.step(np.array(px, np.float32).reshape(8, 8)))] + tracker.flush()
        want |= {(s, e["track_id"], e["start_frame"], e["end_frame"], e["n_detections"], e["peak_frame"], e["peak_area_px"]) for t in ended if (e := live_event(t, 10.0, config))}
    got = {(r.stream_id, r.track_id, r.start_frame, r.end_frame, r.n_detections, r.peak_frame, r.peak_area_px) for r in catalog.full_detect_track(spark, sf_dir).collect()}
    assert got == want and len(want) > 0


def test_entry():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_overlays_have_reportable_tracks_only(spark, sf_dir):
    rows = catalog.overlay_boxes(spark, sf_dir).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r.frame_no):
        first.setdefault((r.stream_id, r.track_id), r.frame_no)
    assert rows and min(first.values()) >= 2  # a track is shown from its third hit


def test_every_event_has_its_snapshot(spark, sf_dir):
    got = {(r.stream_id, r.track_id, r.peak_frame) for r in catalog.event_snapshots_all(spark, sf_dir).collect()}
    want = {(r.stream_id, r.track_id, r.peak_frame) for r in catalog.event_summary(spark, sf_dir).collect()}
    assert got == want  # tracks here last 12 frames at most, so no peak has left the cache
    last = {r.stream_id: r.last for r in catalog.px1(spark, sf_dir).groupBy("stream_id").agg({"frame_no": "max"}).toDF("stream_id", "last").collect()}
    assert any(peak <= last[stream] - 40 for stream, _, peak in got)


def test_every_track_has_its_start_time(spark, sf_dir):
    assert catalog.start_time_lookup_all(spark, sf_dir).where("start_time IS NULL").isEmpty()
    short = catalog._start_times(spark, sf_dir, catalog.px1(spark, sf_dir).where("frame_no < 60"))  # a list that ends early
    late = catalog.track_summary(spark, sf_dir).where("start_frame >= 60").count()
    assert short.where("start_time IS NULL").count() == late > 0


def test_models_geometry(spark):
    assert {tuple(r) for r in catalog.model_config(spark).collect()} == {("P1", 160, 120, 242, 77440, 77464), ("P3", 256, 192, 386, 197632, 197656)}


def test_registered_queries_read_whole_tables():
    from ravelin.plans import split

    assert not {"event_snapshots", "start_time_lookup", "tier_filter", "model_config", "rate_rounding"} & (set(catalog.QUERIES) | set(split.QUERIES))
    assert not set(catalog.QUERIES) & set(split.QUERIES)
