import json

import numpy as np
from pyspark.sql import functions as F

from ravelin.operators.config import DetectorConfig, TrackConfig
from ravelin.operators.joins import as_of, within
from ravelin.operators.summary import segment_sidecars
from ravelin.operators.tracker import Tracker, live_event
from ravelin.sources import files
from ravelin.streaming.tracking import stream_events


def test_detection_cache(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"video": "a.mp4", "fps": 0, "width": 160, "height": 120, "raw": [[0, []], [3, [[1, 2, 3, 4, 50.5, 4]]]]}))
    (tmp_path / "b.json").write_text(json.dumps({"video": "b.mp4", "error": "unreadable"}))
    rows = {(r.video_name, r.frame_no): r for r in files.read_detection_cache(spark, str(tmp_path)).collect()}
    assert rows["a", 3].boxes[0].area == 4 and rows["a", 3].fps == 10.0 and rows["a", 0].boxes == []
    assert rows["b", None].error == "unreadable"
    assert files.read_detection_cache(spark, str(tmp_path), ["b"]).count() == 1


def test_timestamps(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1.5\n2.5 3.5\n")
    (tmp_path / "b.txt").write_text("1.5\nx\n")
    assert [(r.video_name, r.frame_no, r.seconds) for r in files.read_timestamps(spark, str(tmp_path)).orderBy("frame_no").collect()] == [("a", 0, 1.5), ("a", 1, 2.5), ("a", 2, 3.5)]


def test_raw_planes_drop_a_cut_tail(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(np.arange(15, dtype="<u2").tobytes())
    rows = files.read_raw(spark, str(tmp_path), 2, 3).orderBy("frame_no").collect()
    assert [r.px for r in rows] == [list(range(6)), list(range(6, 12))]


def test_sinks(spark, tmp_path):
    tracks = spark.createDataFrame([(1, 1, 5.0), (1, 2, 9.0)], "stream_id long, track_id long, score double")
    assert files.write_tracks(tracks, str(tmp_path / "t"))
    assert [r.track_id for r in spark.read.option("header", True).csv(str(tmp_path / "t")).collect()] == ["2", "1"]
    assert not files.write_tracks(tracks.where("false"), str(tmp_path / "none"))
    files.write_events(tracks, str(tmp_path / "e"), F.lit(1.23456))
    assert {r.timestamp for r in spark.read.json(str(tmp_path / "e")).collect()} == {1.235}
    boxes = spark.createDataFrame([(1, 7, 1, 0, 0, 1, 1), (1, 7, 0, 2, 2, 3, 3)], "stream_id long, track_id long, frame_no long, x0 long, y0 long, x1 long, y1 long")
    files.write_paths(boxes, str(tmp_path / "p"))
    assert json.loads(spark.read.text(str(tmp_path / "p")).first().value)["tracks"] == {"7": [[0, 2, 2, 3, 3], [1, 0, 0, 1, 1]]}


def test_as_of_and_within(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 11, "c")], "k long, t long, v string")
    assert sorted((r.k, r.t, r.v) for r in as_of(left, right, "k", "t", ["v"]).collect()) == [(1, 5, "a"), (1, 10, "b"), (2, 1, None)]
    ranges = spark.createDataFrame([(1, 0, 30), (1, 10, 10), (2, 2, 9)], "k long, a long, b long")
    assert sorted((r.k, r.t, r.a) for r in within(left, ranges, "k", "t", "a", "b", 7).collect()) == [(1, 5, 0), (1, 10, 0), (1, 10, 10)]


def test_stream_gives_what_batch_gives(spark, tmp_path):
    rng = np.random.default_rng(4)
    frames = []
    for s in (1, 2):
        for n in range(40):
            seen = n < 22 and rng.random() < 0.85
            boxes = [dict(x0=3 * n, y0=10 * s, x1=3 * n + 5, y1=10 * s + 5, mean_delta=60.0 + n, area=25)] if seen else []
            frames.append(dict(stream_id=s, frame_no=n, last=n == 39, boxes=boxes))
    expected = []
    for s in (1, 2):
        t = Tracker(160, 120, TrackConfig(), 3)
        ended = [x for f in frames if f["stream_id"] == s for x in t.step(f["frame_no"], [tuple(b.values()) for b in f["boxes"]])] + t.flush()
        expected += [(s, e["track_id"], e["start_frame"], e["n_detections"]) for x in ended if (e := live_event(x, 10.0, DetectorConfig()))]
    order = rng.permutation(len(frames))
    (tmp_path / "in").mkdir()
    for part in range(4):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(frames[i]) for i in order[part::4]))
    schema = "stream_id long, frame_no long, last boolean, boxes array<struct<x0:double,y0:double,x1:double,y1:double,mean_delta:double,area:long>>"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream_events(source, 160, 120, 10.0, patience=None).writeStream.format("memory").queryName("events_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.stream_id, r.track_id, r.start_frame, r.n_detections) for r in spark.table("events_out").collect()) == sorted(expected) != []


def test_offline_job_from_caches_to_reports(spark, tmp_path):
    from ravelin.plans import offline

    moving = [[n, [[10 + 5 * n, 20, 20 + 5 * n, 30, 90.0 + n, 100]]] for n in range(12)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"video": "a.mp4", "fps": 10, "width": 160, "height": 120, "raw": moving}))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"video": "b.mp4", "error": "unreadable"}))
    (tmp_path / "times").mkdir()
    (tmp_path / "times" / "a.txt").write_text(" ".join(str(1.5 + n) for n in range(12)))
    (r,) = offline.run(spark, str(tmp_path / "in"), str(tmp_path / "times"), str(tmp_path / "out")).collect()
    assert (r.video_name, r.track_id, r.confidence, r.start_frame, r.end_frame, r.n_detections) == ("a", 0, "high", 0, 11, 12)
    assert (r.start_time, r.displacement_px, r.duration_s, r.speed_px_s, r.peak_mean_delta) == ("1970-01-01T00:00:01.500000+00:00", 55.0, 1.1, 50.0, 101.0)
    assert (r.peak_x_min, r.peak_y_min, r.peak_x_max, r.peak_y_max) == (65, 20, 75, 30)
    assert [x.video_name for x in spark.read.option("header", True).csv(str(tmp_path / "out" / "tracks")).collect()] == ["a"]
    assert len(json.loads(spark.read.text(str(tmp_path / "out" / "paths")).first().value)["tracks"]["0"]) == 12


def test_stamps_do_not_depend_on_the_session_zone(spark):
    from ravelin.functions import scalars

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            r = spark.range(1).select(scalars.iso_utc(F.lit(86400.25)).alias("a"), scalars.file_stamp(F.lit(1_700_000_000_000_000).cast("long")).alias("b"), scalars.display_stamp(F.lit(-1).cast("long")).alias("c")).first()
            assert tuple(r) == ("1970-01-02T00:00:00.250000+00:00", "20231114_221320", "1969-12-31 23:59:59.999")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_fold_runs_streams_in_order_and_takes_what_it_needs(spark):
    from ravelin.operators.sequences import CHUNK_ROWS, fold

    n = 2 * CHUNK_ROWS + 5
    rows = spark.range(3 * n).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("s"), (-F.floor(F.col("id") / 3)).alias("t"), F.lit("x").alias("v"))

    def firsts(own):
        yield next(own)  # the rest of the stream is left unread

    assert sorted((r.s or 0, r.t, r.v) for r in fold(rows, "s", ["t"], firsts, "s long, t long, v string").collect()) == [(s, 1 - n, "x") for s in range(3)]
    every = fold(rows, ["s", "v"], ["t"], lambda own: ((t, i) for i, (t,) in enumerate(own)), "s long, v string, t long, i long")
    assert every.count() == 3 * n and every.where(f"t + {n - 1} <> i").isEmpty()
    assert fold(rows.where("false"), "s", ["t"], firsts, "s long, t long, v string").isEmpty()


def test_clips_hold_the_pre_roll_only():
    from ravelin.operators.sequences import beside, catch_up_throttle, clips

    rows = [(t, t % 97 == 0, t - t % 97) for t in range(0, 3000, 3)]
    want = [min(x for x, *_ in rows if opened - x <= 40 and x <= opened) for _, opened, *_ in clips(rows, 40, 20)]
    assert [first for _, _, first, *_ in clips(rows, 40, 20)] == want and len(want) > 5
    assert list(beside([("a", 0), ("b", 1), ("c", 9)], catch_up_throttle, 5)) == [("a", True), ("b", False), ("c", True)]


def test_files_beside_a_recording_have_its_name(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "r").mkdir()
    (tmp_path / "t" / "a_timestamps.txt").write_text("1.5\n2.5\n")
    (tmp_path / "r" / "a_raw.dat").write_bytes(np.arange(6, dtype="<u2").tobytes())
    assert {r.video_name for r in files.read_timestamps(spark, str(tmp_path / "t")).collect()} == {"a"}
    assert [(r.video_name, r.frame_no) for r in files.read_raw(spark, str(tmp_path / "r"), 2, 3).collect()] == [("a", 0)]


def test_timestamps_come_back(spark, tmp_path):
    rows = [(v, n, 1700000000.25 + n / 3) for v in ("a", "7", "b c%d=e") for n in range(50)]
    frames = spark.createDataFrame(rows[::-1] + [("a", 50, None)], "video_name string, frame_no long, seconds double").repartition(5)
    files.write_timestamps(frames, str(tmp_path / "t"))
    got = files.read_timestamps(spark, str(tmp_path / "t")).collect()
    assert sorted((r.video_name, r.frame_no, r.seconds) for r in got) == sorted(rows)


def test_segment_sidecars(spark, tmp_path):
    kind = "start_us long, end_us long, frame_count long, marker_mismatches long"
    segments = spark.createDataFrame([(1_700_000_000_000_000, 1_700_000_003_500_000, 40, 1), (1_700_000_100_000_000, 1_700_000_100_000_000, 1, 0)], kind)
    files.write_sidecars(segment_sidecars(segments, "thermal", 120, 160, 12.5, raw_every_n=3, rotate=90), str(tmp_path / "s"))
    first, second = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "s")).collect()), key=lambda r: r["start_time"])
    assert len(first) == 17 and first["video_file"] == "thermal_20231114_221320.mp4" and first["raw_file"] == "thermal_20231114_221320_raw.dat"
    assert first["raw_shape"] == [14, 160, 120] and first["temp_min_c"] is None and first["video_source"] == "hardware_agc"
    assert first["start_time"] == "2023-11-14T22:13:20" and first["end_time"] == "2023-11-14T22:13:23.500000"
    assert (first["duration_seconds"], first["achieved_fps"], first["marker_mismatches"]) == (3.5, 11.43, 1)
    assert (second["duration_seconds"], second["achieved_fps"]) == (0.0, 0.0)
    plain = segment_sidecars(segments, "thermal", 120, 160, 12.5, raw_every_n=None, timestamps=False, temperatures=(0.0, 40.0)).first()
    assert plain.raw_file is None and plain.raw_shape is None and plain.timestamps_file is None and plain.temp_max_c == 40.0
