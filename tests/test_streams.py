"""Stateful streams against the batch rules, for shuffled batches, gaps, late rows, ends by timer and restarts."""

import json
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.operators import sequences
from ravelin.operators.config import DetectorConfig, TrackConfig
from ravelin.operators.detect import Detector
from ravelin.operators.tracker import LiveTrack, Tracker, live_event
from ravelin.streaming.ordered import late_rows
from ravelin.streaming.rules import stream_clips, stream_throttled
from ravelin.streaming.sinks import print_lines, read_once, write_once
from ravelin.streaming.tracking import EVENT_COLUMNS, stamped, stream_detections, stream_events

BOXES = "stream_id long, frame_no long, last boolean, boxes array<struct<x0:double,y0:double,x1:double,y1:double,mean_delta:double,area:long>>"


def put(folder, number, rows):
    folder.mkdir(exist_ok=True)
    file = folder / f"{number:03d}.json"
    file.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(file, (1_700_000_000 + number,) * 2)  # files are taken by time


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def collected(spark, table, tmp_path, name, wait=None):
    """Rows of a streaming table; with ``wait`` the query runs until so many rows are there, for timers to fire."""
    writer = table.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}"))
    if wait is None:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination(180)
    else:
        query = writer.trigger(processingTime="200 milliseconds").start()
        until = time.time() + 90
        while spark.table(name).count() < wait and time.time() < until:
            time.sleep(0.5)
        query.stop()
    return spark.table(name).collect(), query


def put_timed(folder, parts, beat):
    """Files of rows with a time, a second a frame; then heartbeats of another stream, so that event time ends the others."""
    at = lambda second: f"2024-01-01T{second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}.000"
    for number, rows in enumerate(parts):
        put(folder, number, [r | {"at": at(r["frame_no"])} for r in rows])
    for n in (0, 1):
        put(folder, len(parts) + n, [beat | {"stream_id": 99, "frame_no": n, "at": at(80_000 + n)}])


def timed(spark, folder, schema):
    return source(spark, folder, schema + ", at timestamp").withWatermark("at", "1 hour")


def moving(stream, frames, at=lambda n: 3 * n):
    return [dict(stream_id=stream, frame_no=n, last=False, boxes=[dict(x0=at(n), y0=10, x1=at(n) + 5, y1=15, mean_delta=60.0 + n, area=25)]) for n in frames]


def test_live_tracks_have_the_figures_of_whole_ones():
    rng = np.random.default_rng(3)
    whole, live = Tracker(160, 120, TrackConfig(), 3), Tracker(160, 120, TrackConfig(), 3, LiveTrack)
    ended = [[], []]
    for n in range(300):
        boxes = [(int(x), int(y), int(x) + 6, int(y) + 5, float(d), 30) for x, y, d in zip(rng.integers(0, 150, 3), rng.integers(0, 110, 3), rng.integers(40, 90, 3))]
        for tracker, out in zip((whole, live), ended):
            out += tracker.step(n, boxes)
        live.active = [LiveTrack.of_state(t.state(), TrackConfig()) for t in live.active]
        assert all(len(t.history) == 0 for t in live.active)
    events = [[live_event(t, 10.0, DetectorConfig()) for t in out + tracker.flush()] for tracker, out in zip((whole, live), ended)]
    assert events[0] == events[1] and len(events[0]) > 20


def test_a_stream_without_a_last_row_ends_by_timer_and_leaves_no_state(spark, tmp_path):
    rows = moving(1, range(20)) + moving(2, range(10))
    rows[-1]["last"] = True  # what comes after it is followed on
    rows += moving(2, range(10, 20))
    put(tmp_path / "in", 0, rows)
    got, query = collected(spark, stream_events(source(spark, tmp_path / "in", BOXES), 160, 120, 10.0, patience=3000), tmp_path, "by_timer", wait=3)
    assert sorted((r.stream_id, r.kind, r.start_frame, r.end_frame, r.n_detections, r.frame_no) for r in got) == [(1, "event", 0, 19, 20, None), (2, "event", 0, 9, 10, 9), (2, "event", 10, 19, 10, None)]


def test_late_and_repeated_frames_are_told(spark, tmp_path):
    put_timed(tmp_path / "in", [moving(1, range(5)) + moving(1, (30, 30)), moving(1, (10, 31)) + [dict(moving(1, (32,))[0], last=True)]], dict(last=False, boxes=[]))
    got, _ = collected(spark, stream_events(timed(spark, tmp_path / "in", BOXES), 160, 120, 10.0, horizon=10, event_time=True), tmp_path, "late")
    assert sorted((r.kind, r.frame_no, r.track_id) for r in got if r.kind != "event") == [("late", 10, None), ("repeated", 30, None)]


def test_watermark_moves_timers_and_counts_what_is_behind(spark, tmp_path):
    def timed(rows, second):
        return [r | {"at": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}.000"} for r in rows]

    put(tmp_path / "in", 0, timed(moving(1, range(12)), 10))
    put(tmp_path / "in", 1, timed(moving(2, range(3)), 200))  # the watermark passes stream 1's end
    put(tmp_path / "in", 2, timed(moving(3, range(1)), 260))
    put(tmp_path / "in", 3, timed(moving(1, (12,)), 20) + timed(moving(4, (0,)), 300))  # the first is behind the watermark
    frames = source(spark, tmp_path / "in", BOXES + ", at timestamp").withWatermark("at", "10 seconds")
    got, query = collected(spark, stream_events(frames, 160, 120, 10.0, patience=30_000, event_time=True), tmp_path, "event_time")
    assert [(r.stream_id, r.start_frame, r.end_frame, r.n_detections) for r in got if r.kind == "event" and r.stream_id == 1] == [(1, 0, 11, 12)]
    assert late_rows(query) == 1


def test_detection_as_a_stream_is_that_of_batch(spark, tmp_path):
    config = DetectorConfig.of(warmup=5, min_delta=20.0, min_mean_delta=0.0, max_area_frac=0.5, morph_kernel=1, min_track_frames=2, min_event_delta=0.0)
    own = TrackConfig.of(max_dist_frac=0.4, max_age=3)
    rng = np.random.default_rng(5)
    frames, want = [], set()
    for s in (1, 2, 3):
        detector, tracker = Detector((8, 10), config), Tracker(10, 8, own, 2)
        ended = []
        for n in range(60):
            px = rng.normal(100, 1, (8, 10)).astype(np.float32).round(2)
            if n % 20 > 9:
                at = n % 20 - 10
                px[2:5, at // 2 : at // 2 + 3] += 60 + s
            if not (s == 2 and n % 17 == 3):  # stream 2 loses frames, which are stepped over
                frames.append(dict(stream_id=s, frame_no=n, last=n == 59 and s != 3, px=px.ravel().tolist()))
                ended += tracker.step(n, detector.step(px))
        want |= {(s, *(str(v) for v in e.values())) for t in ended + tracker.flush() if (e := live_event(t, 10.0, config))}
    assert len({w[0] for w in want}) == 3
    order = sorted(range(len(frames)), key=lambda i: frames[i]["frame_no"] + rng.integers(0, 9))
    put_timed(tmp_path / "in", [[frames[i] for i in order[part * 60 : (part + 1) * 60]] for part in range(3)], dict(last=False, px=[0.0] * 80))
    table = stream_detections(timed(spark, tmp_path / "in", "stream_id long, frame_no long, last boolean, px array<float>"), 10, 8, 10.0, config, own, horizon=12, event_time=True)
    got, _ = collected(spark, table, tmp_path, "detected")
    names = [c.split()[0] for c in EVENT_COLUMNS.split(", ")][1:]
    assert {(r.stream_id, *(str(r[c]) for c in names)) for r in got} == want and len(got) == len(want)


def test_clips_and_throttles_as_streams_are_those_of_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows, clips, taken = [], set(), {False: set(), True: set()}
    for s in (1, 2):
        us = np.cumsum(rng.integers(1, 40, 200)).tolist()
        active = (rng.random(200) < 0.06).tolist()
        rows += [dict(stream_id=s, frame_no=n, us=t, active=a) for n, (t, a) in enumerate(zip(us, active))]
        last, levels = None, []
        for t, a in zip(us, active):
            last = t if a else last
            levels.append((t, a, last))
        clips |= {(s, *c) for c in sequences.clips(levels, 60, 90)}
        for catch_up, rule in ((False, sequences.drift_throttle), (True, sequences.catch_up_throttle)):
            taken[catch_up] |= {(s, n) for n, x in enumerate(rule(us, 70)) if x}
    order = sorted(range(len(rows)), key=lambda i: rows[i]["frame_no"] + rng.integers(0, 30))
    put_timed(tmp_path / "in", [[rows[i] for i in order[part * 134 : (part + 1) * 134]] for part in range(3)], dict(us=0, active=False))
    schema = "stream_id long, frame_no long, us long, active boolean"
    got, _ = collected(spark, stream_clips(timed(spark, tmp_path / "in", schema), 60, 90, event_time=True), tmp_path, "clips")
    assert {(r.stream_id, r.trigger_us, r.opened_us, r.first_us, r.closed_us, r.frames, r.reason) for r in got} == clips and len(got) == len(clips) > 10
    for catch_up in (False, True):
        got, _ = collected(spark, stream_throttled(timed(spark, tmp_path / "in", schema), 70, catch_up, event_time=True).where("stream_id <> 99"), tmp_path, f"throttled_{catch_up}")
        assert {(r.stream_id, r.frame_no) for r in got} == taken[catch_up] and len(got) == len(taken[catch_up])


def test_a_killed_batch_counts_once(spark, tmp_path, monkeypatch, capsys):
    """The second batch's first run dies after its rows are written, before they are committed."""
    from ravelin.streaming import sinks

    parts = [moving(1, range(5 * part, 5 * part + 5), at=lambda n: 150 * (n // 5 % 2) + n) for part in range(3)]
    put_timed(tmp_path / "in", parts, dict(last=False, boxes=[]))
    out, put_file, killed = str(tmp_path / "out"), sinks._put, []

    def dies_once(session, path, text):
        if path.endswith("01") and not killed:
            killed.append(text)
            raise RuntimeError("killed")
        put_file(session, path, text)

    monkeypatch.setattr(sinks, "_put", dies_once)
    table = stamped(stream_events(timed(spark, tmp_path / "in", BOXES), 160, 120, 10.0, tracks=TrackConfig.of(max_age=1), event_time=True), F.lit(1.23456))
    run = lambda: write_once(table, out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination(120)
    run().awaitTermination(120)
    schema = f"stream_id long, kind string, {EVENT_COLUMNS}, timestamp double"
    got = [(r.track_id, r.start_frame, r.end_frame, r.timestamp) for r in read_once(spark, out, schema).collect()]
    assert sorted(got) == [(0, 0, 4, 1.235), (1, 5, 9, 1.235), (2, 10, 14, 1.235)]
    assert len(list((tmp_path / "out" / "data").iterdir())) > len(list((tmp_path / "out" / "commits").glob("0*")))  # the killed run's folder isn't read
    assert read_once(spark, str(tmp_path / "none"), schema).count() == 0
    print_lines(source(spark, tmp_path / "in", BOXES).select("stream_id", "frame_no")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(60)
    assert len([x for x in capsys.readouterr().out.splitlines() if x.startswith('{"stream_id"')]) == 17


def write_raw(path, frames, height=2, width=3, tail=0):
    px = np.arange(frames * height * width, dtype="<u2").reshape(frames, -1)
    path.write_bytes(px.tobytes() + b"\1" * tail)
    return px


def test_raw_recordings_are_read_by_ranges_of_frames(spark, tmp_path):
    from ravelin.sources.replay import RawReader, RawRecordings, _Options, recordings

    spark.dataSource.register(RawRecordings)
    px = write_raw(tmp_path / "b_raw.dat", 1000, tail=5)
    write_raw(tmp_path / "a.dat", 10)
    (tmp_path / "b.json").write_text(json.dumps({"raw_shape": [900, 2, 3]}))
    (tmp_path / "a.json").write_text(json.dumps({"raw_shape": [10, 2, 3]}))
    reader = spark.read.format("raw_recordings").option("path", str(tmp_path)).option("range_bytes", 1200)
    assert [(r.name, r.frames) for r in recordings(str(tmp_path), None, None)] == [("a", 10), ("b", 900)]
    shaped = reader.load()
    assert shaped.rdd.getNumPartitions() == 10 and shaped.groupBy("video_name").count().collect() is not None
    rows = {r.frame_no: r.px for r in reader.options(height=2, width=3).load().where("video_name = 'b'").collect()}
    assert [rows[n] for n in range(1000)] == px.tolist()
    with open(tmp_path / "huge_raw.dat", "wb") as huge:  # 3 GB, none of it written
        huge.truncate(3 << 30)
    parts = [p for p in RawReader(_Options({"path": str(tmp_path), "height": "120", "width": "160"})).partitions() if p.recording.name == "huge"]
    assert len(parts) == 97 and parts[-1].high == (3 << 30) // 38400 and all(a.high == b.low for a, b in zip(parts, parts[1:]))
    (tmp_path / "c.dat").write_bytes(b"1234")
    with pytest.raises(ValueError, match="c.dat"):
        recordings(str(tmp_path), None, None)


def test_raw_planes_come_back(spark, tmp_path):
    from ravelin.sources.replay import RawRecordings, write_raw

    spark.dataSource.register(RawRecordings)
    rng = np.random.default_rng(3)
    rows = [(name, n, rng.integers(0, 65536, 6).tolist()) for name, count in (("a", 50), ("b c", 7), ("d", 1)) for n in range(count)]
    frames = spark.createDataFrame(rows[::-1] + [(None, 0, [0] * 6)], "video_name string, frame_no long, px array<int>").repartition(5)
    out = str(tmp_path / "out")
    assert sorted(tuple(r) for r in write_raw(frames, out, 2, 3, every=3).collect()) == [("a", 17), ("b c", 3), ("d", 1)]
    got = spark.read.format("raw_recordings").option("path", out).load().collect()
    assert sorted((r.video_name, r.frame_no, r.px) for r in got) == sorted((name, n // 3, px) for name, n, px in rows if n % 3 == 0)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a.json", "a_raw.dat", "b c.json", "b c_raw.dat", "d.json", "d_raw.dat"]
    with pytest.raises(Exception, match="pixels"):
        write_raw(frames, out, 3, 3)


def test_replay_goes_on_where_it_was_and_stops_early(spark, tmp_path):
    from ravelin.sources.replay import RawRecordings

    spark.dataSource.register(RawRecordings)
    (tmp_path / "in").mkdir()
    for name, frames in (("a", 40), ("b", 25)):
        write_raw(tmp_path / "in" / f"{name}_raw.dat", frames)
    table = spark.readStream.format("raw_recordings").options(path=str(tmp_path / "in"), height=2, width=3, batch_frames=10, stop_after=30).load()

    def run(seconds):
        query = table.select("video_name", "frame_no").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        until = time.time() + 60
        while time.time() < until and not seconds(query):
            time.sleep(0.2)
        query.stop()

    out = lambda: sorted((r.video_name, r.frame_no) for r in spark.read.schema("video_name string, frame_no long").json(str(tmp_path / "out")).collect())
    run(lambda q: sum(p["numInputRows"] for p in q.recentProgress) >= 20)
    first = out()
    run(lambda q: len(first) + sum(p["numInputRows"] for p in q.recentProgress) >= 55)
    assert 20 <= len(first) and out() == [("a", n) for n in range(30)] + [("b", n) for n in range(25)]


def test_replay_is_paced():
    from ravelin.sources.replay import RawStreamReader, Recording

    class Own:
        rate, batch_frames = 50.0, 1000

        def recordings(self):
            return [Recording("a", "a", 1, 1, 500)]

    reader = RawStreamReader(Own())
    assert reader.latestOffset() == {"frame": 0}
    time.sleep(0.5)
    assert 20 <= reader.latestOffset()["frame"] <= 60
