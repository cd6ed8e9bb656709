"""Detection and tracking as stateful streams: the same detector and tracker as in batch, whatever the micro-batches.

See ``ordered`` for the order of frames, gaps, late rows and the end of a stream. A row with ``last`` set flushes the tracks
that are still alive at once; without one, the stream's timer does. Tracks keep figures, not their history, so a stream's
state is its live tracks, the frames that came early and, for detection, two numbers a pixel.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators.config import DetectorConfig, TrackConfig
from ravelin.operators.detect import Detector
from ravelin.operators.tracker import LIVE_STATE, LiveTrack, Tracker, live_event
from ravelin.streaming.ordered import HORIZON, PATIENCE, InOrder, Order, followed

EVENT_COLUMNS = (
    "frame_no long, track_id long, start_frame long, end_frame long, n_detections long, duration_s double, displacement_px double, "
    "path_px double, speed_px_s double, peak_frame long, peak_mean_delta double, peak_area_px long, peak_box array<int>"
)
_NAMES = [c.split()[0] for c in EVENT_COLUMNS.split(", ")][1:]
_BOX = ("x0", "y0", "x1", "y1", "mean_delta", "area")


class Follower:
    """One stream's tracker behind the order of frames, as ``Tracked`` has it, for rows that are at hand in one place."""

    def __init__(self, width: int, height: int, rate: float, detector: DetectorConfig, tracks: TrackConfig, horizon: int = HORIZON) -> None:
        self.tracker = Tracker(width, height, tracks, detector.min_track_frames, LiveTrack)
        self.order, self.rate, self.detector, self.done = Order(horizon), rate, detector, False

    @property
    def early(self) -> dict[int, Any]:
        return self.order.held

    def take(self, frame: int, boxes: list[tuple], last: bool) -> list[dict[str, Any]]:
        """Events that this frame ends; a frame seen before, or stepped over, is left out."""
        return self._ended(self.order.put(frame, (boxes, last))) if frame >= self.order.due and frame not in self.early else []

    def drain(self) -> list[dict[str, Any]]:
        """Events that the frames that are held end, gaps stepped over."""
        return self._ended(self.order.rest())

    def _ended(self, frames: Iterator[tuple[int, Any]]) -> list[dict[str, Any]]:
        ended = []
        for frame, (boxes, last) in frames:
            ended += self.tracker.step(frame, boxes)
            if last:
                ended += self.tracker.flush()
                self.done = True
        return [e for t in ended if (e := live_event(t, self.rate, self.detector))]


class Tracked(InOrder):
    """Boxes to events. ``frame_no`` is the frame at which a track ended, or null when its stream did."""

    payload = "last boolean, boxes array<struct<x0: double, y0: double, x1: double, y1: double, mean_delta: double, area: long>>"
    columns = EVENT_COLUMNS
    kind = "event"

    def __init__(self, width: int, height: int, rate: float, detector: DetectorConfig, tracks: TrackConfig, **order: Any) -> None:
        super().__init__(**order)
        self.size, self.rate, self.detector, self.config = (width, height), rate, detector, tracks

    def open(self, handle: Any) -> None:
        self.tracks = handle.getValueState("tracks", f"begun long, active array<struct<{LIVE_STATE}>>")

    def load(self) -> None:
        self.tracker = Tracker(*self.size, self.config, self.detector.min_track_frames, LiveTrack)
        if self.tracks.exists():
            self.tracker.begun, active = self.tracks.get()
            self.tracker.active = [LiveTrack.of_state(tuple(t), self.config) for t in active]

    def store(self) -> None:
        self.tracks.update((self.tracker.begun, [t.state() for t in self.tracker.active]))

    def forget(self) -> None:
        self.tracks.clear()

    def take(self, frame: int, last: bool, boxes: Any) -> Iterator[tuple[Any, ...]]:
        yield from self._events(frame, self.tracker.step(frame, [tuple(b[c] for c in _BOX) for b in boxes or []]))
        if last:
            yield from self._events(frame, self.tracker.flush())

    def finish(self) -> Iterator[tuple[Any, ...]]:
        return self._events(None, self.tracker.flush())

    def _events(self, frame: int | None, ended: list[Any]) -> Iterator[tuple[Any, ...]]:
        return ((frame, *(e[c] for c in _NAMES)) for t in ended if (e := live_event(t, self.rate, self.detector)))


class Detected(Tracked):
    """Pixels to events."""

    payload = "last boolean, px array<float>"

    def open(self, handle: Any) -> None:
        super().open(handle)
        self.scene = handle.getValueState("scene", "frames long, background array<float>, noise array<float>")

    def load(self) -> None:
        super().load()
        shape = self.size[1], self.size[0]
        self.seen = Detector(shape, self.detector)
        if self.scene.exists():
            self.seen.frames, background, noise = self.scene.get()
            self.seen.background, self.seen.noise = (np.array(x, np.float32).reshape(shape) for x in (background, noise))

    def store(self) -> None:
        super().store()
        if self.seen.background is not None:
            self.scene.update((self.seen.frames, *(x.ravel().tolist() for x in (self.seen.background, self.seen.noise))))

    def forget(self) -> None:
        super().forget()
        self.scene.clear()

    def take(self, frame: int, last: bool, px: Any) -> Iterator[tuple[Any, ...]]:
        found = self.seen.step(np.asarray(px, np.float32).reshape(self.size[1], self.size[0]))
        yield from self._events(frame, self.tracker.step(frame, [(*map(float, b[:5]), int(b[5])) for b in found]))
        if last:
            yield from self._events(frame, self.tracker.flush())


def stream_events(
    frames: DataFrame, width: int, height: int, rate: float, detector: DetectorConfig = DetectorConfig(), tracks: TrackConfig = TrackConfig(),
    horizon: int = HORIZON, patience: int | None = PATIENCE, event_time: bool = False,
) -> DataFrame:
    """Events of a streaming frame table (stream_id, frame_no, last, boxes: x0, y0, x1, y1, mean_delta, area).

    Rows of kind ``event``, and of kinds ``late`` and ``repeated`` with the number of a frame that was left out."""
    return followed(frames, Tracked(width, height, rate, detector, tracks, horizon=horizon, patience=patience, event_time=event_time))


def stream_detections(
    frames: DataFrame, width: int, height: int, rate: float, detector: DetectorConfig = DetectorConfig(), tracks: TrackConfig = TrackConfig(),
    horizon: int = HORIZON, patience: int | None = PATIENCE, event_time: bool = False,
) -> DataFrame:
    """As ``stream_events``, from pixels: (stream_id, frame_no, last, px in row order)."""
    frames = frames.withColumn("px", F.col("px").cast("array<float>"))
    return followed(frames, Detected(width, height, rate, detector, tracks, horizon=horizon, patience=patience, event_time=event_time))


def stamped(events: DataFrame, at: Column) -> DataFrame:
    """Events with the time of their emission in seconds, to the millisecond, as a live log has it."""
    return events.withColumn("timestamp", F.floor(at * 1000 + 0.5) / 1000)
