"""Triggered clips and throttles as stateful streams; see ``ordered``."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame

from ravelin.operators.sequences import Clip
from ravelin.streaming.ordered import HORIZON, PATIENCE, InOrder, followed


class Clipped(InOrder):
    """A trigger's levels to clips. State: the open clip, and the times of the frames of the last pre-roll."""

    payload = "us long, active boolean"
    columns = "frame_no long, trigger_us long, opened_us long, first_us long, closed_us long, frames long, reason string"
    kind = "clip"

    def __init__(self, pre: int, post: int, **order: Any) -> None:
        super().__init__(**order)
        self.pre, self.post = pre, post

    def open(self, handle: Any) -> None:
        self.clip_state = handle.getValueState("clip", "held array<long>, opened array<long>, now long, last long")

    def load(self) -> None:
        self.clip, self.last = Clip(self.pre, self.post), None
        if self.clip_state.exists():
            held, opened, self.clip.now, last = self.clip_state.get()
            self.clip.held, self.clip.opened, self.last = deque(held), list(opened) or None, None if last < 0 else last

    def store(self) -> None:
        self.clip_state.update((list(self.clip.held), self.clip.opened or [], self.clip.now, -1 if self.last is None else self.last))

    def forget(self) -> None:
        self.clip_state.clear()

    def take(self, frame: int, us: int, active: bool) -> Iterator[tuple[Any, ...]]:
        self.last = us if active else self.last
        if closed := self.clip.step(us, active, self.last):
            yield frame, *closed

    def finish(self) -> Iterator[tuple[Any, ...]]:
        if closed := self.clip.close("shutdown"):
            yield None, *closed


class Throttled(InOrder):
    """Frames at most one an interval. ``catch_up`` keeps the schedule of due times unless it falls behind."""

    payload = "us long"
    columns = "frame_no long"
    kind = "taken"

    def __init__(self, interval: int, catch_up: bool, **order: Any) -> None:
        super().__init__(**order)
        self.interval, self.catch_up = interval, catch_up

    def open(self, handle: Any) -> None:
        self.due_state = handle.getValueState("due", "us long")

    def load(self) -> None:
        self.due = self.due_state.get()[0] if self.due_state.exists() else None

    def store(self) -> None:
        if self.due is not None:
            self.due_state.update((self.due,))

    def forget(self) -> None:
        self.due_state.clear()

    def take(self, frame: int, us: int) -> Iterator[tuple[Any, ...]]:
        due = us if self.due is None else self.due
        taken = us >= due or (self.catch_up and self.interval <= 0)
        if taken:
            scheduled = due + self.interval
            due = scheduled if self.catch_up and scheduled >= us else us + self.interval
            yield (frame,)
        self.due = due


def stream_clips(levels: DataFrame, pre: int, post: int, horizon: int = HORIZON, patience: int | None = PATIENCE, event_time: bool = False) -> DataFrame:
    """Clips of a streaming table (stream_id, frame_no, us, active): one is closed by its post-roll, or by the stream's end."""
    return followed(levels, Clipped(pre, post, horizon=horizon, patience=patience, event_time=event_time))


def stream_throttled(frames: DataFrame, interval: int, catch_up: bool = False, horizon: int = HORIZON, patience: int | None = PATIENCE, event_time: bool = False) -> DataFrame:
    """The frames of a streaming table (stream_id, frame_no, us) that a throttle lets through."""
    return followed(frames, Throttled(interval, catch_up, horizon=horizon, patience=patience, event_time=event_time))
