"""Rules that follow one stream in order: averages, throttles, segments, statistics windows, triggered clips.

Each is a plain generator over a stream's rows, so batch and streaming share it; ``fold`` runs one a stream in Spark. Such
rules are sequential within a stream, so the number of streams is the parallelism; none of them holds a whole stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice, tee
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ravelin.session import ship

#: Rows that ``fold`` gives out at a time.
CHUNK_ROWS = 4096


def running_averages(values: Iterable[float], alpha: float, noise_alpha: float, warmup: int, least: float, k: float, cap: float) -> Iterator[tuple[float, float, float, bool]]:
    """For each value: background and noise before it, its rise, and whether it is hot."""
    background, noise = None, 1.0
    for n, x in enumerate(values, 1):
        background = x if background is None else background
        delta = x - background
        yield background, noise, delta, n > warmup and delta > max(least, k * min(noise, cap))
        noise = noise + noise_alpha * (abs(delta) - noise)
        background = background + alpha * delta


def drift_throttle(times: Iterable[int], interval: int) -> Iterator[bool]:
    """Accepts at or after the due time; the next is due an interval after acceptance."""
    due = None
    for t in times:
        taken = due is None or t >= due
        yield taken
        if taken:
            due = (t if due is None else max(t, due)) + interval


def catch_up_throttle(times: Iterable[int], interval: int) -> Iterator[bool]:
    """As above, but due times keep their schedule unless they fall behind."""
    due = None
    for t in times:
        due = t if due is None else due
        taken = interval <= 0 or t >= due
        yield taken
        if taken:
            due += interval
            if due < t:
                due = t + interval


def segments(times: Iterable[int], length: int) -> Iterator[int]:
    """Number of each row's segment: a new one opens at the first row that is ``length`` after the open one's first."""
    opened, number = None, -1
    for t in times:
        if opened is None or t >= opened + length:
            opened, number = t, number + 1
        yield number


def statistics_windows(times: Iterable[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, rows) of each window, which is given out at the first row ``length`` or more after its start."""
    start, rows = None, 0
    for t in times:
        start = t if start is None else start
        rows += 1
        if t - start >= length:
            yield start, t, rows
            start, rows = t, 0


@dataclass
class Clip:
    """The clip of a stream while it goes on, and the times of the last ``pre``."""

    pre: int
    post: int
    held: deque[int] = field(default_factory=deque)
    opened: list[int] | None = None  # trigger, opened, first frame's time, frames
    now: int = 0

    def step(self, t: int, active: bool, last: int | None) -> tuple[int, int, int, int, int, str] | None:
        """Takes a row: its time, whether the trigger is active and when it was so last. Gives the clip that it closes."""
        self.now = t
        self.held.append(t)
        while t - self.held[0] > self.pre:
            self.held.popleft()
        if self.opened is None:
            if active:
                self.opened = [last if last is not None else t, t, self.held[0], len(self.held)]
            return None
        self.opened[3] += 1
        return self.close("post-roll elapsed") if not active and last is not None and t - last >= self.post else None

    def close(self, why: str) -> tuple[int, int, int, int, int, str] | None:
        if self.opened is None:
            return None
        trigger, opened, first, frames = self.opened
        self.opened = None
        return trigger, opened, first, self.now, frames, why


def clips(rows: Iterable[tuple[int, bool, int | None]], pre: int, post: int) -> Iterator[tuple[int, int, int, int, int, str]]:
    """From (time, active, last active time): (trigger, opened, first frame's time, closed, frames, why) of each clip.

    A clip opens at an active row and takes the rows of the last ``pre`` too; it closes at the first inactive row that is
    ``post`` or more after the last activity, or when the rows end.
    """
    clip = Clip(pre, post)
    for row in rows:
        if closed := clip.step(*row):
            yield closed
    if closed := clip.close("shutdown"):
        yield closed


def beside(rows: Iterable[tuple], rule: Callable[..., Iterator[Any]], *args: Any, **named: Any) -> Iterator[tuple[Any, Any]]:
    """From rows (name, value): each name with what ``rule`` gives for its value, a value at a time."""
    names, values = tee(rows)
    return zip((r[0] for r in names), rule((r[1] for r in values), *args, **named))


def fold(df: DataFrame, keys: str | list[str], order: list[str], step: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``step`` on each stream's rows, in order.

    ``step`` takes an iterator of tuples of the columns other than ``keys``, as ``df`` has them, and yields tuples of those of
    ``schema``, which begins with the keys. Spark sorts, so a task holds an Arrow batch, what is given out next and what
    ``step`` itself keeps, however long a stream is. Null keys are streams too."""
    ship(df.sparkSession)
    keys = [keys] if isinstance(keys, str) else keys
    known = len(keys)
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        made = ((*stream, *found) for stream, own in groupby(rows, lambda r: r[:known]) for found in step(r[known:] for r in own))
        while chunk := list(islice(made, CHUNK_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), arrow.types)], schema=arrow)

    ordered = df.select(*keys, *[c for c in df.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInArrow(run, out)
