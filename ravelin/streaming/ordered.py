"""Stateful streams that take a stream's frames by number, whatever the order and the micro-batches they come in.

Each rule is a processor of ``transformWithState``: its state is typed, of bounded size, in RocksDB, and checkpointed by Spark,
so a restart goes on where it was. A frame that comes early is held in a map state; a missing one is waited for until one
``horizon`` or more after it has come, then it is stepped over. Frames that come later than that, or twice, aren't silent: each
gives a row of kind ``late`` or ``repeated``.

A timer ends a stream: when nothing has come for ``patience`` (by the clock, or by event time if the rows have a time ``at``
and a watermark), what is held is taken, the rule finishes, and the state goes. What comes after is a new stream of that name.
With timers by the clock Spark runs batches for ever, so for ``availableNow`` a stream should end by event time, or not at
all (``patience`` of None: no timers, its state stays).
Rows that are behind the watermark itself are dropped by Spark, which counts them: ``late_rows``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ravelin.session import ship

#: Frames that a missing one is waited for, and milliseconds without any row.
HORIZON, PATIENCE = 100, 60_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Order:
    """Puts frames in order: ``held`` are those that are early, ``due`` is the next, ``newest`` the greatest that has come."""

    def __init__(self, horizon: int, due: int = 0, newest: int = -1, held: dict[int, Any] | None = None) -> None:
        self.horizon, self.due, self.newest, self.held = horizon, due, newest, held or {}

    def put(self, frame: int, carried: Any) -> Iterator[tuple[int, Any]]:
        """Takes a frame that is neither late nor held; gives what is next, stepping over what isn't waited for any more."""
        self.held[frame] = carried
        self.newest = max(self.newest, frame)
        while self.held and (self.due in self.held or self.due <= self.newest - self.horizon):
            if self.due in self.held:
                yield self.due, self.held.pop(self.due)
                self.due += 1
            else:
                self.due = min(min(self.held), self.newest - self.horizon + 1)

    def rest(self) -> Iterator[tuple[int, Any]]:
        """All that is held."""
        for frame in sorted(self.held):
            yield frame, self.held.pop(frame)
            self.due = frame + 1


class InOrder(StatefulProcessor):
    """A rule over frames in order. ``payload`` is what a frame carries besides its number, ``columns`` what the rule gives
    besides stream_id and kind; frame_no is among these, for late rows."""

    payload = ""
    columns = "frame_no long"
    kind = "row"

    def __init__(self, horizon: int = HORIZON, patience: int | None = PATIENCE, event_time: bool = False) -> None:
        self.horizon, self.patience, self.event_time = horizon, patience, event_time
        self.names = ["stream_id", "kind", *T._parse_datatype_string(self.columns).names]
        self.carried = T._parse_datatype_string(self.payload).names

    def open(self, handle: Any) -> None:
        """Declares the rule's own states."""

    def load(self) -> None:
        """Gets them, before rows are taken."""

    def store(self) -> None:
        """Puts them back."""

    def forget(self) -> None:
        """Clears them."""

    def take(self, frame: int, *carried: Any) -> Iterable[tuple[Any, ...]]:
        """The next frame; gives rows of ``columns``."""
        raise NotImplementedError

    def finish(self) -> Iterable[tuple[Any, ...]]:
        """The end of the stream."""
        return ()

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next_frame long, newest long, timer long")
        self.early = handle.getMapState("early", "frame_no long", self.payload)
        self.open(handle)

    def _row(self, key: tuple[Any, ...], kind: str, values: Iterable[Any]) -> Row:
        return Row(**dict(zip(self.names, (key[0], kind, *values), strict=True)))

    def _left_out(self, key: tuple[Any, ...], kind: str, frame: int) -> Row:
        return self._row(key, kind, [frame if n == "frame_no" else None for n in self.names[2:]])

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        due, newest, timer = self.place.get() if self.place.exists() else (0, -1, -1)
        stored = {int(k[0]): tuple(v) for k, v in self.early.iterator()}
        order = Order(self.horizon, due, newest, dict(stored))
        self.load()
        latest = -1
        for row in rows:
            frame = row["frame_no"]
            if self.event_time:
                latest = max(latest, row["at_ms"])
            if frame < order.due or frame in order.held:
                yield self._left_out(key, "repeated" if frame in order.held else "late", frame)
                continue
            for at, carried in order.put(frame, tuple(row[c] for c in self.carried)):
                for found in self.take(at, *carried):
                    yield self._row(key, self.kind, found)
        for frame in stored.keys() - order.held.keys():
            self.early.removeKey((frame,))
        for frame in order.held.keys() - stored.keys():
            self.early.updateValue((frame,), order.held[frame])
        self.store()
        if self.patience is None:
            self.place.update((order.due, order.newest, -1))
            return
        deadline = max(timer, latest + self.patience) if self.event_time else timerValues.getCurrentProcessingTimeInMs() + self.patience
        if timer != deadline:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(deadline)
        self.place.update((order.due, order.newest, deadline))

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.load()
        for frame, carried in sorted((int(k[0]), tuple(v)) for k, v in self.early.iterator()):
            for found in self.take(frame, *carried):
                yield self._row(key, self.kind, found)
        for found in self.finish():
            yield self._row(key, self.kind, found)
        self.early.clear()
        self.place.clear()
        self.forget()

    def close(self) -> None:
        pass


def followed(frames: DataFrame, rule: InOrder) -> DataFrame:
    """``rule`` over a streaming table with stream_id, frame_no and what the rule's frames carry; with event time also a
    timestamp ``at`` that has a watermark."""
    spark = frames.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the only one with several states a key
    # The time itself stays, as its watermark is what moves timers.
    times = [F.col("at"), F.unix_millis(F.col("at").cast("timestamp")).alias("at_ms")] if rule.event_time else []
    rows = frames.select("stream_id", "frame_no", *rule.carried, *times)
    schema = f"stream_id {frames.schema['stream_id'].dataType.simpleString()}, kind string, {rule.columns}"
    return rows.groupBy("stream_id").transformWithState(rule, schema, "Append", "None" if rule.patience is None else "EventTime" if rule.event_time else "ProcessingTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that Spark dropped for being behind the watermark, in the progress that it still holds."""
    return sum(int(state["numRowsDroppedByWatermark"]) for p in query.recentProgress for state in p["stateOperators"])
