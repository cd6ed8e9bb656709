"""Raw recordings as a data source: read whole by byte ranges, or replayed as a stream.

    spark.dataSource.register(RawRecordings)
    spark.read.format("raw_recordings").options(path=..., height=120, width=160).load()
    spark.readStream.format("raw_recordings").options(path=..., rate=12.5, stop_after=1000).load()

A recording is a headless file of 16-bit frames, ``<video_name>_raw.dat`` or ``<video_name>.dat``. Height and width are those of
the options, or of ``raw_shape`` in the recording's JSON sidecar. Recordings are listed in the order of their names. A task
reads a range of bytes that begins and ends with a frame, of about ``range_bytes``, so one large file is read by many tasks; an
incomplete last frame is left out. Files are read by Arrow's file systems: local ones, HDFS, S3 and others that a URI names.

As a stream all recordings are replayed side by side by frame number. Its offset is the number of frames due: at ``rate``
frames a second of the clock since the stream began (0: as fast as batches run), at most ``batch_frames`` more a batch, and
at most ``stop_after`` (0: all). A stream that starts again from its checkpoint goes on where it was.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ravelin.session import written

SCHEMA = "video_name string, frame_no long, px array<int>"
RANGE_BYTES, BATCH_FRAMES, FRAMES_OUT = 32 << 20, 1000, 64


@dataclass
class Recording:
    name: str
    path: str
    height: int
    width: int
    frames: int


@dataclass
class Range(InputPartition):
    """Frames from ``low`` up to, not including, ``high``."""

    recording: Recording
    low: int
    high: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def recordings(path: str, height: int | None, width: int | None, shape_frames: bool = True) -> list[Recording]:
    """By name. A file without a known shape is a ValueError; a shape's number of frames bounds what is read."""
    store, root = _opened(path)
    found = []
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.base_name):
        if not info.is_file or not info.base_name.endswith(".dat"):
            continue
        name = info.base_name.removesuffix(".dat").removesuffix("_raw")
        most, h, w = None, height, width
        if h is None or w is None:
            sidecar = f"{info.path.removesuffix(info.base_name)}{name}.json"
            if store.get_file_info(sidecar).type != fs.FileType.File:
                raise ValueError(f"{info.base_name}: height and width must be given where there is no sidecar")
            with store.open_input_stream(sidecar) as held:
                most, h, w = json.loads(held.read())["raw_shape"]
        frames = info.size // (2 * h * w)
        found.append(Recording(name, info.path, h, w, frames if most is None else min(frames, most)))
    return found


def ranges(recording: Recording, low: int, high: int, range_bytes: int) -> list[Range]:
    """Ranges of whole frames, each of about ``range_bytes``."""
    step = max(1, range_bytes // (2 * recording.height * recording.width))
    high = min(high, recording.frames)
    return [Range(recording, at, min(at + step, high)) for at in range(low, high, step)]


def read_range(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    store, _ = _opened(path)
    r = part.recording
    pixels = r.height * r.width
    with store.open_input_file(r.path) as file:
        file.seek(2 * pixels * part.low)
        for low in range(part.low, part.high, FRAMES_OUT):
            n = min(FRAMES_OUT, part.high - low)
            px = np.frombuffer(file.read(2 * pixels * n), "<u2").astype(np.int32)
            n = len(px) // pixels
            if n:
                lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * pixels, pixels, dtype=np.int32), pa.array(px[: n * pixels]))
                yield pa.RecordBatch.from_arrays([pa.array([r.name] * n), pa.array(np.arange(low, low + n)), lists], names=["video_name", "frame_no", "px"])


class _Options:
    def __init__(self, options: Any) -> None:
        number = lambda name, default: int(options.get(name, default))
        self.path = options["path"]
        self.height, self.width = (number(n, 0) or None for n in ("height", "width"))
        self.range_bytes, self.batch_frames, self.stop_after = number("range_bytes", RANGE_BYTES), number("batch_frames", BATCH_FRAMES), number("stop_after", 0)
        self.rate = float(options.get("rate", 0))

    def recordings(self) -> list[Recording]:
        found = recordings(self.path, self.height, self.width)
        for r in found:
            r.frames = min(r.frames, self.stop_after or r.frames)
        return found


class RawReader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [p for r in self.options.recordings() for p in ranges(r, 0, r.frames, self.options.range_bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_range(self.options.path, partition)  # type: ignore[arg-type]


class RawStreamReader(DataSourceStreamReader):
    def __init__(self, options: _Options) -> None:
        self.options = options
        self.began: tuple[float, int] | None = None  # when and at which frame this run began
        self.due = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = max((r.frames for r in self.options.recordings()), default=0)
        due = min(last, self.due + self.options.batch_frames)
        if self.options.rate > 0:
            if self.began is None:
                self.began = time.monotonic(), self.due
            due = min(due, self.began[1] + int((time.monotonic() - self.began[0]) * self.options.rate))
        self.due = max(self.due, due)
        return {"frame": self.due}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.due = max(self.due, end["frame"])
        return [p for r in self.options.recordings() for p in ranges(r, start["frame"], end["frame"], self.options.range_bytes)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_range(self.options.path, partition)  # type: ignore[arg-type]

    def commit(self, end: dict) -> None:
        self.due = max(self.due, end["frame"])

    def stop(self) -> None:
        pass


class RawRecordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RawReader(_Options(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return RawStreamReader(_Options(self.options))


def write_raw(frames: DataFrame, path: str, height: int, width: int, every: int = 1) -> DataFrame:
    """Writes ``<video_name>_raw.dat`` and its ``<video_name>.json`` with ``raw_shape`` of each video of (video_name, frame_no,
    px), in frame order; of the frames that a video has, the first and each ``every``-th after it. Gives video_name and frames.

    A video is one task's, which holds a batch of frames. It writes beside the file and moves it there at the end, so a task
    that is run again, or twice, leaves a whole file. Names with a slash are a ValueError, frames of another size too."""
    pixels = height * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(path)
        store.create_dir(root, recursive=True)
        name, out, held, seen, kept = None, None, "", 0, 0

        def end() -> pa.RecordBatch:
            out.close()
            store.move(held, f"{root}/{name}_raw.dat")
            with store.open_output_stream(f"{root}/{name}.json") as sidecar:
                sidecar.write(json.dumps({"raw_shape": [kept, height, width]}).encode("utf-8"))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([kept])], names=["video_name", "frames"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, own in enumerate(names):
                if own != name:
                    if "/" in own:
                        raise ValueError(f"{own}: a video's name can't hold a slash")
                    if name is not None:
                        yield end()
                    name, held, seen, kept = own, f"{root}/.{own}-{uuid.uuid4().hex}", 0, 0
                    out = store.open_output_stream(held)
                if seen % every == 0:
                    px = batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                    if len(px) != pixels:
                        raise ValueError(f"{own}: a frame of {len(px)} pixels")
                    out.write(px.astype("<u2").tobytes())
                    kept += 1
                seen += 1
        if name is not None:
            yield end()

    rows = frames.where(F.col("video_name").isNotNull()).select("video_name", "px", "frame_no").repartition("video_name").sortWithinPartitions("video_name", "frame_no")
    return written(rows.select("video_name", "px").mapInArrow(run, "video_name string, frames long"))
