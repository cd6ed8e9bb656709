"""The offline job: detection caches to graded tracks with their video's name and start time, and its reports."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.scalars import iso_utc
from ravelin.operators.config import TrackConfig
from ravelin.operators.sequences import fold
from ravelin.operators.tracker import summarise, track_frames
from ravelin.session import written
from ravelin.sources import files

_NUMBERS = {"duration_s", "displacement_px", "path_px", "speed_px_s", "edge_frac", "continuity", "median_box_px", "peak_mean_delta", "score"}
_NAMES = (
    "track_id", "confidence", "start_frame", "end_frame", "n_detections", "duration_s", "displacement_px", "path_px", "speed_px_s", "edge_frac", "continuity",
    "median_box_px", "peak_frame", "peak_mean_delta", "peak_area_px",
)
_CORNERS = ("peak_x_min", "peak_y_min", "peak_x_max", "peak_y_max")
_ORDER = ["video_name", *_NAMES[:6], "start_time", *_NAMES[6:], *_CORNERS, "score"]


def tracks_of_caches(cached: DataFrame, timestamps: DataFrame, config: TrackConfig = TrackConfig()) -> tuple[DataFrame, DataFrame]:
    """Graded tracks and their boxes from ``files.read_detection_cache`` and ``files.read_timestamps``.

    One video is followed in order; videos are the parallelism. A file with an error gives no tracks; a track has a start
    time if its video's timestamps reach its first frame."""
    kind = ", ".join(f"{n} {'string' if n == 'confidence' else 'double' if n in _NUMBERS else 'long'}" for n in _NAMES)
    schema = f"video_name string, {kind}, {', '.join(f'{c} long' for c in _CORNERS)}, score double, path array<array<long>>"

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        first = next(rows)
        width, height, rate = int(first[1]), int(first[2]), float(first[3])
        frames = ((n, [(*(b[c] for c in ("x0", "y0", "x1", "y1", "mean_delta")), int(b["area"])) for b in boxes]) for n, *_, boxes in chain([first], rows))
        for t in track_frames(frames, width, height, config):
            if r := summarise(t, rate, width, height, config):
                yield *(r[c] for c in _NAMES), *r["peak_box"], r["score"], [[n, *map(int, b[:4])] for n, b in t.history]

    rows = cached.where("error IS NULL AND boxes IS NOT NULL").select("video_name", "frame_no", "width", "height", "fps", "boxes")
    own = written(fold(rows, "video_name", ["frame_no"], step, schema))  # tracked once, for the tracks and their boxes
    times = timestamps.select(F.col("video_name").alias("v"), F.col("frame_no").alias("f"), iso_utc(F.col("seconds")).alias("start_time"))
    timed = own.join(times, (F.col("video_name") == F.col("v")) & (F.col("start_frame") == F.col("f")), "left")
    boxes = own.select("video_name", "track_id", F.explode("path").alias("b"))
    return timed.select(*_ORDER), boxes.select("video_name", "track_id", *[F.get("b", F.lit(i)).alias(c) for i, c in enumerate(("frame_no", "x0", "y0", "x1", "y1"))])


def run(spark: SparkSession, caches: str, timestamps: str, out: str, config: TrackConfig = TrackConfig(), stems: list[str] | None = None) -> DataFrame:
    """The job: tracks as CSV, paths as JSON, and the tracks."""
    tracks, boxes = tracks_of_caches(files.read_detection_cache(spark, caches, stems), files.read_timestamps(spark, timestamps), config)
    if files.write_tracks(tracks, f"{out}/tracks"):
        files.write_paths(boxes, f"{out}/paths", "video_name")
    return tracks
