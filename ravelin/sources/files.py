"""Files of a recorder: detection caches, timestamp lists, raw planes; and what is written of results.

All go through Spark's readers and writers, so a path may be in any store that Spark reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.scalars import or_default
from ravelin.session import ship


def stem(path: Column) -> Column:
    """A file's name without folder and last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def recording(path: Column, kind: str) -> Column:
    """The recording that a file beside it belongs to: ``<recording>_<kind>`` with any last suffix, or ``<recording>`` alone."""
    return F.regexp_replace(stem(path), f"_{kind}$", "")


def read_detection_cache(spark: SparkSession, path: str, stems: list[str] | None = None) -> DataFrame:
    """A row for each frame of each cache file: video_name, fps, width, height, frame_no, boxes and error.

    fps of null or 0 is 10. A file without detections gives one row with an error; ``stems`` keeps only files of these names.
    """
    schema = "video string, fps double, width int, height int, raw array<array<string>>, error string"
    files = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("video_name", stem(F.col("_metadata.file_path")))
    if stems is not None:
        files = files.where(F.col("video_name").isin(stems))
    failed = F.coalesce("error", F.when(F.col("raw").isNull(), F.lit("no detections")))
    rows = files.select("video_name", or_default(F.col("fps"), 10.0).alias("fps"), "width", "height", failed.alias("error"), F.explode_outer("raw").alias("frame"))
    boxes = F.transform(
        F.from_json(F.get("frame", F.lit(1)), "array<array<double>>"),
        lambda b: F.struct(*[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1", "mean_delta"))], F.get(b, F.lit(5)).cast("long").alias("area")),
    )
    return rows.select("video_name", "fps", "width", "height", F.get("frame", F.lit(0)).cast("long").alias("frame_no"), boxes.alias("boxes"), "error")


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """video_name, frame_no and seconds; a file with anything but numbers gives no rows, as if it were missing.

    A file is of the video that its name tells, or its folder if ``write_timestamps`` wrote it."""
    at = F.col("_metadata.file_path")
    folder = F.url_decode(F.url_decode(F.regexp_extract(at, "/video_name=([^/]*)/[^/]*$", 1)))  # escaped in the path, and as a URI
    name = F.when(folder != "", folder).otherwise(recording(at, "timestamps"))
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(name.alias("video_name"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("words"))
    numbers = files.select("video_name", F.transform("words", lambda w: w.try_cast("double")).alias("numbers"))
    good = numbers.where(~F.exists("numbers", lambda x: x.isNull()))
    return good.select("video_name", F.posexplode("numbers").alias("frame_no", "seconds")).withColumn("frame_no", F.col("frame_no").cast("long"))


def read_raw(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """Frames of headless 16-bit files, ``<video_name>_raw`` or ``<video_name>``: video_name, frame_no, px; an incomplete last frame is dropped."""
    ship(spark)
    size = 2 * height * width

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["video_name"], files["content"]):
                for n in range(len(content) // size):
                    px = np.frombuffer(content, "<u2", height * width, n * size).astype(np.int32)
                    yield pd.DataFrame({"video_name": [name], "frame_no": [n], "px": [px]})

    files = spark.read.format("binaryFile").load(path).select(recording(F.col("path"), "raw").alias("video_name"), "content")
    return files.mapInPandas(split, "video_name string, frame_no long, px array<int>")


def raw_shapes(spark: SparkSession, path: str) -> DataFrame:
    """video_name with frames, height and width of the raw file, from the recordings' JSON."""
    files = spark.read.schema("raw_shape array<int>").option("multiLine", True).json(path)
    return files.where("raw_shape IS NOT NULL").select(stem(F.col("_metadata.file_path")).alias("video_name"), *[F.get("raw_shape", F.lit(i)).alias(n) for i, n in enumerate(("frames", "height", "width"))])


def write_events(events: DataFrame, path: str, at: Column | None = None) -> None:
    """Events as JSON lines, appended; with their time to the millisecond if ``at`` gives it in seconds."""
    rows = events if at is None else events.withColumn("timestamp", F.floor(at * 1000 + 0.5) / 1000)
    rows.write.mode("append").json(path)


def write_tracks(tracks: DataFrame, path: str) -> bool:
    """Tracks as one CSV file, best score first; nothing is written where there are none. The file is a report."""
    if tracks.isEmpty():
        return False
    tracks.orderBy(F.desc("score"), *[c for c in ("video_name", "stream_id", "track_id") if c in tracks.columns]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def write_paths(boxes: DataFrame, path: str, video: str = "stream_id") -> None:
    """A JSON line for each video: its tracks' paths by number."""
    tracks = boxes.groupBy(video, "track_id").agg(F.array_sort(F.collect_list(F.array("frame_no", "x0", "y0", "x1", "y1"))).alias("path"))
    tracks.groupBy(video).agg(F.map_from_entries(F.collect_list(F.struct(F.col("track_id").cast("string"), "path"))).alias("tracks")).write.mode("overwrite").json(path)


def write_timestamps(frames: DataFrame, path: str) -> None:
    """A file of seconds, one a line in frame order, for each video_name; null times are left out. A video is one task's."""
    times = frames.where("seconds IS NOT NULL").select("video_name", "frame_no", F.col("seconds").cast("double").cast("string").alias("value"))
    sorted_times = times.repartition("video_name").sortWithinPartitions("video_name", "frame_no")
    sorted_times.select("video_name", "value").write.mode("overwrite").partitionBy("video_name").text(path)


def write_sidecars(segments: DataFrame, path: str) -> None:
    """A JSON line for each segment of ``summary.segment_sidecars``, nulls written out."""
    segments.write.mode("append").option("ignoreNullFields", False).json(path)


def append_run_log(segments: DataFrame, path: str) -> None:
    """Segments' figures as CSV with a header in each file."""
    segments.write.mode("append").option("header", True).csv(path)
