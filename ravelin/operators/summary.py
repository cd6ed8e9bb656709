"""Track summaries as aggregations: events, graded tracks, tiers and ranks. No Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.scalars import file_stamp, half_up, iso_utc
from ravelin.operators.config import TierRule, TrackConfig


def _shapes(boxes: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """One row a track. A peak is the first box, in frame order, of the greatest rise times area."""
    w = Window.partitionBy(*keys).orderBy("frame_no")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    steps = boxes.withColumns({"cx": cx, "cy": cy}).withColumns(
        {"dx": F.col("cx") - F.lag("cx").over(w), "dy": F.col("cy") - F.lag("cy").over(w), "ox": F.col("cx") - F.first("cx").over(w), "oy": F.col("cy") - F.first("cy").over(w)}
    )
    peak = F.max_by(F.struct("frame_no", "x0", "y0", "x1", "y1"), F.struct(F.col("mean_delta") * F.col("area"), -F.col("frame_no")))
    length = lambda x, y: F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    return (
        steps.groupBy(*keys)
        .agg(
            F.min("frame_no").alias("start_frame"), F.max("frame_no").alias("end_frame"), F.count("*").alias("n_detections"),
            F.max(length("ox", "oy")).alias("displacement"), F.coalesce(F.sum(length("dx", "dy")), F.lit(0.0)).alias("path"),
            F.max("mean_delta").alias("delta"), F.max("area").alias("peak_area_px"), peak.alias("peak"),
            F.count_if(F.col("edge")).alias("edges") if "edge" in boxes.columns else F.lit(0).cast("long").alias("edges"),
            F.median((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("median_box_px"),
        )
        .withColumn("seconds", (F.col("end_frame") - F.col("start_frame")) / F.lit(float(rate)))
        .withColumn("speed", F.col("path") / F.greatest("seconds", F.lit(0.5)))
    )


def event_summary(boxes: DataFrame, keys: list[str], rate: float, least: float) -> DataFrame:
    """Events whose greatest rise, unrounded, is at least ``least``."""
    s = _shapes(boxes, keys, rate).where(F.col("delta") >= least)
    return s.select(
        *keys, "start_frame", "end_frame", "n_detections", half_up(F.col("seconds"), 2).alias("duration_s"), half_up(F.col("displacement"), 1).alias("displacement_px"),
        half_up(F.col("path"), 1).alias("path_px"), half_up(F.col("speed"), 2).alias("speed_px_s"), F.col("peak.frame_no").alias("peak_frame"),
        half_up(F.col("delta"), 2).alias("peak_mean_delta"), "peak_area_px", *[F.col(f"peak.{c}").alias(f"peak_{c}") for c in ("x0", "y0", "x1", "y1")],
    )


def track_summary(boxes: DataFrame, keys: list[str], rate: float, width: int, height: int, config: TrackConfig) -> DataFrame:
    """Graded tracks; those whose greatest rise, rounded to two places, is below the least are left out."""
    edge = (F.col("x0") <= 0) | (F.col("y0") <= 0) | (F.col("x1") >= width) | (F.col("y1") >= height)
    s = _shapes(boxes.withColumn("edge", edge), keys, rate).where(half_up(F.col("delta"), 2) >= config.min_track_delta)
    s = s.withColumn("edge_frac", F.col("edges") / F.col("n_detections"))
    frame = float(width * height)

    def passes(rule: TierRule) -> Column:
        return (
            (F.col("delta") >= rule.delta) & (F.col("displacement") >= rule.displacement) & (F.col("speed") >= rule.speed) & (F.col("peak_area_px") / frame >= rule.area_frac)
            & (F.col("edge_frac") <= config.max_edge_frac) & (F.col("median_box_px") / frame >= config.min_median_box_frac)
        )

    score = F.col("delta") * F.sqrt(F.col("peak_area_px").cast("double")) * (1 + F.col("displacement") / 20)
    return s.select(
        *keys, F.when(passes(config.high), "high").when(passes(config.medium), "medium").otherwise("low").alias("confidence"),
        "start_frame", "end_frame", "n_detections", half_up(F.col("seconds"), 2).alias("duration_s"), half_up(F.col("displacement"), 1).alias("displacement_px"),
        half_up(F.col("path"), 1).alias("path_px"), half_up(F.col("speed"), 2).alias("speed_px_s"), half_up(F.col("edge_frac"), 2).alias("edge_frac"),
        half_up(F.col("n_detections") / (F.col("end_frame") - F.col("start_frame") + 1), 2).alias("continuity"), half_up(F.col("median_box_px").cast("double"), 1).alias("median_box_px"),
        F.col("peak.frame_no").alias("peak_frame"), half_up(F.col("delta"), 2).alias("peak_mean_delta"), "peak_area_px",
        *[F.col(f"peak.{c}").alias(f"peak_{c}") for c in ("x0", "y0", "x1", "y1")], half_up(score, 1).alias("score"),
    )


def tier_summary(tracks: DataFrame, video: str) -> DataFrame:
    """Tracks and distinct videos of each tier, tiers without any too."""
    tiers = tracks.sparkSession.createDataFrame([("high",), ("medium",), ("low",)], "confidence string")
    found = tracks.groupBy("confidence").agg(F.count("*").alias("tracks"), F.countDistinct(video).alias("videos"))
    return tiers.join(found, "confidence", "left").select("confidence", F.coalesce("tracks", F.lit(0)).alias("tracks"), F.coalesce("videos", F.lit(0)).alias("videos"))


def segment_sidecars(
    segments: DataFrame,
    prefix: str,
    height: int,
    width: int,
    fps: float,
    suffix: str = "mp4",
    raw_every_n: int | None = 1,
    timestamps: bool = True,
    rotate: int = 0,
    temperatures: tuple[float, float] | None = None,
) -> DataFrame:
    """What is told of each segment beside its files, from (start_us, end_us, frame_count, marker_mismatches).

    ``raw_every_n`` of None keeps no raw planes; without ``temperatures`` the camera's own gain makes the picture. A segment
    of no duration has a rate of 0."""
    own = F.concat(F.lit(prefix + "_"), file_stamp(F.col("start_us")))
    seconds = (F.col("end_us") - F.col("start_us")) / F.lit(1e6)
    if rotate in (90, 270):
        height, width = width, height
    raw = raw_every_n is not None
    low, high = temperatures or (None, None)
    shape = F.array(F.ceil(F.col("frame_count") / F.lit(raw_every_n or 1)).cast("long"), F.lit(height).cast("long"), F.lit(width).cast("long"))
    local = lambda c: F.regexp_replace(iso_utc(F.col(c) / F.lit(1e6)), r"\+00:00$", "")
    return segments.select(
        F.concat(own, F.lit("." + suffix)).alias("video_file"),
        (F.concat(own, F.lit("_raw.dat")) if raw else F.lit(None).cast("string")).alias("raw_file"),
        F.lit("uint16" if raw else None).cast("string").alias("raw_dtype"),
        F.lit(raw_every_n).cast("long").alias("raw_every_n"),
        (shape if raw else F.lit(None).cast("array<long>")).alias("raw_shape"),
        (F.concat(own, F.lit("_timestamps.txt")) if timestamps else F.lit(None).cast("string")).alias("timestamps_file"),
        F.lit(rotate).alias("rotate_degrees"),
        F.lit("fixed_temp_range" if temperatures else "hardware_agc").alias("video_source"),
        F.lit(low).cast("double").alias("temp_min_c"),
        F.lit(high).cast("double").alias("temp_max_c"),
        local("start_us").alias("start_time"),
        local("end_us").alias("end_time"),
        half_up(seconds, 2).alias("duration_seconds"),
        "frame_count",
        F.lit(float(fps)).alias("target_fps"),
        F.when(seconds > 0, half_up(F.col("frame_count") / seconds, 2)).otherwise(0.0).alias("achieved_fps"),
        "marker_mismatches",
    )


def clip_sidecars(clips: DataFrame, prefix: str, keys: list[str], suffix: str = "avi") -> DataFrame:
    """What is told of each clip beside its file, from (trigger_us, opened_us, closed_us, frames, reason); times in seconds."""
    seconds = lambda c: F.col(c) / F.lit(1e6)
    return clips.select(
        *keys, F.concat(F.lit(prefix + "_"), file_stamp(F.col("opened_us")), F.lit("." + suffix)).alias("video_file"), seconds("trigger_us").alias("trigger_started_at"),
        seconds("opened_us").alias("clip_started_at"), seconds("closed_us").alias("clip_ended_at"), half_up((F.col("closed_us") - F.col("opened_us")) / F.lit(1e6), 2).alias("duration_seconds"),
        F.col("frames").alias("frame_count"), F.col("reason").alias("close_reason"),
    )
