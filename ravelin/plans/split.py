"""Queries over the rules of ``operators.scans`` and ``operators.groups``: what one stream or frame asks of many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import scalars
from ravelin.operators import groups, joins, scans, summary
from ravelin.plans import catalog
from ravelin.plans.catalog import CONFIG, DAY, EMA, GATE, QUARTER_DAY, Query
from ravelin.session import written
from ravelin.sources.proxies import PX1, PX5, px1, px5

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Length of the cells of time that as-of values are carried by.
AS_OF_CELL = 7 * DAY


def query(oracle: str):
    def put(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return put


_SIX = lambda x: f"floor({x} * 1e6 + 0.5) / 1e6"


@query(f"SELECT stream_id, frame_no, {_SIX('background')} AS background, {_SIX('noise')} AS noise, {_SIX('delta')} AS delta FROM ({catalog.ORACLES['ema_background']})")
def ema_background_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The averages of ``ema_background``, block by block."""
    rows = px1(spark, sf_dir).select("stream_id", "frame_no", "v")
    found = scans.noise_and_background(rows, ["stream_id"], "frame_no", "v", EMA["alpha"], EMA["noise_alpha"])
    return found.select("stream_id", "frame_no", *[scalars.half_up(F.col(c), 6).alias(c) for c in ("background", "noise", "delta")])


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, as rules read them more than once."""
    return written(px1(spark, sf_dir).select("stream_id", "frame_no", "us"))


@query(catalog.ORACLES["throttle_drift"])
def throttle_drift_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.openers(_times(spark, sf_dir), "stream_id", "frame_no", "us", QUARTER_DAY).select("stream_id", "frame_no")


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their segment's number; a stream's segments are counted from a row each."""
    rows = _times(spark, sf_dir)
    opened = scans.openings(rows, "stream_id", "us", DAY)
    number = (F.row_number().over(Window.partitionBy("stream_id").orderBy("us")) - 1).cast("long")
    return scans.as_of_cells(rows, opened.withColumn("segment", number), "stream_id", "us", ["segment"], AS_OF_CELL)


@query(catalog.ORACLES["segment_summary"])
def segment_summary_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segmented(spark, sf_dir).groupBy("stream_id", "segment").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("frame_count"))
    s = s.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / F.lit(1e6))
    return s.withColumn("achieved_fps", F.when(F.col("duration_s") > 0, F.col("frame_count") / F.col("duration_s")).otherwise(0.0))


@query(catalog.ORACLES["stats_windows"])
def stats_windows_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows are between openings; the first one counts its first row too."""
    ends = scans.openers(_times(spark, sf_dir), "stream_id", "frame_no", "us", DAY)
    w = Window.partitionBy("stream_id").orderBy("us")
    windows = ends.select("stream_id", F.lag("us").over(w).alias("start_us"), F.col("us").alias("end_us"), F.col("frame_no"), F.lag("frame_no").over(w).alias("before"))
    windows = windows.where("start_us IS NOT NULL").withColumn("frames", F.col("frame_no") - F.col("before") + F.when(F.col("before") == 0, 1).otherwise(0))
    return windows.select("stream_id", "start_us", "end_us", "frames", (F.col("frames") / ((F.col("end_us") - F.col("start_us")) / F.lit(1e6))).alias("captured_fps"))


@query(catalog.ORACLES["trigger_asof"])
def trigger_asof_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px1(spark, sf_dir)
    changes = p.where("event_type IN ('signup', 'error')").select("stream_id", "us", F.col("event_id").alias("change_id"), (F.col("event_type") == "signup").alias("active"))
    return scans.as_of_cells(p.select("stream_id", "frame_no", "us"), changes, "stream_id", "us", ["active", "change_id"], AS_OF_CELL).select("stream_id", "frame_no", "active", "change_id")


_GAP = "sqrt(greatest(a.x0 - b.x1, b.x0 - a.x1, 0)::DOUBLE * greatest(a.x0 - b.x1, b.x0 - a.x1, 0) + greatest(a.y0 - b.y1, b.y0 - a.y1, 0)::DOUBLE * greatest(a.y0 - b.y1, b.y0 - a.y1, 0))"


@query(f"""WITH RECURSIVE {PX5}, e AS (SELECT a.stream_id, a.frame_no, a.k AS a, b.k AS b FROM px5 a JOIN px5 b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no WHERE {_GAP} <= 3
    ), r AS (SELECT stream_id, frame_no, a, b FROM e UNION SELECT r.stream_id, r.frame_no, r.a, e.b FROM r JOIN e ON e.stream_id = r.stream_id AND e.frame_no = r.frame_no AND e.a = r.b
    ), root AS (SELECT stream_id, frame_no, a AS k, min(b) AS g FROM r GROUP BY ALL)
    SELECT p.stream_id, p.frame_no, dense_rank() OVER (PARTITION BY p.stream_id, p.frame_no ORDER BY g) - 1 AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
        max(mean_delta) AS mean_delta, sum(area)::BIGINT AS area FROM px5 p JOIN root USING (stream_id, frame_no, k) GROUP BY p.stream_id, p.frame_no, g""")
def merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of up to six boxes, chains of which become one."""
    return groups.merged_fragments(px5(spark, sf_dir), CONFIG.merge_gap)


_CANDIDATES = catalog._CANDIDATES.replace(catalog.PX3, PX5).replace("px3", "px5")


@query(_CANDIDATES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", q AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_no ORDER BY dist / {GATE!r}::DOUBLE - 0.5::DOUBLE * iou, t, b) AS r FROM c
    ), g AS (SELECT stream_id, frame_no, r, t, b, true AS taken, [t] AS ts, [b] AS bs FROM q WHERE r = 1
        UNION ALL SELECT q.stream_id, q.frame_no, q.r, q.t, q.b, NOT (list_contains(ts, q.t) OR list_contains(bs, q.b)),
            CASE WHEN list_contains(ts, q.t) OR list_contains(bs, q.b) THEN ts ELSE list_append(ts, q.t) END, CASE WHEN list_contains(ts, q.t) OR list_contains(bs, q.b) THEN bs ELSE list_append(bs, q.b) END
        FROM g JOIN q ON q.stream_id = g.stream_id AND q.frame_no = g.frame_no AND q.r = g.r + 1)
    SELECT stream_id, frame_no, t, b FROM g WHERE taken""")
def assoc_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to six boxes a frame contend for those of the frame before."""
    c = joins.association_candidates(px5(spark, sf_dir), GATE, CONFIG.iou_weight)
    return groups.matched(c.select(F.col("b_stream_id").alias("stream_id"), F.col("b_frame_no").alias("frame_no"), F.col("t_k").alias("t"), F.col("b_k").alias("b"), "cost"))


@query(f"""WITH {PX1}, s AS (SELECT stream_id, count(*)::DOUBLE / ((max(us) - min(us)) / {DAY}::DOUBLE) AS native, (1 + stream_id % 5)::DOUBLE AS wanted, count(*) FILTER (WHERE event_type = 'error') % 3 AS told FROM px1 GROUP BY stream_id HAVING max(us) > min(us))
    SELECT stream_id, native, native / ceil(native / wanted - 1e-9::DOUBLE) AS achieved, CASE WHEN told = 0 THEN 10.0::DOUBLE ELSE told::DOUBLE END AS rate FROM s""")
def achieved_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate that taking every n-th row of a stream gives, in rows a day; a rate of 0 counts as missing."""
    s = px1(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("span"), (F.count_if(F.col("event_type") == "error") % 3).alias("told")).where("span > 0")
    s = s.withColumn("native", F.col("n") / (F.col("span") / F.lit(float(DAY))))
    return s.select("stream_id", "native", scalars.achieved_rate(F.col("native"), (1 + F.col("stream_id") % 5).cast("double")).alias("achieved"), scalars.or_default(F.col("told").cast("double"), 10.0).alias("rate"))


@query(f"""WITH {PX1} SELECT w.stream_id, w.start_us, w.end_us, any_value(w.captured_fps) AS captured_fps, count(p.frame_no) / ((w.end_us - w.start_us) / 1e6::DOUBLE) AS detected_fps, coalesce({_SIX('avg(p.v)')}, 0.0::DOUBLE) AS mean_ms
    FROM ({catalog.ORACLES["stats_windows"]}) w LEFT JOIN (SELECT px1.* FROM px1 JOIN ({catalog.ORACLES["throttle_drift"]}) t USING (stream_id, frame_no)) p
    ON p.stream_id = w.stream_id AND p.us <= w.end_us AND (p.us > w.start_us OR p.us = w.start_us AND p.frame_no = 0) GROUP BY w.stream_id, w.start_us, w.end_us""")
def stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statistics window's captured and detected rate, and what a detection cost on average, 0 where there was none.

    What the throttle lets through is detected; its value is taken as its cost."""
    rows = written(px1(spark, sf_dir).select("stream_id", "frame_no", "us", "v"))
    ends = scans.openers(rows, "stream_id", "frame_no", "us", DAY)
    w = Window.partitionBy("stream_id").orderBy("us")
    ends = written(ends).withColumns({"start_us": F.lag("us").over(w), "before": F.lag("frame_no").over(w), "window": (F.row_number().over(w) - 2).cast("long")}).where("start_us IS NOT NULL")
    windows = ends.select("stream_id", "window", "start_us", F.col("us").alias("end_us"), (F.col("frame_no") - F.col("before") + F.when(F.col("before") == 0, 1).otherwise(0)).alias("frames"))
    detected = scans.openers(rows, "stream_id", "frame_no", "us", QUARTER_DAY, ["v"]).drop("us")
    later = ends.select("stream_id", (F.col("frame_no") + 1).alias("frame_no"), (F.col("window") + 1).alias("window"))
    placed = scans.as_of_cells(detected, later, "stream_id", "frame_no", ["window"], 4096).withColumn("window", F.coalesce("window", F.lit(0).cast("long")))
    costs = placed.groupBy("stream_id", "window").agg(F.count("*").alias("n"), F.avg("v").alias("cost"))
    seconds = (F.col("end_us") - F.col("start_us")) / F.lit(1e6)
    return windows.join(costs, ["stream_id", "window"], "left").select(
        "stream_id", "start_us", "end_us", (F.col("frames") / seconds).alias("captured_fps"), (F.coalesce("n", F.lit(0)) / seconds).alias("detected_fps"), F.coalesce(scalars.half_up(F.col("cost"), 6), F.lit(0.0)).alias("mean_ms")
    )


@query(catalog._CLIPS + """ SELECT stream_id, 'rgb_event_' || strftime(make_timestamp(opened_us), '%Y%m%d_%H%M%S') || '.avi' AS video_file, opened_us / 1e6::DOUBLE AS trigger_started_at, opened_us / 1e6::DOUBLE AS clip_started_at,
    closed_us / 1e6::DOUBLE AS clip_ended_at, floor((closed_us - opened_us) / 1e6::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS duration_seconds, frames AS frame_count, reason AS close_reason FROM clips""")
def clip_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of each clip beside its file."""
    clips = catalog.clip_sessions(spark, sf_dir).withColumn("trigger_us", F.col("opened_us"))
    return summary.clip_sidecars(clips, "rgb_event", ["stream_id"])
