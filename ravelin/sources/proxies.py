"""Sensor streams made from the bundled tables: the inputs on which the operators run here.

PX-1 a scalar stream a user, PX-2 8x8 frames, PX-3 boxes of a moving object, PX-4 track histories of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 160, 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, frame_no, us, v, event_id, event_type, cnt3."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("stream_id").orderBy("us", "event_id")
    rows = e.select(
        F.col("user_id").alias("stream_id"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("v")
    ).withColumn("frame_no", (F.row_number().over(w) - 1).cast("long"))
    lost = F.sum(F.when((F.col("event_id") % 7 == 0) & (F.col("frame_no") > 0), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cnt3", F.pmod(40 * (F.col("frame_no") + 3 * lost), F.lit(2048)).cast("long"))


def px2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, frame_no, vec_id, px (doubles)."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("stream_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_no"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("px")
    )


def px2_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a pixel: stream_id, frame_no, vec_id, i, e, raw16."""
    p = px2(spark, sf_dir).select("stream_id", "frame_no", "vec_id", F.posexplode("px").alias("i", "e"))
    return p.withColumn("i", F.col("i").cast("long")).withColumn("raw16", (19081 + F.floor(F.col("e") * 1280)).cast("long"))


def px3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, frame_no, k (order within the frame), x0, y0, x1, y1, mean_delta, area."""
    p = px1(spark, sf_dir).where("event_type <> 'error'")
    main = p.selectExpr(
        "stream_id", "frame_no", "event_type", "v",
        "(3 * frame_no + stream_id) % 140 AS x0", "(2 * frame_no + 7 * stream_id) % 100 AS y0", "4 + event_id % 9 AS bw", "4 + event_id % 7 AS bh",
    )
    return main.selectExpr(
        "stream_id", "frame_no",
        """inline(concat(
            array(named_struct('k', 0L, 'x0', x0, 'y0', y0, 'x1', x0 + bw, 'y1', y0 + bh, 'mean_delta', v, 'area', bw * bh)),
            IF(event_type = 'click', array(named_struct('k', 1L, 'x0', x0 + bw + 2, 'y0', y0, 'x1', x0 + bw + 5, 'y1', y0 + 3, 'mean_delta', v / 2, 'area', 9L)), array()),
            IF(event_type = 'signup', array(named_struct('k', 1L, 'x0', 150L, 'y0', 110L, 'x1', 156L, 'y1', 116L, 'mean_delta', 40D, 'area', 36L)), array())))""",
    )


def px4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main boxes with the track that they are given to, of at least three boxes."""
    p = px3(spark, sf_dir).where("k = 0").withColumn("track_id", F.floor(F.col("frame_no") / 12).cast("long"))
    return p.withColumn("boxes", F.count("*").over(Window.partitionBy("stream_id", "track_id"))).where("boxes >= 3").drop("boxes", "k")


def px5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of up to six boxes, in which boxes often form chains: columns as of ``px3``, a frame for each six of a stream."""
    p = px1(spark, sf_dir).where("event_type <> 'error'")
    return p.selectExpr(
        "stream_id", "frame_no div 6 AS frame_no", "frame_no % 6 AS k", "v", "4 + event_id % 9 AS bw", "4 + event_id % 7 AS bh",
        "(10 * (frame_no % 6) + event_id % 7 + stream_id) % 130 AS x0", "12 * (event_id % 3) + stream_id % 60 AS y0",
    ).selectExpr("stream_id", "frame_no", "k", "x0", "y0", "x0 + bw AS x1", "y0 + bh AS y1", "v AS mean_delta", "bw * bh AS area")


#: The same in DuckDB's SQL, as common table expressions.
PX1 = """px1 AS (
    SELECT *, ((40 * (frame_no + 3 * lost)) % 2048)::BIGINT AS cnt3 FROM (
        SELECT *, sum(CASE WHEN event_id % 7 = 0 AND frame_no > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY us, event_id)::BIGINT AS lost FROM (
            SELECT user_id AS stream_id, event_id, event_type, epoch_us(ts) AS us, value AS v,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no
            FROM events)))"""
PX2 = """px2 AS (
    SELECT label::BIGINT AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, vec_id, embedding FROM embeddings
), pixels AS (
    SELECT stream_id, frame_no, vec_id, i, e, (19081 + floor(e * 1280))::BIGINT AS raw16
    FROM (SELECT stream_id, frame_no, vec_id, i, embedding[i + 1]::DOUBLE AS e FROM px2, (SELECT unnest(generate_series(0, 63)) AS i)))"""
PX3 = (
    PX1
    + """, m AS (
    SELECT stream_id, frame_no, event_type, v, (3 * frame_no + stream_id) % 140 AS x0, (2 * frame_no + 7 * stream_id) % 100 AS y0,
           4 + event_id % 9 AS bw, 4 + event_id % 7 AS bh
    FROM px1 WHERE event_type <> 'error'
), px3 AS (
    SELECT stream_id, frame_no, 0::BIGINT AS k, x0, y0, x0 + bw AS x1, y0 + bh AS y1, v AS mean_delta, bw * bh AS area FROM m
    UNION ALL SELECT stream_id, frame_no, 1, x0 + bw + 2, y0, x0 + bw + 5, y0 + 3, v / 2, 9 FROM m WHERE event_type = 'click'
    UNION ALL SELECT stream_id, frame_no, 1, 150, 110, 156, 116, 40, 36 FROM m WHERE event_type = 'signup')"""
)
PX4 = (
    PX3
    + """, px4 AS (
    SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY stream_id, track_id) AS boxes FROM (SELECT *, frame_no // 12 AS track_id FROM px3 WHERE k = 0)) WHERE boxes >= 3)"""
)
PX5 = (
    PX1
    + """, px5 AS (
    SELECT stream_id, frame_no, k, x0, y0, x0 + bw AS x1, y0 + bh AS y1, v AS mean_delta, bw * bh AS area FROM (
        SELECT stream_id, frame_no // 6 AS frame_no, frame_no % 6 AS k, v, 4 + event_id % 9 AS bw, 4 + event_id % 7 AS bh,
               (10 * (frame_no % 6) + event_id % 7 + stream_id) % 130 AS x0, 12 * (event_id % 3) + stream_id % 60 AS y0
        FROM px1 WHERE event_type <> 'error'))"""
)
