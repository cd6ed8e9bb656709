"""The registered queries over sensor streams, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations


from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import frames, scalars
from ravelin.operators import joins, sequences, summary
from ravelin.operators.config import MODELS, DetectorConfig, TrackConfig, model_geometry
from ravelin.operators.detect import Detector, blobs, open_and_close
from ravelin.operators.tracker import Track, Tracker, associate, live_event, merge_fragments, summarise, track_frames
from ravelin.session import ship
from ravelin.sources.proxies import HEIGHT, PX1, PX2, PX3, PX4, WIDTH, px1, px2, px2_pixels, px3, px4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RATE = 10.0
CONFIG = TrackConfig()
GATE = CONFIG.max_dist_frac * float(np.hypot(WIDTH, HEIGHT))
#: Frames that are kept so that an event's peak can be saved.
CACHED_FRAMES = 400
DAY, HALF_DAY, QUARTER_DAY = 86_400_000_000, 43_200_000_000, 21_600_000_000
EMA = {"alpha": 0.02, "noise_alpha": 0.01, "warmup": 10, "least": 22.0, "k": 6.0, "cap": 18.0}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


# Scalars over pixels


@query(f"""WITH {PX2} SELECT vec_id, i, raw16, raw16 / 64.0::DOUBLE AS kelvin, raw16 / 64.0::DOUBLE - 273.15::DOUBLE AS celsius,
    trunc((raw16 / 64.0::DOUBLE - 273.15::DOUBLE + 273.15::DOUBLE) * 64.0::DOUBLE)::INTEGER AS back FROM pixels""")
def temp_celsius(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scalars.raw_to_celsius(F.col("raw16"))
    return px2_pixels(spark, sf_dir).select("vec_id", "i", "raw16", scalars.raw_to_kelvin(F.col("raw16")).alias("kelvin"), c.alias("celsius"), scalars.celsius_to_raw(c).alias("back"))


@query(f"""WITH {PX2}, k AS (SELECT vec_id, i, raw16 / 64.0::DOUBLE AS k, CASE i % 4 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em FROM pixels)
    SELECT vec_id, i, em AS emissivity, CASE WHEN em >= 1 OR em <= 0 THEN k ELSE sqrt(sqrt(greatest((k*k*k*k - (1.0::DOUBLE - em) * ((25.0::DOUBLE + 273.15::DOUBLE)*(25.0::DOUBLE + 273.15::DOUBLE)*(25.0::DOUBLE + 273.15::DOUBLE)*(25.0::DOUBLE + 273.15::DOUBLE))) / em, 0.0::DOUBLE))) END - 273.15::DOUBLE AS celsius FROM k""")
def temp_emissivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = F.element_at(F.array(F.lit(0.95), F.lit(0.5), F.lit(1.0), F.lit(0.0)), (F.col("i") % 4 + 1).cast("int"))
    return px2_pixels(spark, sf_dir).withColumn("emissivity", em).select("vec_id", "i", "emissivity", scalars.raw_to_celsius_corrected(F.col("raw16"), F.col("emissivity"), F.lit(25.0)).alias("celsius"))


@query(f"""WITH {PX2} SELECT vec_id, i, floor(least(greatest((raw16 - 18441) * 255.0::DOUBLE / (19721 - 18441), 0.0::DOUBLE), 255.0::DOUBLE))::INTEGER AS level FROM pixels""")
def fixed_range_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = (scalars.celsius_to_raw(F.lit(c)) for c in (15.0, 35.0))
    return px2_pixels(spark, sf_dir).select("vec_id", "i", scalars.fixed_range(F.col("raw16"), low, high).alias("level"))


@query(f"""WITH {PX2} SELECT p.vec_id, d AS degrees, i, p.embedding[1 + CASE d WHEN 90 THEN (7 - i % 8) * 8 + i // 8 WHEN 180 THEN 63 - i ELSE (i % 8) * 8 + 7 - i // 8 END]::DOUBLE AS e
    FROM px2 p, (SELECT unnest([90, 180, 270]) AS d), (SELECT unnest(generate_series(0, 63)) AS i)""")
def frame_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.explode(F.array(*[F.struct(F.lit(d).alias("degrees"), frames.rotate(F.col("px"), 8, 8, d).alias("px")) for d in (90, 180, 270)]))
    return px2(spark, sf_dir).select("vec_id", turned.alias("t")).select("vec_id", "t.degrees", F.posexplode("t.px").alias("i", "e")).withColumn("i", F.col("i").cast("long"))


@query(f"WITH {PX2} SELECT vec_id, i, CASE WHEN i >= 48 THEN 0.0::DOUBLE ELSE e END AS e FROM pixels")
def mask_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px2(spark, sf_dir).select("vec_id", F.posexplode(frames.mask_bottom(F.col("px"), 8, 8, 2)).alias("i", "e")).withColumn("i", F.col("i").cast("long"))


@query(f"""WITH {PX2}, b AS (SELECT vec_id, min(e) AS lo, max(e) AS hi FROM pixels GROUP BY vec_id)
    SELECT p.vec_id, i, CASE WHEN hi > lo THEN floor((e - lo) * 255.0::DOUBLE / (hi - lo))::INTEGER ELSE 0 END AS level FROM pixels p JOIN b USING (vec_id)""")
def snapshot_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px2(spark, sf_dir).select("vec_id", F.posexplode(frames.min_max_normalised(F.col("px"))).alias("i", "level")).withColumn("i", F.col("i").cast("long"))


@query(f"""WITH {PX2}, r AS (SELECT vec_id, frame_no, CASE WHEN frame_no % 5 = 0 THEN 143 ELSE 144 END AS words FROM px2)
    SELECT vec_id, count(*) FILTER (WHERE i < 64 AND words = 144) AS thermal_px, sum(CASE WHEN words = 144 THEN (i + 80 + vec_id) % 65536 END)::BIGINT AS thermal_sum,
           sum((i + vec_id) % 256)::BIGINT AS brightness_sum
    FROM r, (SELECT unnest(generate_series(0, 63)) AS i) GROUP BY vec_id, words""")
def plane_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw frames of 8x8 sensors: 144 words each, every fifth one short."""
    size = F.when(F.col("frame_no") % 5 == 0, 143).otherwise(144)
    raw = px2(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), size - 1), lambda i: ((i + F.col("vec_id")) % 65536).cast("int")).alias("words"))
    thermal, bright = frames.thermal_plane(F.col("words"), 8, 8), frames.brightness_plane(F.col("words"), 8, 8)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    return raw.select("vec_id", F.coalesce(F.size(thermal), F.lit(0)).cast("long").alias("thermal_px"), total(thermal).alias("thermal_sum"), total(bright).alias("brightness_sum"))


# Commands, markers and strings

_LE = lambda x, n: [f"(({x}) >> {8 * i}) & 255" for i in range(n)]


def _crc_sql(data: list[str], source: str, keep: str) -> str:
    """Unrolled, a byte a step."""
    sql = f"SELECT {keep}, 0 AS crc, {', '.join(f'({b})::BIGINT AS b{i}' for i, b in enumerate(data))} FROM {source}"
    for i in range(len(data)):
        sql = f"SELECT * REPLACE ((((crc << 8) & 65535) ^ ((x << 12) & 65535) ^ (x << 5) ^ x) & 65535 AS crc) FROM (SELECT *, xor(y, y >> 4) & 255 AS x FROM (SELECT * EXCLUDE (x, y), xor(crc >> 8, b{i}) AS y FROM (SELECT *, 0 AS x, 0 AS y FROM ({sql}))))".replace(
            "(((crc << 8) & 65535) ^ ((x << 12) & 65535) ^ (x << 5) ^ x)", "xor(xor((crc << 8) & 65535, (x << 12) & 65535), xor(x << 5, x))"
        )
        sql = f"SELECT * EXCLUDE (x, y) FROM ({sql})"
    return sql


@query(f"SELECT event_id, crc::INTEGER AS crc FROM ({_crc_sql(_LE('event_id', 8), 'events', 'event_id')})")
def crc16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px1(spark, sf_dir).select("event_id", scalars.crc16(scalars.little_endian(F.col("event_id"), 8)).alias("crc"))


_COMMAND = _LE("257", 2) + _LE("129", 2) + _LE("event_id % 65536", 2) + ["0"] * 8 + _LE("user_id % 65536", 2)


@query(
    "SELECT event_id, "
    + " || ".join(f"lower(lpad(to_hex(b{i}), 2, '0'))" for i in range(16))
    + f" || lower(lpad(to_hex(crc & 255), 2, '0')) || lower(lpad(to_hex(crc >> 8), 2, '0')) AS command FROM ({_crc_sql(_COMMAND, 'events', 'event_id')})"
)
def command_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px1(spark, sf_dir)
    return p.select("event_id", scalars.build_command(F.lit(257), F.lit(129), F.col("event_id") % 65536, F.col("stream_id") % 65536).alias("command"))


@query(f"""WITH {PX1}, m AS (SELECT event_id, frame_no, cnt3, CASE WHEN event_id % 11 = 0 THEN frame_no + 1 ELSE frame_no END AS cnt1_end FROM px1)
    SELECT event_id, 12 AS length, frame_no AS cnt1, frame_no * 2 AS cnt2, cnt3, frame_no <> cnt1_end AS mismatch FROM m""")
def marker_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end markers of a frame as bytes, decoded and held against each other."""
    p = px1(spark, sf_dir)
    pack = lambda c: F.unhex(scalars.hex_of([F.lit(12), F.lit(1)] + scalars.little_endian(c, 4) + scalars.little_endian(F.col("frame_no") * 2, 4) + scalars.little_endian(F.col("cnt3"), 2)))
    raw = p.select("event_id", pack(F.col("frame_no")).alias("a"), pack(F.when(F.col("event_id") % 11 == 0, F.col("frame_no") + 1).otherwise(F.col("frame_no"))).alias("b"))
    field = lambda m, at, n: F.conv(F.concat(*[F.hex(F.substring(m, at + n - i, 1)) for i in range(n)]), 16, 10).cast("long")
    return raw.select(
        "event_id", field("a", 0, 1).cast("int").alias("length"), field("a", 2, 4).alias("cnt1"), field("a", 6, 4).alias("cnt2"), field("a", 10, 2).alias("cnt3"),
        (field("a", 2, 4) != field("b", 2, 4)).alias("mismatch"),
    )


@query("SELECT event_id, event_type || '-' || event_id AS name FROM events")
def register_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px1(spark, sf_dir).select("event_id", F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"), F.lit("\u0007\u0000\u0000")).alias("raw"))
    return p.select("event_id", scalars.clean(F.col("raw")).alias("name"))


def model_config(spark: SparkSession) -> DataFrame:
    """The sensor models' geometry: a table of fixed values, to be looked up."""
    rows = [(m, w, h, *[model_geometry(w, h)[k] for k in ("frame_rows", "frame_size", "frame_read_size")]) for m, (_, w, h) in MODELS.items()]
    return spark.createDataFrame(rows, "model string, width long, height long, frame_rows long, frame_size long, frame_read_size long")


@query(f"""WITH {PX1} SELECT event_id, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%g') AS shown, strftime(make_timestamp(us), '%Y%m%d_%H%M%S') AS file,
    strftime(make_timestamp(us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM px1""")
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.col("us")
    return px1(spark, sf_dir).select("event_id", scalars.display_stamp(us).alias("shown"), scalars.file_stamp(us).alias("file"), scalars.iso_utc(F.floor(us / 1000000).cast("double")).alias("iso"))


@query(f"""WITH {PX1} SELECT event_id, '{{"event_id":' || event_id || ',"event_type":"' || event_type || '","frame_no":' || frame_no || '}}' AS line, event_id AS back FROM px1""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px1(spark, sf_dir).select("event_id", F.to_json(F.struct("event_id", "event_type", "frame_no")).alias("line"))
    return p.withColumn("back", F.from_json("line", "event_id long")["event_id"])


# One stream in order


@query(f"""WITH {PX1}, d AS (SELECT stream_id, frame_no, ((cnt3 - lag(cnt3) OVER (PARTITION BY stream_id ORDER BY frame_no) - 40) % 2048 + 2048) % 2048 AS d FROM px1)
    SELECT stream_id, count(*) AS frames, coalesce(sum(CASE WHEN d > 20 AND d < 2008 THEN d // 40 ELSE 0 END), 0)::BIGINT AS dropped FROM d GROUP BY stream_id""")
def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("frame_no")
    d = px1(spark, sf_dir).withColumn("d", F.pmod(F.col("cnt3") - F.lag("cnt3").over(w) - 40, F.lit(2048)))
    lost = F.when((F.col("d") > 20) & (F.col("d") < 2008), F.floor(F.col("d") / 40)).otherwise(0)
    return d.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum(lost).cast("long").alias("dropped"))


@query(f"""WITH RECURSIVE {PX1}, f AS (
        SELECT stream_id, frame_no, v AS b, 1.0::DOUBLE AS n, 0.0::DOUBLE AS d, v FROM px1 WHERE frame_no = 0
        UNION ALL SELECT p.stream_id, p.frame_no, f.b + 0.02::DOUBLE * f.d, f.n + 0.01::DOUBLE * (abs(f.d) - f.n), p.v - (f.b + 0.02::DOUBLE * f.d), p.v FROM f JOIN px1 p ON p.stream_id = f.stream_id AND p.frame_no = f.frame_no + 1)
    SELECT stream_id, frame_no, b AS background, n AS noise, d AS delta, frame_no >= 10 AND d > greatest(22.0::DOUBLE, 6.0::DOUBLE * least(n, 18.0::DOUBLE)) AS hot FROM f""")
def ema_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((frame, *found) for frame, found in sequences.beside(rows, sequences.running_averages, **EMA))

    return sequences.fold(px1(spark, sf_dir).select("stream_id", "frame_no", "v"), "stream_id", ["frame_no"], step, "stream_id long, frame_no long, background double, noise double, delta double, hot boolean")


def _throttled(spark: SparkSession, sf_dir: str, rule: Callable, interval: int) -> DataFrame:
    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((frame,) for frame, taken in sequences.beside(rows, rule, interval) if taken)

    return sequences.fold(px1(spark, sf_dir).select("stream_id", "frame_no", "us"), "stream_id", ["frame_no"], step, "stream_id long, frame_no long")


@query(f"""WITH RECURSIVE {PX1}, f AS (
        SELECT stream_id, frame_no, true AS taken, us + {QUARTER_DAY} AS due FROM px1 WHERE frame_no = 0
        UNION ALL SELECT p.stream_id, p.frame_no, p.us >= f.due, CASE WHEN p.us >= f.due THEN greatest(p.us, f.due) + {QUARTER_DAY} ELSE f.due END FROM f JOIN px1 p ON p.stream_id = f.stream_id AND p.frame_no = f.frame_no + 1)
    SELECT stream_id, frame_no FROM f WHERE taken""")
def throttle_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _throttled(spark, sf_dir, sequences.drift_throttle, QUARTER_DAY)


@query(f"""WITH RECURSIVE {PX1}, f AS (
        SELECT stream_id, frame_no, true AS taken, us + {QUARTER_DAY} AS due FROM px1 WHERE frame_no = 0
        UNION ALL SELECT p.stream_id, p.frame_no, p.us >= f.due, CASE WHEN p.us < f.due THEN f.due WHEN f.due + {QUARTER_DAY} < p.us THEN p.us + {QUARTER_DAY} ELSE f.due + {QUARTER_DAY} END FROM f JOIN px1 p ON p.stream_id = f.stream_id AND p.frame_no = f.frame_no + 1)
    SELECT stream_id, frame_no FROM f WHERE taken""")
def throttle_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _throttled(spark, sf_dir, sequences.catch_up_throttle, QUARTER_DAY)


_SEGMENTS = f"""WITH RECURSIVE {PX1}, f AS (
        SELECT stream_id, frame_no, us, us AS opened, 0::BIGINT AS segment FROM px1 WHERE frame_no = 0
        UNION ALL SELECT p.stream_id, p.frame_no, p.us, CASE WHEN p.us >= f.opened + {DAY} THEN p.us ELSE f.opened END, f.segment + CASE WHEN p.us >= f.opened + {DAY} THEN 1 ELSE 0 END FROM f JOIN px1 p ON p.stream_id = f.stream_id AND p.frame_no = f.frame_no + 1)"""


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        return ((*own, segment) for own, segment in sequences.beside(((r, r[1]) for r in rows), sequences.segments, DAY))

    return sequences.fold(px1(spark, sf_dir).select("stream_id", "frame_no", "us"), "stream_id", ["frame_no"], step, "stream_id long, frame_no long, us long, segment long")


@query(_SEGMENTS + """ SELECT stream_id, segment, min(us) AS start_us, max(us) AS end_us, count(*) AS frame_count, (max(us) - min(us)) / 1e6::DOUBLE AS duration_s,
    CASE WHEN max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1e6::DOUBLE) ELSE 0.0::DOUBLE END AS achieved_fps FROM f GROUP BY stream_id, segment""")
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segmented(spark, sf_dir).groupBy("stream_id", "segment").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("frame_count"))
    s = s.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / F.lit(1e6))
    return s.withColumn("achieved_fps", F.when(F.col("duration_s") > 0, F.col("frame_count") / F.col("duration_s")).otherwise(0.0))


@query(_SEGMENTS + """ SELECT stream_id, frame_no, segment, n AS raw_index FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, segment ORDER BY frame_no) - 1 AS n FROM f) WHERE n % 3 = 0""")
def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third written frame of a segment gets its raw plane kept."""
    n = F.row_number().over(Window.partitionBy("stream_id", "segment").orderBy("frame_no")) - 1
    return _segmented(spark, sf_dir).withColumn("raw_index", n.cast("long")).where("raw_index % 3 = 0").select("stream_id", "frame_no", "segment", "raw_index")


@query(f"""WITH RECURSIVE {PX1}, f AS (
        SELECT stream_id, frame_no, us AS began, us, 1::BIGINT AS n, false AS out, us AS start_us, 0::BIGINT AS rows_ FROM px1 WHERE frame_no = 0
        UNION ALL SELECT p.stream_id, p.frame_no, CASE WHEN p.us - f.began >= {DAY} THEN p.us ELSE f.began END, p.us, CASE WHEN p.us - f.began >= {DAY} THEN 0 ELSE f.n + 1 END, p.us - f.began >= {DAY}, f.began, f.n + 1 FROM f JOIN px1 p ON p.stream_id = f.stream_id AND p.frame_no = f.frame_no + 1)
    SELECT stream_id, start_us, us AS end_us, rows_ AS frames, rows_ / ((us - start_us) / 1e6::DOUBLE) AS captured_fps FROM f WHERE out""")
def stats_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        return sequences.statistics_windows((us for _, us in rows), DAY)

    s = sequences.fold(px1(spark, sf_dir).select("stream_id", "frame_no", "us"), "stream_id", ["frame_no"], step, "stream_id long, start_us long, end_us long, frames long")
    return s.withColumn("captured_fps", F.col("frames") / ((F.col("end_us") - F.col("start_us")) / F.lit(1e6)))


@query(f"""WITH {PX1}, g AS (SELECT *, frame_no - row_number() OVER (PARTITION BY stream_id, event_type = 'error' ORDER BY frame_no) AS island FROM px1)
    SELECT stream_id, min(frame_no) AS first_frame, count(*) AS length, count(*) >= 2 AS reconnect FROM g WHERE event_type = 'error' GROUP BY stream_id, island""")
def error_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of failed frames; here a run of two or more makes a reconnection."""
    rank = F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_no"))
    e = px1(spark, sf_dir).where("event_type = 'error'").withColumn("island", F.col("frame_no") - rank)
    return e.groupBy("stream_id", "island").agg(F.min("frame_no").alias("first_frame"), F.count("*").alias("length"), (F.count("*") >= 2).alias("reconnect")).drop("island")


@query(f"WITH {PX1} SELECT stream_id, frame_no, count(*) OVER (PARTITION BY stream_id ORDER BY us RANGE BETWEEN {HALF_DAY} PRECEDING AND CURRENT ROW) AS held FROM px1")
def preroll_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream_id").orderBy("us").rangeBetween(-HALF_DAY, 0)
    return px1(spark, sf_dir).select("stream_id", "frame_no", F.count("*").over(w).alias("held"))


@query(f"WITH {PX1} SELECT stream_id, max(frame_no) AS frame_no, arg_max(event_id, frame_no) AS event_id, arg_max(v, frame_no) AS v FROM px1 GROUP BY stream_id")
def latest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px1(spark, sf_dir).groupBy("stream_id").agg(F.max("frame_no").alias("frame_no"), F.max_by("event_id", "frame_no").alias("event_id"), F.max_by("v", "frame_no").alias("v"))


@query(f"WITH {PX1} SELECT stream_id, floor(avg(v) * 1e6 + 0.5) / 1e6 AS mean_ms, quantile_cont(v, 0.99) AS p99_ms, floor(1000.0 / avg(v) / 10.0 * 1e6 + 0.5) / 1e6 AS headroom FROM px1 GROUP BY stream_id")
def cost_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg("v")
    return px1(spark, sf_dir).groupBy("stream_id").agg(scalars.half_up(mean, 6).alias("mean_ms"), F.percentile("v", 0.99).alias("p99_ms"), scalars.half_up(1000.0 / mean / RATE, 6).alias("headroom"))


@query(f"""WITH {PX1}, b AS (SELECT stream_id, us // {DAY} AS block, median(v) AS med FROM px1 GROUP BY ALL)
    SELECT stream_id, block, any_value(med) AS median, median(abs(v - med)) AS mad FROM (SELECT p.stream_id, us // {DAY} AS block, v, med FROM px1 p JOIN b ON p.stream_id = b.stream_id AND us // {DAY} = b.block) GROUP BY stream_id, block""")
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream_id", "block")
    p = px1(spark, sf_dir).withColumn("block", F.floor(F.col("us") / DAY)).withColumn("med", F.expr("percentile(v, 0.5)").over(w))
    return p.groupBy("stream_id", "block").agg(F.first("med").alias("median"), F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))


@query(f"WITH {PX1} SELECT stream_id, count(*) AS frames_read, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_id % 11 = 0) AS marker_mismatches FROM px1 GROUP BY stream_id")
def frame_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px1(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("frames_read"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_id") % 11 == 0).alias("marker_mismatches"))


# Pixels and blobs


@query(f"WITH {PX2} SELECT vec_id, count(*) FILTER (WHERE e > 0.10::DOUBLE) AS hot, max(e) AS top FROM pixels GROUP BY vec_id")
def hot_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px2(spark, sf_dir).select("vec_id", F.size(F.filter("px", lambda x: x > 0.10)).cast("long").alias("hot"), F.array_max("px").alias("top"))


_BLOBS = f"""WITH RECURSIVE {PX2}, h AS (SELECT vec_id, stream_id, frame_no, i, i // 8 AS y, i % 8 AS x, e FROM pixels WHERE e > 0.10::DOUBLE
    ), r AS (SELECT vec_id, i, i AS root FROM h UNION SELECT r.vec_id, b.i, r.root FROM r JOIN h a ON a.vec_id = r.vec_id AND a.i = r.i JOIN h b ON b.vec_id = a.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
    ), l AS (SELECT vec_id, i, min(root) AS root FROM r GROUP BY vec_id, i
    ), blob AS (SELECT h.vec_id, root, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area, floor(avg(e) * 1e6 + 0.5) / 1e6 AS mean_delta FROM h JOIN l USING (vec_id, i) GROUP BY h.vec_id, root)"""


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for rows in batches:
            out = []
            for key, px in zip(rows["vec_id"], rows["px"]):
                e = np.asarray(px, float).reshape(8, 8)
                mask = e > 0.10
                for x0, y0, x1, y1, mean, area in blobs(mask, e):
                    out.append((key, x0, y0, x1, y1, area, np.floor(mean * 1e6 + 0.5) / 1e6))
            yield pd.DataFrame(out, columns=["vec_id", "x0", "y0", "x1", "y1", "area", "mean_delta"])

    ship(spark)
    return px2(spark, sf_dir).select("vec_id", "px").mapInPandas(run, "vec_id long, x0 long, y0 long, x1 long, y1 long, area long, mean_delta double")


@query(_BLOBS + " SELECT vec_id, x0, y0, x1, y1, area, mean_delta FROM blob")
def frame_blob_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blobs(spark, sf_dir)


@query(_BLOBS + ", k AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS n FROM blob WHERE area BETWEEN 3 AND 12 AND mean_delta >= 0) SELECT vec_id, x0, y0, x1, y1, area, mean_delta FROM k WHERE n <= 3")
def frame_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of 3 to 12 pixels; frames with more than three of them give none."""
    kept = _blobs(spark, sf_dir).where("area BETWEEN 3 AND 12 AND mean_delta >= 0")
    return kept.withColumn("n", F.count("*").over(Window.partitionBy("vec_id"))).where("n <= 3").drop("n")


_NEAR = "(abs(a.x - b.x) + abs(a.y - b.y) <= 1)"
_STEP = lambda name, of, how: f"{name} AS (SELECT a.vec_id, a.i, a.x, a.y, {how}(b.m) AS m FROM {of} a JOIN {of} b ON a.vec_id = b.vec_id AND {_NEAR} GROUP BY ALL)"


@query(f"""WITH {PX2}, m0 AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y, e > 0.0::DOUBLE AS m FROM pixels), {_STEP("m1", "m0", "bool_and")}, {_STEP("m2", "m1", "bool_or")}, {_STEP("m3", "m2", "bool_or")}, {_STEP("m4", "m3", "bool_and")}
    SELECT vec_id, count(*) FILTER (WHERE m) AS hot, coalesce(sum(CASE WHEN m THEN i END), 0)::BIGINT AS places FROM m4 GROUP BY vec_id""")
def frame_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and closing of the positive pixels with a 3 by 3 ellipse."""

    def run(batches):
        for rows in batches:
            masks = [np.flatnonzero(open_and_close(np.asarray(px, float).reshape(8, 8) > 0.0, 3)) for px in rows["px"]]
            yield pd.DataFrame({"vec_id": rows["vec_id"], "hot": [len(m) for m in masks], "places": [int(m.sum()) for m in masks]})

    ship(spark)
    return px2(spark, sf_dir).select("vec_id", "px").mapInPandas(run, "vec_id long, hot long, places long")


# Boxes


@query(f"""WITH {PX3} SELECT a.stream_id, a.frame_no, a.k AS a, b.k AS b, sqrt(dx * dx + dy * dy) AS gap FROM px3 a JOIN px3 b ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no AND a.k < b.k,
    LATERAL (SELECT greatest(a.x0 - b.x1, b.x0 - a.x1, 0)::DOUBLE AS dx, greatest(a.y0 - b.y1, b.y0 - a.y1, 0)::DOUBLE AS dy) WHERE sqrt(dx * dx + dy * dy) <= 3""")
def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.near_pairs(px3(spark, sf_dir), 3.0).select(F.col("a_stream_id").alias("stream_id"), F.col("a_frame_no").alias("frame_no"), F.col("a_k").alias("a"), F.col("b_k").alias("b"), "gap")


_MERGED = f"""WITH {PX3}, root AS (SELECT b.stream_id, b.frame_no, b.k, min(a.k) AS g FROM px3 b JOIN px3 a ON a.stream_id = b.stream_id AND a.frame_no = b.frame_no AND a.k <= b.k
        AND sqrt(greatest(a.x0 - b.x1, b.x0 - a.x1, 0)::DOUBLE * greatest(a.x0 - b.x1, b.x0 - a.x1, 0) + greatest(a.y0 - b.y1, b.y0 - a.y1, 0)::DOUBLE * greatest(a.y0 - b.y1, b.y0 - a.y1, 0)) <= 3 GROUP BY ALL)"""


_BOX = ["x0", "y0", "x1", "y1", "mean_delta", "area"]


def _merge_frame(rows: Iterator[tuple]) -> Iterator[tuple]:
    return ((n, *b) for n, b in enumerate(merge_fragments([r[1:] for r in rows], CONFIG.merge_gap)))


# A frame has two boxes at most here, so its groups are its pairs.
@query(_MERGED + """ SELECT p.stream_id, p.frame_no, dense_rank() OVER (PARTITION BY p.stream_id, p.frame_no ORDER BY g) - 1 AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
    max(mean_delta) AS mean_delta, sum(area)::BIGINT AS area FROM px3 p JOIN root r USING (stream_id, frame_no, k) GROUP BY p.stream_id, p.frame_no, g""")
def merge_fragment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fold(px3(spark, sf_dir).select("stream_id", "frame_no", "k", *_BOX), ["stream_id", "frame_no"], ["k"], _merge_frame, "stream_id long, frame_no long, n long, x0 long, y0 long, x1 long, y1 long, mean_delta double, area long")


_CANDIDATES = f"""WITH {PX3}, c AS (SELECT b.stream_id, b.frame_no, t.k AS t, b.k AS b, sqrt(dx * dx + dy * dy) AS dist,
        CASE WHEN un > 0 THEN common / un ELSE 0.0::DOUBLE END AS iou
    FROM px3 t JOIN px3 b ON t.stream_id = b.stream_id AND t.frame_no + 1 = b.frame_no,
    LATERAL (SELECT (b.x0 + b.x1) / 2.0::DOUBLE - (t.x0 + t.x1) / 2.0::DOUBLE AS dx, (b.y0 + b.y1) / 2.0::DOUBLE - (t.y0 + t.y1) / 2.0::DOUBLE AS dy,
        (greatest(least(t.x1, b.x1) - greatest(t.x0, b.x0), 0) * greatest(least(t.y1, b.y1) - greatest(t.y0, b.y0), 0))::DOUBLE AS common),
    LATERAL (SELECT (t.x1 - t.x0) * (t.y1 - t.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - common AS un) WHERE sqrt(dx * dx + dy * dy) <= {GATE!r}::DOUBLE)"""


@query(_CANDIDATES + f" SELECT stream_id, frame_no, t, b, dist, dist / {GATE!r}::DOUBLE - 0.5::DOUBLE * iou AS cost FROM c")
def assoc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = joins.association_candidates(px3(spark, sf_dir), GATE, CONFIG.iou_weight)
    return c.select(F.col("b_stream_id").alias("stream_id"), F.col("b_frame_no").alias("frame_no"), F.col("t_k").alias("t"), F.col("b_k").alias("b"), "dist", "cost")


@query(_CANDIDATES + " SELECT p.stream_id, p.frame_no, p.k FROM px3 p ANTI JOIN c ON p.stream_id = c.stream_id AND p.frame_no = c.frame_no AND p.k = c.b")
def unmatched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = assoc_candidates(spark, sf_dir).select("stream_id", "frame_no", F.col("b").alias("k"))
    return px3(spark, sf_dir).select("stream_id", "frame_no", "k").join(c, ["stream_id", "frame_no", "k"], "left_anti")


# At most two boxes a frame: the cheapest pair goes first, then the pair of what is left.
@query(_CANDIDATES + f""", q AS (SELECT *, dist / {GATE!r}::DOUBLE - 0.5::DOUBLE * iou AS cost FROM c), a AS (SELECT *, row_number() OVER (PARTITION BY stream_id, frame_no ORDER BY cost, t, b) AS r FROM q),
    one AS (SELECT * FROM a WHERE r = 1), two AS (SELECT a.*, row_number() OVER (PARTITION BY a.stream_id, a.frame_no ORDER BY a.cost, a.t, a.b) AS s FROM a JOIN one o USING (stream_id, frame_no) WHERE a.t <> o.t AND a.b <> o.b)
    SELECT stream_id, frame_no, t, b FROM one UNION ALL SELECT stream_id, frame_no, t, b FROM two WHERE s = 1""")
def assoc_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's boxes matched to those of the frame before, cheapest pair first, each used once."""

    # A box is one of its own frame, and goes to the next as what is followed.
    frames = F.explode(F.array(F.struct(F.lit(0).alias("old"), F.col("frame_no").alias("frame")), F.struct(F.lit(1).alias("old"), (F.col("frame_no") + 1).alias("frame"))))
    rows = px3(spark, sf_dir).select("stream_id", frames.alias("at"), "k", *_BOX).select("stream_id", F.col("at.frame").alias("frame_no"), "at.old", "k", *_BOX)

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        boxes: tuple[list, list] = [], []
        for old, _, *box in rows:
            boxes[old].append(tuple(box))
        tracks = [Track.begin(i, 0, b, CONFIG) for i, b in enumerate(boxes[1])]
        return ((t, b) for b, t in associate(tracks, boxes[0], CONFIG, float(np.hypot(WIDTH, HEIGHT))).items())

    return sequences.fold(rows, ["stream_id", "frame_no"], ["old", "k"], step, "stream_id long, frame_no long, t long, b long")


_KALMAN = f"""WITH RECURSIVE {PX3}, z AS (SELECT p.stream_id, p.frame_no, x0 IS NOT NULL AS seen, (x0 + x1) / 2.0::DOUBLE AS zx, (y0 + y1) / 2.0::DOUBLE AS zy FROM px1 p LEFT JOIN px3 b ON p.stream_id = b.stream_id AND p.frame_no = b.frame_no AND b.k = 0
    ), f0 AS (SELECT stream_id, min(frame_no) AS first FROM z WHERE seen GROUP BY stream_id
    ), f AS (SELECT z.stream_id, z.frame_no, zx AS x, zy AS y, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 6.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 100.0::DOUBLE AS p11 FROM z JOIN f0 ON z.stream_id = f0.stream_id AND z.frame_no = f0.first
        UNION ALL SELECT z.stream_id, z.frame_no, CASE WHEN seen THEN px + a00 / s * (zx - px) ELSE px END, CASE WHEN seen THEN py + a00 / s * (zy - py) ELSE py END,
            CASE WHEN seen THEN vx + a01 / s * (zx - px) ELSE vx END, CASE WHEN seen THEN vy + a01 / s * (zy - py) ELSE vy END,
            CASE WHEN seen THEN (1 - a00 / s) * a00 ELSE a00 END, CASE WHEN seen THEN (1 - a00 / s) * a01 ELSE a01 END, CASE WHEN seen THEN a11 - a01 / s * a01 ELSE a11 END
        FROM (SELECT *, x + vx AS px, y + vy AS py, p00 + 2 * p01 + p11 + 4.0::DOUBLE AS a00, p01 + p11 AS a01, p11 + 4.0::DOUBLE AS a11, p00 + 2 * p01 + p11 + 4.0::DOUBLE + 6.0::DOUBLE AS s FROM f) f JOIN z ON z.stream_id = f.stream_id AND z.frame_no = f.frame_no + 1)"""


@query(_KALMAN + " SELECT stream_id, frame_no, floor(x * 1e6 + 0.5) / 1e6 AS x, floor(y * 1e6 + 0.5) / 1e6 AS y, floor(p00 * 1e6 + 0.5) / 1e6 AS p00 FROM f")
def kalman_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filter a stream over its main boxes, coasting where there is none."""
    z = px1(spark, sf_dir).select("stream_id", "frame_no").join(px3(spark, sf_dir).where("k = 0").drop("k"), ["stream_id", "frame_no"], "left")

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        track = None
        for frame, *box in rows:
            seen = box[0] is not None
            if track is None:
                track = Track.begin(0, frame, tuple(box), CONFIG) if seen else None
            else:
                track.predict()
                if seen:
                    track.update(frame, tuple(box))
                    del track.history[:-1]  # the filter looks no further back
            if track:
                yield frame, *(float(np.floor(v * 1e6 + 0.5) / 1e6) for v in (track.x, track.y, track.p00))

    return sequences.fold(z.select("stream_id", "frame_no", *_BOX), "stream_id", ["frame_no"], step, "stream_id long, frame_no long, x double, y double, p00 double")


# Summaries

_SHAPES = f"""WITH {PX4}, s AS (SELECT *, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy, cx - first_value(cx) OVER w AS ox, cy - first_value(cy) OVER w AS oy, row_number() OVER (PARTITION BY stream_id, track_id ORDER BY mean_delta * area DESC, frame_no) AS pk
        FROM (SELECT *, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy FROM px4) WINDOW w AS (PARTITION BY stream_id, track_id ORDER BY frame_no)
    ), t AS (SELECT stream_id, track_id, min(frame_no) AS start_frame, max(frame_no) AS end_frame, count(*) AS n_detections, max(sqrt(ox * ox + oy * oy)) AS disp, coalesce(sum(sqrt(dx * dx + dy * dy) ORDER BY frame_no), 0.0) AS path,
        max(mean_delta) AS delta, max(area) AS peak_area_px, count(*) FILTER (WHERE x0 <= 0 OR y0 <= 0 OR x1 >= 160 OR y1 >= 120) AS edges, median((x1 - x0) * (y1 - y0))::DOUBLE AS median_box_px,
        max(CASE WHEN pk = 1 THEN frame_no END) AS peak_frame, max(CASE WHEN pk = 1 THEN x0 END) AS peak_x0, max(CASE WHEN pk = 1 THEN y0 END) AS peak_y0, max(CASE WHEN pk = 1 THEN x1 END) AS peak_x1, max(CASE WHEN pk = 1 THEN y1 END) AS peak_y1
        FROM s GROUP BY stream_id, track_id
    ), u AS (SELECT *, (end_frame - start_frame) / 10.0::DOUBLE AS sec, path / greatest((end_frame - start_frame) / 10.0::DOUBLE, 0.5::DOUBLE) AS speed, edges / n_detections::DOUBLE AS ef FROM t)"""
_UP = lambda x, n: f"floor(({x}) * 1e{n}::DOUBLE + 0.5::DOUBLE) / 1e{n}::DOUBLE"
_COMMON = f"start_frame, end_frame, n_detections, {_UP('sec', 2)} AS duration_s, {_UP('disp', 1)} AS displacement_px, {_UP('path', 1)} AS path_px, {_UP('speed', 2)} AS speed_px_s, peak_frame, {_UP('delta', 2)} AS peak_mean_delta, peak_area_px, peak_x0, peak_y0, peak_x1, peak_y1"


def _passes(delta: float, disp: float, speed: float, area: float) -> str:
    return f"delta >= {delta} AND disp >= {disp} AND speed >= {speed} AND peak_area_px / 19200.0::DOUBLE >= {area}::DOUBLE AND ef <= 0.8::DOUBLE AND median_box_px / 19200.0::DOUBLE >= 0.001::DOUBLE"


_TRACKS = (
    _SHAPES
    + f", tracks AS (SELECT stream_id, track_id, CASE WHEN {_passes(80, 35, 2, 0.0013)} THEN 'high' WHEN {_passes(60, 35, 1, 0.0008)} THEN 'medium' ELSE 'low' END AS confidence, {_COMMON}, {_UP('ef', 2)} AS edge_frac,"
    + f" {_UP('n_detections / (end_frame - start_frame + 1)::DOUBLE', 2)} AS continuity, {_UP('median_box_px', 1)} AS median_box_px, {_UP('delta * sqrt(peak_area_px::DOUBLE) * (1 + disp / 20)', 1)} AS score FROM u WHERE {_UP('delta', 2)} >= 35)"
)


@query(_SHAPES + f" SELECT stream_id, track_id, {_COMMON} FROM u WHERE delta >= 35")
def event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.event_summary(px4(spark, sf_dir), ["stream_id", "track_id"], RATE, DetectorConfig().min_event_delta)


@query(_TRACKS + " SELECT * FROM tracks")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.track_summary(px4(spark, sf_dir), ["stream_id", "track_id"], RATE, WIDTH, HEIGHT, CONFIG)


@query(_TRACKS + " SELECT c AS confidence, count(track_id) AS tracks, count(DISTINCT stream_id) AS videos FROM (VALUES ('high'), ('medium'), ('low')) v(c) LEFT JOIN tracks ON confidence = c GROUP BY c")
def tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.tier_summary(track_summary(spark, sf_dir), "stream_id")


@query(_TRACKS + " SELECT stream_id, track_id, confidence, score FROM tracks ORDER BY score DESC, stream_id, track_id")
def ranked_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_summary(spark, sf_dir).select("stream_id", "track_id", "confidence", "score").orderBy(F.desc("score"), "stream_id", "track_id")


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.element_at(F.create_map(F.lit("high"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("low"), F.lit(2)), F.col("confidence"))
    return track_summary(spark, sf_dir).where(rank <= 1).select("stream_id", "track_id", "confidence")


@query(_TRACKS + " SELECT stream_id, track_id, confidence FROM tracks WHERE CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END <= 1 AND stream_id IN (SELECT stream_id FROM px1 WHERE event_type = 'signup')")
def tier_filter_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of the upper tiers in streams that have a signup."""
    return _tiered(spark, sf_dir).join(px1(spark, sf_dir).where("event_type = 'signup'").select("stream_id"), "stream_id", "left_semi")


@query(f"WITH {PX4} SELECT stream_id, track_id, '[' || string_agg('[' || frame_no || ',' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || ']', ',' ORDER BY frame_no) || ']' AS path FROM px4 GROUP BY stream_id, track_id")
def track_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's path as JSON; a track's boxes are bounded by its length."""
    path = F.array_sort(F.collect_list(F.array("frame_no", "x0", "y0", "x1", "y1")))
    return px4(spark, sf_dir).groupBy("stream_id", "track_id").agg(F.to_json(path).alias("path"))


@query(f"""WITH {PX4} SELECT stream_id, track_id, frame_no, px AS from_x, py AS from_y, cx AS to_x, cy AS to_y FROM (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM
    (SELECT *, (x0 + x1) / 2.0::DOUBLE AS cx, (y0 + y1) / 2.0::DOUBLE AS cy FROM px4) WINDOW w AS (PARTITION BY stream_id, track_id ORDER BY frame_no)) WHERE px IS NOT NULL""")
def trajectory_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream_id", "track_id").orderBy("frame_no")
    p = px4(spark, sf_dir).withColumns({"to_x": (F.col("x0") + F.col("x1")) / 2, "to_y": (F.col("y0") + F.col("y1")) / 2})
    return p.withColumns({"from_x": F.lag("to_x").over(w), "from_y": F.lag("to_y").over(w)}).where("from_x IS NOT NULL").select("stream_id", "track_id", "frame_no", "from_x", "from_y", "to_x", "to_y")


def _start_times(spark: SparkSession, sf_dir: str, timed: DataFrame) -> DataFrame:
    times = timed.select("stream_id", F.col("frame_no").alias("start_frame"), "us")
    return track_summary(spark, sf_dir).join(times, ["stream_id", "start_frame"], "left").select("stream_id", "track_id", scalars.iso_utc(F.floor(F.col("us") / 1000000).cast("double")).alias("start_time"))


@query(_TRACKS + """, times AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, epoch_us(ts) AS us FROM events)
    SELECT t.stream_id, track_id, strftime(make_timestamp(us // 1000000 * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS start_time FROM tracks t LEFT JOIN times e ON t.stream_id = e.stream_id AND t.start_frame = e.frame_no""")
def start_time_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start times by timestamp lists that hold every frame."""
    return _start_times(spark, sf_dir, px1(spark, sf_dir))


_EMITTED = f"least(end_frame + {CONFIG.max_age + 1}, last)"


@query(_SHAPES + f""", n AS (SELECT stream_id, max(frame_no) AS last FROM px1 GROUP BY stream_id) SELECT u.stream_id, track_id, peak_frame, p.event_id FROM u JOIN n ON n.stream_id = u.stream_id JOIN px1 p ON p.stream_id = u.stream_id AND p.frame_no = peak_frame
    WHERE delta >= 35 AND peak_frame > {_EMITTED} - {CACHED_FRAMES}""")
def event_snapshots_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a whole stream whose peak frame is still cached at the frame that ends their track, or the stream."""
    p = px1(spark, sf_dir).withColumn("last", F.max("frame_no").over(Window.partitionBy("stream_id")))
    found = event_summary(spark, sf_dir).join(p.select("stream_id", F.col("frame_no").alias("peak_frame"), "event_id", "last"), ["stream_id", "peak_frame"])
    return found.where(f"peak_frame > {_EMITTED} - {CACHED_FRAMES}").select("stream_id", "track_id", "peak_frame", "event_id")


@query(_TRACKS + " SELECT stream_id, track_id, 'track' AS kind FROM tracks UNION ALL SELECT stream_id, track_id, 'dropped' FROM u WHERE NOT " + _UP("delta", 2) + " >= 35")
def all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported tracks and those left out, in one table."""
    kept = track_summary(spark, sf_dir).select("stream_id", "track_id", F.lit("track").alias("kind"))
    every = px4(spark, sf_dir).select("stream_id", "track_id").distinct()
    return kept.unionByName(every.join(kept, ["stream_id", "track_id"], "left_anti").withColumn("kind", F.lit("dropped")))


# Triggers and clips


@query(f"""WITH {PX1}, c AS (SELECT stream_id, us, event_id, event_type = 'signup' AS active FROM px1 WHERE event_type IN ('signup', 'error'))
    SELECT p.stream_id, p.frame_no, c.active, c.event_id AS change_id FROM px1 p ASOF LEFT JOIN c ON p.stream_id = c.stream_id AND p.us >= c.us""")
def trigger_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigger's level at each frame: signups switch it on, errors off."""
    p = px1(spark, sf_dir)
    changes = p.where("event_type IN ('signup', 'error')").select("stream_id", "us", F.col("event_id").alias("change_id"), (F.col("event_type") == "signup").alias("active"))
    return joins.as_of(p.select("stream_id", "frame_no", "us"), changes, "stream_id", "us", ["active", "change_id"]).select("stream_id", "frame_no", "active", "change_id")


_CLIPS = f"""WITH RECURSIVE {PX1}, l AS (SELECT *, event_type = 'signup' AS active, max(CASE WHEN event_type = 'signup' THEN us END) OVER (PARTITION BY stream_id ORDER BY us) AS last, count(*) OVER (PARTITION BY stream_id ORDER BY us RANGE BETWEEN {HALF_DAY} PRECEDING AND CURRENT ROW) AS held,
        min(us) OVER (PARTITION BY stream_id ORDER BY us RANGE BETWEEN {HALF_DAY} PRECEDING AND CURRENT ROW) AS held_from, max(frame_no) OVER (PARTITION BY stream_id) AS final FROM px1
    ), f AS (SELECT stream_id, frame_no, us, active AS is_open, us AS opened, held_from AS first_us, held AS n, false AS ends FROM l WHERE frame_no = 0
        UNION ALL SELECT l.stream_id, l.frame_no, l.us, CASE WHEN f.is_open AND NOT f.ends THEN true ELSE l.active END, CASE WHEN f.is_open AND NOT f.ends THEN f.opened ELSE l.us END,
            CASE WHEN f.is_open AND NOT f.ends THEN f.first_us ELSE l.held_from END, CASE WHEN f.is_open AND NOT f.ends THEN f.n + 1 ELSE l.held END, f.is_open AND NOT f.ends AND NOT l.active AND l.us - l.last >= {HALF_DAY}
        FROM f JOIN l ON l.stream_id = f.stream_id AND l.frame_no = f.frame_no + 1
    ), clips AS (SELECT f.stream_id, opened AS opened_us, first_us, f.us AS closed_us, n AS frames, CASE WHEN ends THEN 'post-roll elapsed' ELSE 'shutdown' END AS reason FROM f JOIN l USING (stream_id, frame_no) WHERE is_open AND (ends OR frame_no = final))"""


@query(_CLIPS + " SELECT * FROM clips")
def clip_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def levels(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for _, us, kind in rows:
            last = us if kind == "signup" else last
            yield us, kind == "signup", last

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        return (clip[1:] for clip in sequences.clips(levels(rows), HALF_DAY, HALF_DAY))

    return sequences.fold(px1(spark, sf_dir).select("stream_id", "frame_no", "us", "event_type"), "stream_id", ["frame_no"], step, "stream_id long, opened_us long, first_us long, closed_us long, frames long, reason string")


@query(_CLIPS + " SELECT c.stream_id, c.opened_us, p.event_id FROM clips c JOIN px1 p ON p.stream_id = c.stream_id AND p.us BETWEEN c.first_us AND c.closed_us WHERE p.event_type = 'purchase'")
def clip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within a clip's time, widened to its first frame."""
    points = px1(spark, sf_dir).where("event_type = 'purchase'").select("stream_id", "event_id", "us")
    return joins.within(points, clip_sessions(spark, sf_dir), "stream_id", "us", "first_us", "closed_us", DAY).select("stream_id", "opened_us", "event_id")


@query(f"WITH {PX1}, o AS (SELECT stream_id, frame_no, us - lag(us) OVER (PARTITION BY stream_id ORDER BY frame_no) AS age FROM px1) SELECT stream_id, frame_no, age FROM o WHERE age <= {QUARTER_DAY}")
def fresh_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose overlay, made at the frame before, isn't stale."""
    age = F.col("us") - F.lag("us").over(Window.partitionBy("stream_id").orderBy("frame_no"))
    return px1(spark, sf_dir).withColumn("age", age).where(F.col("age") <= QUARTER_DAY).select("stream_id", "frame_no", "age")


@query(f"""WITH {PX1}, j AS (SELECT stream_id, count(*) AS frames, count(*) FILTER (WHERE event_type = 'error') AS failed FROM px1 GROUP BY stream_id)
    SELECT stream_id, CASE WHEN failed * 4 > frames THEN 'failed: ' || failed || ' of ' || frames ELSE 'ok' END AS status FROM j""")
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams parted into good ones and those of which over a quarter failed, with a message."""
    j = px1(spark, sf_dir).groupBy("stream_id").agg(F.count("*").alias("frames"), F.count_if(F.col("event_type") == "error").alias("failed"))
    message = F.concat(F.lit("failed: "), F.col("failed").cast("string"), F.lit(" of "), F.col("frames").cast("string"))
    return j.select("stream_id", F.when(F.col("failed") * 4 > F.col("frames"), message).otherwise("ok").alias("status"))


@query(f"""WITH {PX1}, s AS (SELECT DISTINCT stream_id, CASE stream_id % 3 WHEN 0 THEN 'P1' WHEN 1 THEN 'P3' ELSE 'P9' END AS model FROM px1)
    SELECT stream_id, s.model, width, height FROM s LEFT JOIN (VALUES ('P1', 160::BIGINT, 120::BIGINT), ('P3', 256, 192)) m(model, width, height) ON s.model = m.model""")
def sidecar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream with its sensor's geometry; null for an unknown one."""
    model = F.when(F.col("stream_id") % 3 == 0, "P1").when(F.col("stream_id") % 3 == 1, "P3").otherwise("P9")
    known = model_config(spark).select("model", "width", "height")
    return px1(spark, sf_dir).select("stream_id").distinct().withColumn("model", model).join(F.broadcast(known), "model", "left").select("stream_id", "model", "width", "height")


# The whole pipeline, which SQL can't express: tested against plain Python


def _boxes_to_the_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with the number of their stream's last frame; a stream without any has one row."""
    last = px1(spark, sf_dir).groupBy("stream_id").agg(F.max("frame_no").alias("last"))
    return last.join(px3(spark, sf_dir), "stream_id", "left").select("stream_id", "last", "frame_no", "k", *_BOX)


def _every_frame(rows: Iterator[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    """A stream's frames from 0 to its last with their boxes, from its rows of ``_boxes_to_the_end``."""
    due, last = 0, -1
    for (last, frame), own in groupby(rows, lambda r: r[:2]):
        if frame is not None:
            yield from ((n, []) for n in range(due, frame))
            yield frame, [r[3:] for r in own]
            due = frame + 1
    yield from ((n, []) for n in range(due, last + 1))


_TRACK_COLUMNS = "stream_id long, track_id long, confidence string, start_frame long, end_frame long, n_detections long, duration_s double, displacement_px double, path_px double, speed_px_s double, edge_frac double, continuity double, median_box_px double, peak_frame long, peak_mean_delta double, peak_area_px long, score double"


@query()
def full_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes merged, tracked and graded, stream by stream; frames without boxes count as misses."""
    names = [c.split()[0] for c in _TRACK_COLUMNS.split(", ")][1:]

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        found = (summarise(t, RATE, WIDTH, HEIGHT, CONFIG) for t in track_frames(_every_frame(rows), WIDTH, HEIGHT, CONFIG))
        return (tuple(r[c] for c in names) for r in found if r)

    return sequences.fold(_boxes_to_the_end(spark, sf_dir), "stream_id", ["frame_no", "k"], step, _TRACK_COLUMNS)


@query()
def overlay_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each frame the boxes of reportable tracks, coasting ones as last observed."""
    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        tracker = Tracker(WIDTH, HEIGHT, CONFIG, DetectorConfig().min_track_frames)
        for n, boxes in _every_frame(rows):
            tracker.step(n, boxes)
            yield from ((n, *map(int, b)) for b in tracker.overlay())

    return sequences.fold(_boxes_to_the_end(spark, sf_dir), "stream_id", ["frame_no", "k"], step, "stream_id long, frame_no long, x0 long, y0 long, x1 long, y1 long, track_id long")


@query()
def full_detect_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to events: detector, tracker, summary, on 8x8 frames."""
    config = DetectorConfig.of(warmup=5, min_delta=0.1, sigma_k=0.0, min_mean_delta=0.0, max_area_frac=0.19, max_blobs=3, morph_kernel=1, min_track_frames=2, min_event_delta=0.0)
    own = TrackConfig.of(max_dist_frac=0.4, max_age=3)

    columns = ["track_id", "start_frame", "end_frame", "n_detections", "duration_s", "displacement_px", "peak_frame", "peak_mean_delta", "peak_area_px"]

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        detector, tracker = Detector((8, 8), config), Tracker(8, 8, own, config.min_track_frames)

        def ended() -> Iterator[Track]:
            for n, px in rows:
                yield from tracker.step(n, detector.step(np.asarray(px, np.float32).reshape(8, 8)))
            yield from tracker.flush()

        return (tuple(e[c] for c in columns) for t in ended() if (e := live_event(t, RATE, config)))

    schema = "stream_id long, track_id long, start_frame long, end_frame long, n_detections long, duration_s double, displacement_px double, peak_frame long, peak_mean_delta double, peak_area_px long"
    return sequences.fold(px2(spark, sf_dir).select("stream_id", "frame_no", "px"), "stream_id", ["frame_no"], step, schema)
