"""Split rules against SQL, the rules in order, and one stream in many tasks."""

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from ravelin.operators import groups, scans, sequences
from ravelin.operators.joins import as_of
from ravelin.operators.tracker import merge_fragments
from ravelin.plans import split


@pytest.mark.parametrize("name", sorted(split.QUERIES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    assert same(split.QUERIES[name](spark, sf_dir), duck, split.ORACLES[name]) > 0


@pytest.mark.parametrize("weight", [0.02, 0.5, 0.999, 1.0])
def test_averages_of_one_long_stream(spark, weight, monkeypatch):
    values = np.random.default_rng(1).normal(50, 20, 5000).tolist()
    rows = spark.createDataFrame([("s", n, v) for n, v in enumerate(values)], "stream string, n long, v double")
    got = {r.n: r for r in scans.noise_and_background(rows, ["stream"], "n", "v", weight, 0.01).collect()}
    want = list(sequences.running_averages(values, weight, 0.01, 0, 0, 0, 0))
    assert len(got) == 5000
    for n, (background, noise, delta, _) in enumerate(want):
        assert np.allclose((got[n].background, got[n].noise, got[n].delta), (background, noise, delta), rtol=0, atol=1e-8)
    assert scans.running_average(rows.where("false"), ["stream"], "n", "v", weight, "y").count() == 0


def test_jumps_of_one_stream(spark):
    rng = np.random.default_rng(2)
    us = np.sort(rng.integers(0, 3000, 900)).tolist()  # with equal times, and gaps of several intervals
    us += (np.sort(rng.integers(0, 5000, 40)) + 9000).tolist()
    rows = spark.createDataFrame([(7, n, t) for n, t in enumerate(us)] + [(8, 0, -5)], "s long, n long, us long")
    after = {r.us: r.after for r in scans.first_after(rows.where("s = 7"), "s", "us", 37).collect()}
    assert after == {t: min((x for x in us if x >= t + 37), default=None) for t in us}
    got = sorted((r.s, r.n) for r in scans.openers(rows, "s", "n", "us", 37).collect())
    assert got == [(7, n) for n, x in enumerate(sequences.drift_throttle(us, 37)) if x] + [(8, 0)]
    assert scans.openings(rows.where("false"), "s", "us", 37).count() == 0


def test_as_of_in_cells(spark):
    rng = np.random.default_rng(3)
    left = spark.createDataFrame([(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 900, 400)))], "k long, t long, i long")
    right = spark.createDataFrame([(int(k), int(t), float(t) + k / 10) for k, t in {(int(k), int(t)) for k, t in zip(rng.integers(1, 3, 60), rng.integers(0, 900, 60))}], "k long, t long, v double")
    want = {r.i: r.v for r in as_of(left, right, "k", "t", ["v"]).collect()}
    for cell in (1, 50, 10_000):
        assert {r.i: r.v for r in scans.as_of_cells(left, right, "k", "t", ["v"], cell).collect()} == want
    assert scans.as_of_cells(left.where("false"), right, "k", "t", ["v"], 50).count() == 0
    assert scans.as_of_cells(left, right.where("false"), "k", "t", ["v"], 50).where("v IS NOT NULL").count() == 0


def test_a_hot_stream_is_the_work_of_many_tasks(spark):
    """A million rows of one stream: no task of the as-of's windows holds a large part of it."""
    rows = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    found = scans.as_of_cells(rows, rows.where("t % 1000 = 0").withColumn("v", F.col("t")), "k", "t", ["v"], 4096)
    parts = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max(F.abs(F.col("v") - (F.col("t") - F.col("t") % 1000))).alias("off")).collect()
    assert sum(r.n for r in parts) == 1_000_000 and max(r.n for r in parts) < 500_000 and max(r.off for r in parts) == 0


def test_chains_of_fragments(spark):
    rng = np.random.default_rng(4)
    rows = [(s, f, k, *map(int, (x, y, x + w, y + h)), float(d), int(w * h)) for s in range(2) for f in range(12) for k, (x, y, w, h, d) in enumerate(zip(*(rng.integers(0, hi, 25 - f * 2) for hi in (150, 110, 12, 12, 90))))]
    rows += [(3, 0, k, 5 * k, 0, 5 * k + 2, 4, 1.0, 8) for k in range(40)]  # one chain of forty
    rows += [(4, 0, 0, -9, -9, -5, -5, 2.0, 16), (4, 0, 1, -2, -2, 0, 0, 3.0, 4), (4, 0, 2, 31, 31, 33, 33, 1.0, 4), (4, 0, 3, 33, 33, 60, 60, 1.0, 4)]
    boxes = spark.createDataFrame(rows, "stream_id long, frame_no long, k long, x0 long, y0 long, x1 long, y1 long, mean_delta double, area long")
    want = set()
    for frame in {r[:2] for r in rows}:
        for n, b in enumerate(merge_fragments([r[3:] for r in rows if r[:2] == frame], 3.0)):
            want.add((*frame, n, *b))
    for cell in (4, 32):
        assert {tuple(r) for r in groups.merged_fragments(boxes, 3.0, cell).collect()} == want
    assert groups.merged_fragments(boxes.where("false"), 3.0).count() == 0


def test_greedy_matching_in_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(s, f, t, b, float(rng.integers(0, 6)) / 4) for s in range(2) for f in range(10) for t in range(7) for b in range(6) if rng.random() < 0.7]
    want = set()
    for frame in {r[:2] for r in rows}:
        used = set()
        for cost, t, b in sorted((r[4], r[2], r[3]) for r in rows if r[:2] == frame):
            if not {("t", t), ("b", b)} & used:
                used |= {("t", t), ("b", b)}
                want.add((*frame, t, b))
    candidates = spark.createDataFrame(rows, "stream_id long, frame_no long, t long, b long, cost double")
    assert {tuple(r) for r in groups.matched(candidates).collect()} == want
    assert groups.matched(candidates.where("false")).count() == 0


def test_jumps_take_no_rounds(spark, monkeypatch):
    """However long a stream, nothing is written between rounds; blocks with gaps, equal times and times before 0 lead on."""
    monkeypatch.setattr(scans, "written", lambda df: pytest.fail("a round was written"))
    rng = np.random.default_rng(6)
    streams = {s: np.sort(np.concatenate([rng.integers(lo, hi, n) for lo, hi, n in spans])).tolist() for s, spans in {1: [(-500, 3000, 2000)], 2: [(0, 90, 40), (5000, 5001, 3), (9000, 9900, 25)], 3: [(-7, -6, 1)], 4: [(0, 60000, 300)]}.items()}
    rows = spark.createDataFrame([(s, n, t, n / 2) for s, us in streams.items() for n, t in enumerate(us)] + [(4, 999, None, 0.0)], "s long, n long, us long, v double")
    for interval in (1, 13, 400, 100_000):
        want = {(s, n, us[n], n / 2) for s, us in streams.items() for n, x in enumerate(sequences.drift_throttle(us, interval)) if x}
        got = [tuple(r) for r in scans.openers(rows, "s", "n", "us", interval, ["v"]).collect()]
        assert len(got) == len(want) and set(got) == want
        assert {(r.s, r.us) for r in scans.openings(rows, "s", "us", interval).collect()} == {(s, us) for s, _, us, _ in want}
