"""Joins that keep their sides apart by time or frame: as-of, intervals, proximity, association candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.scalars import box_gap, iou


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key that isn't later; equal times match.

    One shuffle by key: the sides are stacked and a window carries the last right row forward. Row counts stay those of
    the left side whatever the right side's density."""
    held = F.struct(*values)
    a = left.select(F.struct(*left.columns).alias("l"), F.col(key).alias("key"), F.col(time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(right.select(held).schema[0].dataType).alias("r"))
    b = right.select(F.lit(None).cast(a.schema["l"].dataType).alias("l"), F.col(key).alias("key"), F.col(time).alias("at"), F.lit(0).alias("side"), held.alias("r"))
    w = Window.partitionBy("key").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("r", F.last("r", ignorenulls=True).over(w))
    return found.where("side = 1").select("l.*", *[F.col(f"r.{v}").alias(v) for v in values])


def within(points: DataFrame, ranges: DataFrame, key: str, time: str, start: str, end: str, cell: int) -> DataFrame:
    """Pairs of a point and a range of its key that holds it, both ends included.

    Ranges are dealt to the cells of time that they touch and points to their one cell, so the join is an equi-join on key
    and cell; ``cell`` should be about a range's usual length."""
    p = points.withColumn("cell", F.floor(F.col(time) / cell))
    r = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell)))).withColumnRenamed(key, "range_key")
    on = (p[key] == r["range_key"]) & (p["cell"] == r["cell"]) & F.col(time).between(F.col(start), F.col(end))
    return p.join(r, on).drop("cell", "range_key")


def _box(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}_{c}") for c in ("x0", "y0", "x1", "y1")}


def _named(boxes: DataFrame, prefix: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in boxes.columns])


def near_pairs(boxes: DataFrame, most: float) -> DataFrame:
    """Pairs of boxes of one frame (a before b) whose edges are within ``most``: a self-join on stream and frame."""
    a, b = _named(boxes, "a"), _named(boxes, "b")
    on = (F.col("a_stream_id") == F.col("b_stream_id")) & (F.col("a_frame_no") == F.col("b_frame_no")) & (F.col("a_k") < F.col("b_k"))
    return a.join(b, on).withColumn("gap", box_gap(_box("a"), _box("b"))).where(F.col("gap") <= most)


def association_candidates(boxes: DataFrame, most: float, iou_weight: float) -> DataFrame:
    """Boxes of a frame against those of the frame before: pairs within the gate, and their cost."""
    a, b = _named(boxes, "t"), _named(boxes, "b")
    on = (F.col("t_stream_id") == F.col("b_stream_id")) & (F.col("t_frame_no") + 1 == F.col("b_frame_no"))
    centre = lambda p, u, v: (F.col(f"{p}_{u}") + F.col(f"{p}_{v}")) / 2
    dx, dy = centre("b", "x0", "x1") - centre("t", "x0", "x1"), centre("b", "y0", "y1") - centre("t", "y0", "y1")
    near = a.join(b, on).withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= most)
    return near.withColumn("cost", F.col("dist") / most - iou_weight * iou(_box("t"), _box("b")))
