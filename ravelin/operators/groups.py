"""Boxes of a frame as plans: fragments that are near each other become one, and boxes go to tracks, cheapest pair first.

Frames are independent, so both work by equi-joins on stream and frame and a frame's cells, over rounds whose number follows
the longest chain in any frame, not the number of frames. What a round gives is written, so the next starts from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.scalars import box_gap
from ravelin.session import written

FRAME = ["stream_id", "frame_no"]
#: Side of a cell of a frame, in pixels.
CELL = 32


def near_in_cells(boxes: DataFrame, most: float, cell: int = CELL) -> DataFrame:
    """stream_id, frame_no, a, b: numbers k of boxes of one frame, a before b, whose edges are within ``most``.

    A box stands in the cells that it touches when widened by half of ``most``; two near boxes meet in one of them."""
    half = most / 2
    span = lambda low, high: F.sequence(F.floor((F.col(low) - half) / cell).cast("long"), F.floor((F.col(high) + half) / cell).cast("long"))
    placed = boxes.select(*FRAME, "k", "x0", "y0", "x1", "y1", F.explode(span("x0", "x1")).alias("cx")).withColumn("cy", F.explode(span("y0", "y1")))
    named = lambda p: placed.select(*FRAME, "cx", "cy", *[F.col(c).alias(f"{p}_{c}") for c in ("k", "x0", "y0", "x1", "y1")])
    side = lambda p: {c: F.col(f"{p}_{c}") for c in ("x0", "y0", "x1", "y1")}
    pairs = named("a").join(named("b"), [*FRAME, "cx", "cy"]).where("a_k < b_k").where(box_gap(side("a"), side("b")) <= most)
    return pairs.select(*FRAME, F.col("a_k").alias("a"), F.col("b_k").alias("b")).distinct()


def merged_fragments(boxes: DataFrame, most: float, cell: int = CELL) -> DataFrame:
    """stream_id, frame_no, n, x0, y0, x1, y1, mean_delta, area: boxes within ``most`` of each other become one, transitively
    over the boxes as given; n counts a frame's groups from 0 by least member.

    Labels spread along the pairs, the least first, and each then takes the label of its label."""
    boxes = written(boxes)
    pairs = near_in_cells(boxes, most, cell)
    both = written(pairs.select(*FRAME, F.col("a").alias("k"), F.col("b").alias("other")).unionByName(pairs.select(*FRAME, F.col("b").alias("k"), F.col("a").alias("other"))))
    label = written(both.groupBy(*FRAME, "k").agg(F.least(F.col("k"), F.min("other")).alias("g")))  # of boxes that have a neighbour
    while True:
        of_other = label.select(*FRAME, F.col("k").alias("other"), F.col("g").alias("o"))
        spread = both.join(of_other, [*FRAME, "other"]).groupBy(*FRAME, "k").agg(F.min("o").alias("o"))
        new = label.join(spread, [*FRAME, "k"]).select(*FRAME, "k", "g", F.least("g", "o").alias("h"))
        of_label = new.select(*FRAME, F.col("k").alias("h"), F.col("h").alias("j"))
        new = written(new.join(of_label, [*FRAME, "h"], "left").select(*FRAME, "k", F.col("g").alias("old"), F.least("h", F.coalesce("j", "h")).alias("g")))
        label = new.drop("old")
        if new.where("old <> g").isEmpty():
            break
    group = boxes.join(label, [*FRAME, "k"], "left").withColumn("g", F.coalesce("g", "k"))
    figures = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("mean_delta").alias("mean_delta"), F.sum("area").alias("area")]
    one = group.groupBy(*FRAME, "g").agg(*figures)
    n = F.row_number().over(Window.partitionBy(*FRAME).orderBy("g")) - 1
    return one.select(*FRAME, n.cast("long").alias("n"), "x0", "y0", "x1", "y1", "mean_delta", "area")


def matched(candidates: DataFrame) -> DataFrame:
    """stream_id, frame_no, t, b: of candidates with a cost, those that are taken when the cheapest is taken first, and t and
    b are each used once; equal costs by t, then by b.

    In a round every pair that is the cheapest of both its t and its b is taken: nothing cheaper could use either up, so the
    order among such pairs doesn't matter. The pairs of what is used leave."""
    left = written(candidates.select(*FRAME, "t", "b", F.struct("cost", "t", "b").alias("c")))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        of = lambda side: F.min("c").over(Window.partitionBy(*FRAME, side))
        won = written(left.withColumns({"ct": of("t"), "cb": of("b")}).where("c = ct AND c = cb").select(*FRAME, "t", "b"))
        taken.append(won)
        left = written(left.join(won.drop("b"), [*FRAME, "t"], "left_anti").join(won.drop("t"), [*FRAME, "b"], "left_anti"))
    if not taken:
        return left.select(*FRAME, "t", "b")
    found = taken[0]
    for more in taken[1:]:
        found = found.unionByName(more)
    return found
