"""Rules that follow a stream, without following it: one stream's rows are the work of many tasks.

Running averages are affine maps, and a block of rows composes to one map: rows are summed up by block, the blocks' maps are
put after each other, and each block's rows start from where that leads. Throttles, segments and windows go from a row to the
first one an interval later: a block tells where ways through it lead, and each block's rows are followed from where the way
from the first enters it. As-of
values are carried from cell to cell of time, then from row to row within a cell.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.sequences import fold
from ravelin.session import written

#: Rows of a block, at most; fewer for a fast decay, as its powers within a block must stay in a double's range.
BLOCK_ROWS = 1024
#: Intervals in a block of time, of which a way from row to row passes through one row each at most.
BLOCK_INTERVALS = 8


def block_rows(decay: float) -> int:
    return BLOCK_ROWS if decay <= 0 or decay >= 1 else max(1, min(BLOCK_ROWS, int(200 / -math.log(decay))))


def running_average(rows: DataFrame, keys: list[str], number: str, value: str, weight: float, name: str, start: float | None = None) -> DataFrame:
    """``rows`` with ``name``: y of the row before, moved towards its value by ``weight``; at first ``start``, or the first value.

    ``number`` counts a stream's rows from 0, without gaps. A block's window is a task's work; only a row a block is followed
    in order. Null values aren't allowed."""
    keep = 1.0 - weight
    size = block_rows(keep)
    own = rows.withColumns({"_block": F.floor(F.col(number) / size).cast("long"), "_at": (F.col(number) % size).cast("int")})
    # y at row i of a block is keep^i * y0 + sum over j < i of weight * value_j * keep^(i - 1 - j).
    if keep > 0:
        before = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        scaled = F.coalesce(F.sum(F.col(value) * F.pow(F.lit(keep), -F.col("_at") - 1)).over(before), F.lit(0.0))
        own = own.withColumn("_given", F.lit(weight) * F.pow(F.lit(keep), F.col("_at")) * scaled)
    else:
        own = own.withColumn("_given", F.coalesce(F.lag(value).over(Window.partitionBy(*keys, "_block").orderBy("_at")) * weight, F.lit(0.0)))
    own = written(own)
    last = F.struct("_at", "_given", value)
    blocks = own.groupBy(*keys, "_block").agg(F.max(last).alias("_last"), F.min_by(value, "_at").alias("_first"))
    given = F.col("_last._given") * keep + F.col(f"_last.{value}") * weight
    blocks = blocks.select(*keys, "_block", F.pow(F.lit(keep), F.col("_last._at") + 1).alias("_kept"), given.alias("_moved"), F.col("_first"))

    def follow(steps: Iterator[tuple]) -> Iterator[tuple]:
        y = None
        for block, kept, moved, first in steps:
            y = (first if start is None else start) if y is None else y
            yield block, y
            y = kept * y + moved

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    starts = fold(blocks, keys, ["_block"], follow, f"{types}, _block long, _start double")
    found = own.join(starts, [*keys, "_block"])
    return found.withColumn(name, F.col("_start") * F.pow(F.lit(keep), F.col("_at")) + F.col("_given")).drop("_block", "_at", "_given", "_start")


def noise_and_background(rows: DataFrame, keys: list[str], number: str, value: str, alpha: float, noise_alpha: float) -> DataFrame:
    """``rows`` with background, noise and delta, as ``sequences.running_averages`` gives them."""
    own = running_average(rows, keys, number, value, alpha, "background").withColumn("delta", F.col(value) - F.col("background"))
    return running_average(own.withColumn("_rise", F.abs("delta")), keys, number, "_rise", noise_alpha, "noise", 1.0).drop("_rise")


def first_after(rows: DataFrame, key: str, time: str, interval: int) -> DataFrame:
    """key, time and ``after``: for each distinct time of a stream the first one that is ``interval`` or more later, or null.

    A time and what it looks for lie in neighbouring cells as long as ``interval``, so a cell is a task's work; where a cell has
    nothing later, the first time of the next cell that has any is it, from a table of cells."""
    times = written(rows.select(key, time).where(F.col(time).isNotNull()).distinct())
    cell = lambda c: F.floor(c / interval).cast("long")
    asked = times.select(key, F.col(time).alias("_from"), (F.col(time) + interval).alias("_t"), F.lit(1).alias("_asks"))
    known = times.select(key, F.lit(None).cast("long").alias("_from"), F.col(time).alias("_t"), F.lit(0).alias("_asks"))
    both = asked.unionByName(known).withColumn("_cell", cell(F.col("_t")))
    later = Window.partitionBy(key, "_cell").orderBy(F.desc("_t"), F.col("_asks")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last(F.when(F.col("_asks") == 0, F.col("_t")), ignorenulls=True).over(later)).where("_asks = 1")
    cells = both.groupBy(key, "_cell").agg(F.min(F.when(F.col("_asks") == 0, F.col("_t"))).alias("_least"))
    ahead = Window.partitionBy(key).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(key, "_cell", F.last("_least", ignorenulls=True).over(ahead).alias("_next"))
    return near.join(cells, [key, "_cell"]).select(key, F.col("_from").alias(time), F.coalesce("_near", "_next").alias("after"))


def _entries(rows: DataFrame, key: str, time: str, interval: int) -> DataFrame:
    """key, _block, time and ``_due``: where the way from row to row may enter a block, and from when on it goes on beyond it.

    A way comes from before the block, so it enters at a row of the block's first interval, or at the first row after that."""

    def back(steps: Iterator[tuple]) -> Iterator[tuple]:
        ahead: deque[tuple[int, int]] = deque()  # (time, due) of the rows an interval ahead, the latest first
        begin, last = None, None
        for block, t in steps:
            begin = block * interval * BLOCK_INTERVALS if begin is None else begin
            if last is not None and t == last[1]:
                continue
            if last is not None and t < begin + interval:
                yield last
                last = None
            while len(ahead) > 1 and ahead[1][0] >= t + interval:
                ahead.popleft()
            due = ahead[0][1] if ahead and ahead[0][0] >= t + interval else t + interval
            ahead.append((t, due))
            last = block, t, due
        if last is not None:
            yield last

    # The block is a column of its own for the generator, beside the one that rows are dealt by.
    own = rows.select(key, "_block", F.col("_block").alias("_at"), time)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, "_block"))
    return fold(own, [key, "_block"], [F.desc(time)], back, f"{kinds}, _at long, {time} long, _due long").drop("_at")


def openers(rows: DataFrame, key: str, number: str, time: str, interval: int, values: Sequence[str] = ()) -> DataFrame:
    """key, number, time and ``values`` of a stream's first row, and then always of the first row an interval later; of several
    rows of a time, that of the least number.

    Blocks of ``BLOCK_INTERVALS`` intervals are the work of a task each, and give where ways through them may begin and where
    these lead; only those rows, one of so many, are followed stream by stream, and each block's rows from where that enters
    it. ``rows`` are read twice."""
    own = rows.select(key, number, time, *values).where(F.col(time).isNotNull()).withColumn("_block", F.floor(F.col(time) / (interval * BLOCK_INTERVALS)).cast("long"))

    def follow(steps: Iterator[tuple]) -> Iterator[tuple]:
        due = None
        for block, t, then in steps:
            if due is None or t >= due:
                yield block, t
                due = then

    kind = {c: f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, number, time, *values)}
    entered = fold(_entries(own, key, time, interval), key, [time], follow, f"{kind[key]}, _block long, {kind[time]}")

    def along(steps: Iterator[tuple]) -> Iterator[tuple]:
        due = None
        for entry, t, *rest in steps:
            if entry:
                due = t
            elif due is not None and t >= due:
                yield (None, t, *rest)
                due = t + interval

    both = own.withColumn("_entry", F.lit(False)).unionByName(entered.withColumn("_entry", F.lit(True)), allowMissingColumns=True)
    both = both.select(key, "_block", "_entry", time, number, *values)
    order = [time, F.desc("_entry"), F.asc_nulls_last(number)]
    found = fold(both, [key, "_block"], order, along, ", ".join([kind[key], "_block long", "_entry boolean", kind[time], kind[number], *[kind[v] for v in values]]))
    return found.select(key, number, time, *values)


def openings(rows: DataFrame, key: str, time: str, interval: int) -> DataFrame:
    """The times at which a stream's first row, and then always the first row an interval later, lies."""
    return openers(rows.select(key, time, F.lit(0).alias("_number")), key, "_number", time, interval).select(key, time)


def as_of_cells(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], cell: int) -> DataFrame:
    """As ``joins.as_of``: each left row with the values of the latest right row of its key that isn't later.

    A cell of time is a task's work, and a stream's cells, a row each, are gone through to carry the last value of each to the
    next; ``cell`` should hold some thousands of rows. A right value of a time is that of its greatest values."""
    held = F.struct(*values)
    kind = right.select(held).schema[0].dataType
    a = left.select(F.struct(*left.columns).alias("l"), F.col(key).alias("key"), F.col(time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("r"))
    b = right.select(F.lit(None).cast(a.schema["l"].dataType).alias("l"), F.col(key).alias("key"), F.col(time).alias("at"), F.lit(0).alias("side"), held.alias("r"))
    both = written(a.unionByName(b).withColumn("cell", F.floor(F.col("at") / cell).cast("long")))
    within = Window.partitionBy("key", "cell").orderBy("at", "side", "r").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("r", ignorenulls=True).over(within)).where("side = 1")
    cells = both.groupBy("key", "cell").agg(F.max(F.when(F.col("side") == 0, F.struct("at", "r"))).alias("last"))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("key").alias("k"), F.col("cell").alias("c"), F.last("last", ignorenulls=True).over(before)["r"].alias("carried"))
    found = near.join(cells, near["key"].eqNullSafe(cells["k"]) & near["cell"].eqNullSafe(cells["c"])).withColumn("r", F.coalesce("near", "carried"))
    return found.select("l.*", *[F.col(f"r.{v}").alias(v) for v in values])
