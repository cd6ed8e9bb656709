"""Connected components by randomised contraction (Bögeholz, Brand, Todor: In-database connected component analysis).

In each round every vertex picks the neighbour, or itself, that the round orders first, and edges are drawn between the
picks. Every other round orders by a hash of its own: the expected number of vertices falls by a constant factor whatever
the graph's shape, so chains and stars alike take a number of rounds logarithmic in their size. The rounds between order
by the vertex itself, which settles at once the stars around a least vertex that this package's joins give. Nothing is gathered on the driver or in one task: picks are
a minimum (combined before the shuffle), and joins read written tables, so the engine can split a hub's partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import cut

MAX_ROUNDS = 200
#: Rows of a written table that a task reads at least.
ROWS_A_TASK = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table of so many rows, read by as few tasks as these need: rounds soon have less than a partition each."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def _contract(edges: DataFrame) -> list[DataFrame]:
    """Each round's picks; at the end no edge is left."""
    left = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    picks: list[DataFrame] = []
    while rows := left.count():
        n = len(picks)
        if n == MAX_ROUNDS:
            raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")

        def order(v: Column) -> Column:
            return F.struct((F.xxhash64(F.lit(n), v) if n % 2 else v).alias("h"), v.alias("v"))  # noqa: B023

        left = _small(left, rows)
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        pick = cut(both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m")).select(F.col("a").alias("node"), F.least("m", order(F.col("a")))["v"].alias("root")))
        pick = _small(pick, 2 * rows)
        picks.append(pick)
        one = left.join(pick, left.a == pick.node).select(F.col("root").alias("ra"), "b")
        two = one.join(pick, one.b == pick.node).select(F.col("ra").alias("a"), F.col("root").alias("b"))
        left = cut(two.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return picks


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b. A row (node, root) for each end of an edge between two different nodes; nodes
    have the same root just when they are connected. Repeated edges, both directions and loops are allowed; rows with a
    null end are left out. No edges give no rows."""
    picks = _contract(edges)
    if not picks:
        return edges.sparkSession.createDataFrame([], "node long, root long")

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        later = later.select(F.col("node").alias("via"), F.col("root").alias("end"))
        return cut(earlier.join(later, earlier.root == later.via, "left").select("node", F.coalesce("end", "root").alias("root")))

    # A round's picks are a fraction of those before it. Each is written, as the driver would hold a plan of all rounds, told anew after each of its stages.
    return reduce(compose, reversed(picks))
