"""Embedding near-duplicates: an exact cosine join by pigeonhole over subspaces.

Unit vectors with cosine c lie at squared distance 2 - 2c. Vectors are turned by a fixed random rotation, which evens out
their parts, and split into ``BLOCKS`` blocks; the squared distance is the sum of the blocks', so a linked pair is within
its block's share of the budget, in proportion to the block's dimensions, in at least one block. Each block is joined by
range: its two leading coordinates lie in a grid whose cells are as wide as twice the block's radius, a vector has one home
cell and visits the four cells that its square of that radius touches, and pairs that meet are put to the block's budget.
The union of candidates is verified by the cosine of the original vectors in double precision. A pair that is a candidate
in several blocks counts in the first.

Equal vectors of a label are one row with a count. A cell with more than ``TILE`` members is split into tiles that meet
pairwise, each a task's work; a tile gives each vector's number of links and a forest of edges, never its pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with
nothing and are kept by themselves; vectors of different lengths never link; a component's id is its least non-null
vec_id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import cut, table
from ravelin.llm.components import components
from ravelin.session import ship

COSINE = 0.93
BLOCKS, TILE, SEED = 4, 1024, 3
#: Cells that are large enough to be split are broadcast up to this many, and joined beyond.
MOST_BROADCAST = 100_000
SLACK = 1e-9


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED + size).normal(size=(size, size)))[0]


def bounds(size: int) -> list[int]:
    """Where the blocks of a vector of ``size`` components begin, and the end."""
    blocks = min(BLOCKS, size)
    return [size * i // blocks for i in range(blocks + 1)]


def budgets(size: int, cosine: float) -> list[float]:
    edge = bounds(size)
    return [(2 - 2 * cosine) * (b - a) / size + SLACK for a, b in zip(edge, edge[1:])]


def turned(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, rotated."""
    return x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(x.shape[1])


def cells(x: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell (n, 2) and the visited cells (n, 4, 2) of turned vectors in a block's grid."""
    a, b = bounds(x.shape[1])[block : block + 2]
    radius = np.sqrt(budgets(x.shape[1], cosine)[block]) + 1e-6
    c = x[:, a : min(b, a + 2)]
    if c.shape[1] < 2:
        c = np.concatenate((c, np.zeros((len(c), 1))), axis=1)
    low = np.floor((c - radius) / (2 * radius)).astype(np.int64)
    high = np.floor((c + radius) / (2 * radius)).astype(np.int64)
    corners = np.stack([np.stack((x0[:, 0], x1[:, 1]), axis=1) for x0 in (low, high) for x1 in (low, high)], axis=1)
    return np.floor(c / (2 * radius)).astype(np.int64), corners


def _visits(distinct: DataFrame, cosine: float) -> DataFrame:
    """(label, size, block, cx, cy, home, rep): a row for each cell a vector lives in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(e) for e in batch.column("embedding")])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                own = batch.take(pa.array(rows))
                names = own.select(["label", "rep"])
                x = turned(np.array(own.column("embedding").to_pylist(), np.float64))
                for block in range(min(BLOCKS, size)):
                    home, corners = cells(x, block, cosine)
                    # At the grid's lines rounding may let two corners be one cell.
                    at = np.concatenate((np.arange(len(x)), np.repeat(np.arange(len(x)), 4)))
                    cell = np.concatenate((home, corners.reshape(-1, 2)))
                    kind = np.repeat([True, False], (len(x), 4 * len(x)))
                    _, first = np.unique(np.column_stack((at, cell, kind)), axis=0, return_index=True)
                    at, cell, kind = at[first], cell[first], kind[first]
                    given = names.take(pa.array(at))
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            given.column("label"), pa.array(np.full(n, size), pa.int32()), pa.array(np.full(n, block), pa.int32()),
                            pa.array(cell[:, 0]), pa.array(cell[:, 1]), pa.array(kind), given.column("rep"),
                        ],
                        names=["label", "size", "block", "cx", "cy", "home", "rep"],
                    )

    kind = distinct.schema["label"].dataType.simpleString()
    return distinct.select("label", "rep", "embedding").mapInArrow(run, f"label {kind}, size int, block int, cx long, cy long, home boolean, rep long")


def tile_links(home: np.ndarray, visitors: np.ndarray, block: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (visitor, home) of original vectors that link and whose first candidate block is this one, in batches."""
    size = home.shape[1]
    edge, most = bounds(size), budgets(size, cosine)
    a, b = edge[block], edge[block + 1]
    th, tv = turned(home), turned(visitors)
    hh = np.einsum("ij,ij->i", th[:, a:b], th[:, a:b])
    nh, nv = np.linalg.norm(home, axis=1), np.linalg.norm(visitors, axis=1)
    for start in range(0, len(visitors), 512):
        part = tv[start : start + 512]
        d = np.einsum("ij,ij->i", part[:, a:b], part[:, a:b])[:, None] + hh - 2 * part[:, a:b] @ th[:, a:b].T
        v, h = np.nonzero(d <= most[block] + 1e-6)
        for s in range(0, len(v), 65536):
            vs, hs = v[s : s + 65536] + start, h[s : s + 65536]
            gap = (tv[vs] - th[hs]) ** 2
            spent = np.add.reduceat(gap, edge[:-1], axis=1)
            near = spent <= most
            first = near[:, block] & ~near[:, :block].any(axis=1)
            vs, hs = vs[first], hs[first]
            cos = np.einsum("ij,ij->i", visitors[vs], home[hs]) / (nv[vs] * nh[hs])
            yield vs[cos >= cosine], hs[cos >= cosine]


def _tile(own: pa.Table, cosine: float) -> pa.Table:
    """Links of one tile: rows (rep, n) with the number of linked rows, and (rep, 0, other) for a forest's edges."""
    is_home = own.column("home").to_numpy()
    if is_home.all() or not is_home.any():
        return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    size, block = own.column("size")[0].as_py(), own.column("block")[0].as_py()
    x = own.column("embedding").combine_chunks()
    x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    rep, n = own.column("rep").to_numpy(), own.column("n").to_numpy()
    h, v = np.flatnonzero(is_home), np.flatnonzero(~is_home)
    links = np.zeros(len(v), np.int64)
    ids, place = np.unique(rep, return_inverse=True)
    label = np.arange(len(ids))
    for vs, hs in tile_links(x[h], x[v], block, cosine):
        a, b = place[v[vs]], place[h[hs]]
        other = a != b
        np.add.at(links, vs[other], n[h[hs[other]]])
        a, b = a[other], b[other]
        while True:  # least label over what is linked
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    some = np.flatnonzero(links)
    return pa.table(
        {
            "rep": pa.array(np.concatenate((rep[v[some]], ids[moved]))),
            "n": pa.array(np.concatenate((links[some], np.zeros(len(moved), np.int64)))),
            "other": pa.array([None] * len(some) + ids[label[moved]].tolist(), pa.int64()),
        }
    )


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row."""
    spark = df.sparkSession
    ship(spark)
    v = F.col("embedding")
    usable = (
        F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[label_col].alias("label"), df[vector_col].alias("embedding"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Vectors are told apart by two hashes of their components and the label; a distinct one has a number of its own.
    told = {"h1": F.xxhash64(F.lit(1), "label", "embedding"), "h2": F.xxhash64(F.lit(2), "embedding", "label"), "embedding": v}
    keyed = cut(rows.select("vec_id", "label", "usable", *[F.when(F.col("usable"), c).alias(name) for name, c in told.items()]))
    same = keyed.where("usable").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    distinct = cut(same.withColumn("rep", F.monotonically_increasing_id()))  # written, so that numbers stay
    visits = cut(_visits(distinct, cosine))
    cell = ["label", "size", "block", "cx", "cy"]
    counts = visits.groupBy(*cell).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors"))
    large = cut(
        counts.where(f"homes > {TILE} OR visitors > {TILE}").select(*[F.col(c).alias("l_" + c) for c in cell], F.expr(f"(homes + {TILE - 1}) div {TILE}").alias("h"), F.expr(f"(visitors + {TILE - 1}) div {TILE}").alias("v"))
    )
    side = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    on = [F.col(c) == F.col("l_" + c) for c in cell]
    # A home row goes to one row of tiles and to all its columns, a visitor to one column and all its rows.
    tiled = visits.join(side, on, "left").withColumns({"h": F.coalesce("h", F.lit(1).cast("long")), "v": F.coalesce("v", F.lit(1).cast("long"))})
    place = F.expr("""
        IF(home, transform(sequence(0L, v - 1), k -> named_struct('i', pmod(xxhash64(rep), h), 'j', k)),
                 transform(sequence(0L, h - 1), k -> named_struct('i', k, 'j', pmod(xxhash64(rep), v))))
    """)
    tiles = tiled.withColumn("tile", F.explode(place)).select(*cell, "tile.i", "tile.j", "home", "rep")
    tiles = tiles.join(distinct.select("rep", "n", "embedding"), "rep").select(*cell, "i", "j", "home", "rep", "n", "embedding")
    found = cut(tiles.groupBy(*cell, "i", "j").applyInArrow(lambda t: _tile(t, cosine), "rep long, n long, other long"))
    links = found.groupBy("rep").agg(F.sum("n").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    rooted = cut(
        distinct.select("rep", "h1", "h2", "least", "n").join(roots, distinct.rep == roots.node, "left").select("rep", "h1", "h2", "least", "n", F.coalesce("root", "rep").alias("root")).join(links, "rep", "left")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(least, "root").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    result = keyed.where("usable").select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_embeddings": op5_embeddings}
ORACLES: dict[str, Any] = {
    "op5_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        )
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
        FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = e.vec_id
        LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.vec_id
    """
}
