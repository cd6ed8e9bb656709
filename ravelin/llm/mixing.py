"""Mixing sources to target weights: exact block quotas dealt to output shards by a hypergeometric splitting tree.

A source's documents, in a hashed order, make one stream of words; blocks of ``block_words`` words tile it. A source that is
to give t of its S words is passed over whole t // S times, and the rest is a quota of blocks in one more pass; the last
block is trimmed so that the words come out exact. Output shards have fixed numbers of blocks. A tree halves the shards
again and again and draws, at each node, how many blocks of each source's pass go left from the multivariate
hypergeometric distribution, so quotas hold exactly and every shard is a fair sample of the mix. In each pass the blocks
are permuted by swap-or-not rounds (Hoang, Morris, Rogaway), a seeded random permutation of any number of blocks that
needs no table; a shard takes the next positions of the permuted order, so draws are disjoint. Each shard is put in the
order of a hash, which is a local shuffle.

Only the sources' totals reach the driver. A word's place in its stream comes from sums by hash bucket, running sums over
groups of buckets, over the buckets of a group, and within a bucket; their numbers grow with the input, so no task holds a
source. Everything follows from hashes and seeds: a rerun gives the same mix.

Defined cases: a null or wordless text has size 0 and is never drawn; a null source is a source, ordered last; repeated rows
are documents of their own; an empty table gives an empty one; all targets are 0 where all sizes are.
"""

from __future__ import annotations

from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import cut, table

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCK_WORDS, MOST_BLOCKS = 512, 400_000_000
SHARDS = 16
SEED, ROUNDS = 20, 24
ROWS_IN_BUCKET = 512
MAX_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source: by weight, none above ``most`` times its size, the excess shared by weight again."""
    wanted = [0.0] * len(sizes)
    rest = share * sum(sizes)
    free = [i for i in range(len(sizes))]
    while free:
        unit = rest / sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if weights[i % len(weights)] * unit > most * sizes[i]]
        for i in over or free:
            wanted[i] = float(most * sizes[i]) if over else weights[i % len(weights)] * unit
        rest -= sum(wanted[i] for i in over)
        free = [i for i in free if i not in set(over)] if over else []
    return wanted


class Pass(NamedTuple):
    """One pass over a source's blocks: those whose ``position`` is under ``drawn`` are taken."""

    number: int
    blocks: int
    drawn: int
    trim: int
    offsets: list[int]


def position(sid: Column, number: Column, block: Column, blocks: Column) -> Column:
    """Where a block stands in its pass's random order: in each round it changes places with its partner, or not."""

    def swap(x: Column, n: Column) -> Column:
        partner = F.pmod(F.xxhash64(F.lit(SEED), sid, number, n) - x, blocks)
        both = F.greatest(x, partner)
        return F.when(F.xxhash64(F.lit(SEED + 1), sid, number, n, both) < 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), block, swap)


def passes(size: int, target: float, block_words: int) -> list[tuple[int, int]]:
    """(blocks, words to take) of each pass that it takes to give round(target) words."""
    wanted = min(round(target), MOST * size)
    return [(-(-size // block_words), min(size, wanted - done)) for done in range(0, wanted, size)] if size else []


def drawn(size: int, blocks: int, words: int, last: int, block_words: int) -> tuple[int, int]:
    """How many blocks give so many words, and what is too much; ``last`` is the last block's position, which is a short one."""
    short = blocks * block_words - size
    n = -(-words // block_words)
    if n > last:
        n = max(last + 1, -(-(words + short) // block_words))
    return n, n * block_words - (short if n > last else 0) - words


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each quota by shard; shard k has as many blocks as the k-th of ``shards`` nearly equal parts."""
    total = int(quotas.sum())
    out = np.zeros((len(quotas), shards), np.int64)
    edge = [total * k // shards for k in range(shards + 1)]
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            out[:, low] = own
            continue
        middle = (low + high) // 2
        left = rng.multivariate_hypergeometric(own, edge[middle] - edge[low], method="marginals") if len(own) else own
        todo += [(low, middle, left), (middle, high, own - left)]
    return out


def draw(spark: SparkSession, sizes: list[int], wanted: list[float], shards: int = SHARDS, seed: int = SEED) -> tuple[int, list[list[Pass]]]:
    """Block size and each source's passes, with the positions at which each shard's share begins."""
    block_words = max(BLOCK_WORDS, -(-int(SHARE * sum(sizes)) // MOST_BLOCKS))
    own = [(i, n, blocks, words) for i, (s, t) in enumerate(zip(sizes, wanted)) for n, (blocks, words) in enumerate(passes(s, t, block_words))]
    at = position(F.col("sid"), F.col("number"), F.col("blocks") - 1, F.col("blocks"))
    rows = spark.createDataFrame([x[:3] for x in own], "sid long, number long, blocks long")
    last = {(r.sid, r.number): r["at"] for r in rows.select("sid", "number", at.alias("at")).collect()}
    found = [Pass(n, blocks, *drawn(sizes[i], blocks, words, last[i, n], block_words), []) for i, n, blocks, words in own]
    dealt = split(np.array([p.drawn for p in found], np.int64), shards, np.random.default_rng(seed))
    ends = np.concatenate([np.zeros((len(found), 1), np.int64), dealt.cumsum(axis=1)], axis=1).tolist()
    out: list[list[Pass]] = [[] for _ in sizes]
    for (i, *_), p, end in zip(own, found, ends):
        out[i].append(p._replace(offsets=end[:-1]))
    return block_words, out


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS, size_col: str | None = None) -> DataFrame:
    """``docs`` under the struct column ``doc``, with size, source_size, target, and ``pieces``: the parts that the mix takes.

    A piece has pass, block, shard, order_key (the shuffled order within its shard), word_from and word_to (counted in its
    document from 0, the end left out).
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
        docs[source_col].cast("string").alias("source"),
        (docs[size_col].cast("long") if size_col else words(docs[text_col])).alias("size"),
        docs[id_col].alias("id"),
        F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_hash"),
    )
    bits = max(4, (docs.count() // ROWS_IN_BUCKET).bit_length())
    rows = rows.withColumn("h", F.xxhash64(F.lit(SEED), "id", "size")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    by_bucket = cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    totals = by_bucket.groupBy("source").agg(F.sum("words").alias("words")).orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r.words for r in totals]
    wanted = targets(sizes)
    block_words, own = draw(spark, sizes, wanted, shards)
    kind = "sid long, source string, source_size long, target double, passes array<struct<number long, blocks long, drawn long, trim long, offsets array<long>>>"
    sources = spark.createDataFrame([(i, r.source, r.words, t, [tuple(p) for p in ps]) for i, (r, t, ps) in enumerate(zip(totals, wanted, own))], kind)
    # At most MAX_SOURCES rows.
    half = bits // 2
    grouped = by_bucket.withColumn("high", F.shiftrightunsigned("bucket", half))
    highs = grouped.groupBy("source", "high").agg(F.sum("words").alias("all"))
    highs = highs.select(F.col("source").alias("s"), F.col("high").alias("g"), (F.sum("all").over(Window.partitionBy("source").orderBy("high")) - F.col("all")).alias("high_start"))
    inside = F.sum("words").over(Window.partitionBy("source", "high").orderBy("bucket")) - F.col("words")
    starts = grouped.withColumn("inside", inside).join(highs, F.col("source").eqNullSafe(F.col("s")) & (F.col("high") == F.col("g")))
    starts = starts.select("source", "bucket", (F.col("high_start") + F.col("inside")).alias("bucket_start"))
    named = rows.join(F.broadcast(sources.select("sid", F.col("source").alias("s"), "source_size", "target", "passes")), rows.source.eqNullSafe(F.col("s"))).drop("s", "source")
    starts = starts.join(F.broadcast(sources.select("sid", F.col("source").alias("s"))), starts.source.eqNullSafe(F.col("s"))).select(
        F.col("sid").alias("at_sid"), F.col("bucket").alias("at_bucket"), "bucket_start"
    )
    placed = named.join(starts, (named.sid == starts.at_sid) & (named.bucket == starts.at_bucket))
    before = Window.partitionBy("sid", "bucket").orderBy("h", "id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("a", F.col("bucket_start") + F.sum("size").over(before) - F.col("size"))
    a, size = F.col("a"), F.col("size")

    def piece(p: Column, x: Column) -> Column:
        end = F.least(a + size, F.least("source_size", (x["block"] + 1) * block_words) - F.when(x["at"] == p["drawn"] - 1, p["trim"]).otherwise(0))
        return F.struct(
            p["number"].alias("pass"), x["block"].alias("block"), (F.size(F.filter(p["offsets"], lambda o: o <= x["at"])) - 1).alias("shard"),
            F.xxhash64(F.lit(SEED), "sid", p["number"], x["block"]).alias("order_key"), (F.greatest(a, x["block"] * block_words) - a).alias("word_from"), (end - a).alias("word_to"),
        )

    def of_pass(p: Column) -> Column:
        block = F.sequence(F.floor(a / block_words), F.floor((a + size - 1) / block_words))
        taken = F.transform(block, lambda b: F.struct(b.alias("block"), position(F.col("sid"), p["number"], b, p["blocks"]).alias("at")))
        taken = F.filter(taken, lambda x: x["at"] < p["drawn"])
        return F.filter(F.transform(taken, lambda x: piece(p, x)), lambda x: x["word_to"] > x["word_from"])

    pieces = F.coalesce(F.when(size > 0, F.flatten(F.transform("passes", of_pass))), F.array())
    return placed.select("doc", "size", "source_size", "target", pieces.alias("pieces"))


def blocks(planned: DataFrame) -> DataFrame:
    """A row for each piece, shard by shard in shuffled order: what a writer of the mix writes."""
    rows = planned.select("doc", F.explode("pieces").alias("piece")).select("doc", "piece.*")
    return rows.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", words(docs.text).alias("size")))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + x["word_to"] - x["word_from"])
    shards = F.array_join(F.array_sort(F.array_distinct(F.transform("pieces", lambda x: x["shard"]))).cast("array<string>"), ",")
    return plan(sized, size_col="size").select("doc.doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


QUERIES: dict[str, Any] = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
