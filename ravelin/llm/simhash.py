"""SimHash near-duplicates: fingerprints, pivot distance tables, exact links at a Hamming distance, components.

A table holds the Hamming distances of every distinct fingerprint to ``PIVOTS`` reference fingerprints. By the triangle
inequality two fingerprints whose distances to any pivot differ by more than the threshold can't link, so the largest
coordinate difference discards pairs before the fingerprints themselves are compared; survivors are verified exactly.

Which pairs meet is settled by pigeonhole: of ``blocks`` blocks of bits, at most 4 hold the differences of a linked pair,
so it agrees on all of at least ``blocks - 4`` blocks, and every choice of that many blocks is a bucket key. The number of
blocks follows the number of fingerprints (``plan``), which bounds the expected pairs for each. Equal fingerprints are
one row before any of this. Within a bucket, a linked fingerprint is taken out when it is first reached, so a dense bucket
takes about one comparison a member, and a bucket gives at most a spanning forest's edges if it has more than
``SMALL`` members: pairs of a group of copies are never listed. A bucket of more than ``TILE`` members is split into parts
that meet pairwise, each pair of parts a bucket of its own, so no task holds a large group.

Defined cases: a null or wordless text has fingerprint zero and links like any other; fewer words than a shingle make one
shingle; repeated rows and ids are kept, each with its component; a component's id is its least non-null doc_id; an empty
table gives an empty one; other columns may have any name.

``similar_groups`` is the same operator for links that are too wide for keys of bits: texts whose sets of five-word shingles
have a Jaccard similarity of at least 4/5, about 39 of 256 bits. There, who meets is settled by rare shingles: in any one
order of all shingles, two linked sets share one of the first ``n - ceil(4n / 5) + 1`` shingles of each. Fingerprints of
256 bits of those that meet are held against reference fingerprints of their bucket, those whose distance to one differs
by more than ``REACH`` are discarded, and what is then within ``REACH`` itself is near. Groups of near sets are small, and
in each of them whole sets decide. Both steps take a set out when it is first reached, so groups of copies, dense ones or
a text with thousands of variants, cost about a comparison a member, and forests of links are all that is given out. A
linked pair's bits differ with a probability of 0.19 at most, so that ``REACH`` loses one is less likely than 10^-6 for
sets of five shingles and than 10^-11 for larger ones. The order puts shingles that a sample of the rows holds often last,
so what many texts repeat is hardly ever a key; the order, and so the sample, bears on the work only.

Its defined cases: equal sets are one before any of this; fewer words than a shingle make one shingle; texts without words
are one group; rows may repeat and ids be null, as each row is known by its hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import cut, map_rows, scratch, small_batches, table, tidied
from ravelin.llm.components import components
from ravelin.session import ship

SHINGLE_WORDS, SEED, DISTANCE = 4, 42, 4
PIVOTS, PIVOT_SEED = 32, 7
SMALL, TILE = 8, 65_536
#: Keys of large buckets are broadcast up to this many, and joined beyond.
MOST_BROADCAST = 200_000
#: Of links by similarity: words in a shingle, words of 64 bits in a fingerprint, and the distance that links stay within.
SIMILAR_WORDS, WIDE, REACH = 5, 4, 80
REFERENCES, SIMILAR_TILE, MOST_SHINGLES = 16, 8192, 1 << 20
#: Rows of the sample that tells frequent shingles, and how many of these are put last at most.
SAMPLE_ROWS, MOST_FREQUENT = 2000, 50_000


def shingle_hashes(text: str | None, words_in_shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; none without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - words_in_shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of 64-bit words, the bits that are set in over half of the rows."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 32768):
        part = np.ascontiguousarray(hashes[at : at + 32768]).astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """64 bits; bit i is set if it is set in over half of the shingles' XXH64."""
    hashes = shingle_hashes(text, words_in_shingle)
    return int(majority(hashes[:, None])[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def each(key: Any, text: str | None) -> Iterable[tuple[Any, ...]]:
        f = fingerprint(text, words_in_shingle)
        yield key, f - (f >> 63 << 64)

    return map_rows(docs, [id_col, text_col], lambda: each, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def pivots() -> np.ndarray:
    return np.random.default_rng(PIVOT_SEED).integers(0, 2**64, PIVOTS, np.uint64)


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """uint8, a row for each fingerprint and a column for each pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in pivots()], axis=1)


def pivot_table(distinct: DataFrame) -> DataFrame:
    """fp with its distances as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = pivot_distances(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            raw = pa.py_buffer(np.ascontiguousarray(near).tobytes())
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(near), [None, raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), fixed.cast(pa.binary())], names=["fp", "near"])

    return distinct.select("fp").mapInArrow(tidied(run), "fp long, near binary")


def plan(n: int, distance: int = DISTANCE) -> tuple[int, list[int]]:
    """Number of blocks for n fingerprints, and the bit mask of each choice of blocks that a linked pair may agree on.

    Blocks are added until a bucket of unrelated fingerprints is expected to hold at most 16."""
    extra = 1
    while True:
        blocks = distance + extra
        edges = [64 * i // blocks for i in range(blocks + 1)]
        masks = [sum((1 << edges[b + 1]) - (1 << edges[b]) for b in own) for own in combinations(range(blocks), extra)]
        if extra >= 2 and n < 16 << min(m.bit_count() for m in masks):
            return blocks, masks
        extra += 1


def _survivors(near: np.ndarray, own: np.ndarray, fps: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """Which rows of ``near`` and ``fps`` link with ``own`` and ``fp``: by pivots, a few columns first, then exactly."""
    left = np.flatnonzero((np.abs(near[:, :8].astype(np.int8) - own[..., :8].astype(np.int8)) <= distance).all(axis=1))
    pick = lambda x: x[left] if x.ndim == near.ndim and len(x) == len(near) else x
    left = left[(np.abs(near[left, 8:].astype(np.int8) - pick(own)[..., 8:].astype(np.int8)) <= distance).all(axis=1)]
    other = fp[left] if np.ndim(fp) else fp
    return left[np.bitwise_count(fps[left] ^ other) <= distance]


def bucket_links(fps: np.ndarray, near: np.ndarray, bounds: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that connect just what links connect within each bucket; ``bounds`` are the buckets' first rows and the end."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    sizes = np.diff(bounds)
    small = (sizes > 1) & (sizes <= SMALL)
    rows = np.repeat(small, sizes)
    ends = np.repeat(bounds[1:], sizes)
    at = np.flatnonzero(rows)
    for step in range(1, SMALL):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        found = at[_survivors(near[at], near[at + step], fps[at], fps[at + step], distance)]
        a.append(fps[found])
        b.append(fps[found + step])
    for n in np.flatnonzero(sizes > SMALL):
        start, end = bounds[n], bounds[n + 1]
        own_fps, own_near, left = fps[start:end], near[start:end], np.arange(end - start)
        while len(left) > 1:
            queue, left, members = [left[0]], left[1:], [left[:1]]
            while queue and len(left):
                i = queue.pop()
                hit = _survivors(own_near[left], own_near[i], own_fps[left], own_fps[i], distance)
                if len(hit):
                    reached = left[hit]
                    left = np.delete(left, hit)
                    queue.extend(reached.tolist())
                    members.append(reached)
            if len(members) > 1:
                group = own_fps[np.concatenate(members)]
                a.append(group)  # the least has an edge to itself, which is left out later
                b.append(np.full(len(group), group.view(np.int64).min().view(np.uint64)))
    return a, b


def tiled(rows: DataFrame, keys: list[str], by: str, most: int, weight: str = "1") -> DataFrame:
    """``rows`` with a column ``tile``. A bucket that weighs more than ``most`` is split by a hash of ``by`` into parts, and
    each row is in a tile for each part that its own meets, so every two rows of a bucket meet in a tile and no tile is large."""
    counts = rows.groupBy(*keys).agg(F.sum(F.expr(weight)).alias("count"))
    large = cut(counts.where(F.col("count") > most).select(*[F.col(k).alias(f"of_{k}") for k in keys], F.expr(f"(count + {most - 1}) div {most}").alias("parts")))
    if large.isEmpty():
        return rows.withColumn("tile", F.lit(0).cast("long"))
    side = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    tiles = F.expr(f"transform(sequence(0L, coalesce(parts, 1L) - 1), p -> least(p, pmod(xxhash64({by}), coalesce(parts, 1L))) * coalesce(parts, 1L) + greatest(p, pmod(xxhash64({by}), coalesce(parts, 1L))))")
    found = rows.join(side, [F.col(k) == F.col(f"of_{k}") for k in keys], "left")
    return found.select(*rows.columns, F.explode(tiles).alias("tile"))


def buckets(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1 << 17) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The columns of whole buckets, and where each begins, and the end. Rows come sorted by the first ``keys`` columns; a
    binary column of a fixed length gives a row of bytes each. ``rows`` are held at a time, or the largest bucket."""
    held: list[list[np.ndarray]] = []
    size, wait = 0, rows

    def ready(last: bool) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        nonlocal size, wait
        whole = [np.concatenate(x) for x in zip(*held)]
        differ = np.logical_or.reduce([whole[k][1:] != whole[k][:-1] for k in range(keys)])
        starts = np.flatnonzero(np.concatenate(([True], differ)))
        keep = len(whole[0]) if last else int(starts[-1])
        held[:] = [] if last else [[c[keep:] for c in whole]]
        size = len(whole[0]) - keep
        wait = max(rows, 2 * size)  # a bucket larger than that waits for twice as many rows
        if keep:
            yield [c[:keep] for c in whole], np.append(starts[starts < keep], keep)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = []
        for c in batch.columns:
            if pa.types.is_binary(c.type):
                columns.append(np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1))
            else:
                columns.append(c.to_numpy(zero_copy_only=False))
        held.append(columns)
        size += batch.num_rows
        if size >= wait:
            yield from ready(False)
    if held:
        yield from ready(True)


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if a:
        pairs = np.unique(np.stack([np.concatenate(x).view(np.int64) for x in (a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs.T], names=["a", "b"])


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints with the same components as all links at ``distance``."""
    known = cut(pivot_table(distinct))
    _, masks = plan(known.count(), distance)
    keys = F.array(*[F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))).alias("key")) for n, m in enumerate(masks)])
    keyed = known.select("fp", "near", F.explode(keys).alias("k")).select("k.choice", "k.key", "fp", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, fps, near), bounds in buckets(batches, 3):
            yield from _edges(*bucket_links(fps.view(np.uint64), near, bounds, distance))

    rows = tiled(keyed, ["choice", "key"], "fp", TILE).select("choice", "key", "tile", "fp", "near")
    return rows.repartition("choice", "key", "tile").sortWithinPartitions("choice", "key", "tile").mapInArrow(tidied(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that links lead to, for each row."""
    own = cut(fingerprints(docs, id_col, text_col, words_in_shingle).select(F.col(id_col).alias("doc_id"), "fp"))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, distance))
    rooted = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "component_id"))
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, words_in_shingle: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, words_in_shingle))


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """``WIDE`` words of 64 bits of a set of shingles; the words come from hashes of the shingles' hashes."""
    mixed = np.empty((len(own), WIDE), np.uint64)
    for n in range(WIDE):
        x = own + np.uint64((n + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed[:, n] = x ^ (x >> np.uint64(31))
    return majority(mixed) if len(own) else np.zeros(WIDE, np.uint64)


def with_hashes(docs: DataFrame) -> DataFrame:
    """The row under ``doc``, so that its columns may have any name; its doc_id and text; a hash of the text of two longs, and
    a hash of the row."""
    text = F.coalesce(docs["text"], F.lit(""))
    columns = [docs[f"`{c}`"] for c in docs.columns]
    hashes = F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.xxhash64(*columns).alias("row_hash")
    return docs.select(F.struct(*columns).alias("doc"), docs["doc_id"], docs["text"], *hashes)


def _frequent(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in more than one row of a sample, in order, and in how many."""
    part = docs.where(F.expr(f"pmod(row_hash, {max(1, rows // SAMPLE_ROWS)}) = 0")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], names=["s"])

    found = part.mapInArrow(tidied(run), "s long").groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).toArrow()
    values = found["s"].to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], found["count"].to_numpy()[order]


_WORDS = [f"f{i}" for i in range(WIDE)]


def _profiles(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The hashes of each row, with its set: two digests, its size, the fingerprint's words and the shingles of the prefix."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    own = docs.select("doc_id", "t1", "t2", "row_hash", "text")
    kind = f"set long, check long, n int, {', '.join(f'{w} long' for w in _WORDS)}, prefix array<long>"
    out = T.StructType([*own.drop("text").schema, *T._parse_datatype_string(kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            made, sizes, parts = np.empty((2 + WIDE, batch.num_rows), np.uint64), [], []
            for i, text in enumerate(batch.column(4)):
                s = shingles(text.as_py())
                n = len(s)
                made[:2, i] = xxhash.xxh64_intdigest(s.tobytes()), xxhash.xxh64_intdigest(s.tobytes(), 1)
                made[2:, i] = wide_fingerprint(s)
                sizes.append(n)
                if n and len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]
                parts.append(s[: n - -(-4 * n // 5) + 1])
            longs = [pa.array(x) for x in made.view(np.int64)]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *longs[:2], pa.array(sizes, pa.int32()), *longs[2:], prefix], names=out.names)

    return own.mapInArrow(tidied(run), out)


def near_forest(fps: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one bucket that connect just what is connected by fingerprints within ``REACH`` and sizes of 4 to 5."""
    m = len(fps)
    references = fps[np.unique(np.linspace(0, m - 1, min(m, REFERENCES)).astype(int))] if m > SMALL else fps[:1]
    table = np.bitwise_count(fps[:, None, :] ^ references).sum(axis=2, dtype=np.int16)
    a, b, left = [], [], np.arange(m)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = np.flatnonzero((np.abs(table[left] - table[i]) <= REACH).all(axis=1) & (5 * np.minimum(n[left], n[i]) >= 4 * np.maximum(n[left], n[i])))
            hit = hit[np.bitwise_count(fps[left[hit]] ^ fps[i]).sum(axis=1, dtype=np.int64) <= REACH]
            if len(hit):
                a.append(np.full(len(hit), i))
                b.append(left[hit])
                queue.extend(left[hit].tolist())
                left = np.delete(left, hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def linked_forest(sets: list[np.ndarray], fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs of rows that connect just what links connect; whole sets decide."""
    n = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(n)[:-1])
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    a, b, left = [], [], np.arange(len(sets))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.flatnonzero((5 * np.minimum(n[left], n[i]) >= 4 * np.maximum(n[left], n[i])) & (np.bitwise_count(fps[left] ^ fps[i]).sum(axis=1, dtype=np.int64) <= REACH))
            mark[own[i]] = True
            hit = [k for k in near.tolist() if 9 * np.count_nonzero(mark[own[left[k]]]) >= 4 * (n[i] + n[left[k]])]
            mark[own[i]] = False
            if hit:
                reached = left[hit].tolist()
                a += [i] * len(hit)
                b += reached
                queue += reached
                left = np.delete(left, hit)
    return a, b


def _near(keyed: DataFrame) -> DataFrame:
    """Edges (a, b) of near sets, from a row (key, set, n and the fingerprint's words) for each key of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, own, n, *words), bounds in buckets(batches, 2):
            fps = np.stack(words, axis=1).view(np.uint64)
            a, b = [], []
            for at in np.flatnonzero(np.diff(bounds) > 1):
                low, high = bounds[at], bounds[at + 1]
                i, j = near_forest(fps[low:high], n[low:high])
                a.append(np.minimum(own[low + i], own[low + j]))
                b.append(np.maximum(own[low + i], own[low + j]))
            yield from _edges(a, b)

    rows = tiled(keyed, ["key"], "set", SIMILAR_TILE).select("key", "tile", "set", "n", *_WORDS)
    return rows.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(tidied(run), "a long, b long").distinct()


def _linked(texts: DataFrame) -> DataFrame:
    """Edges (a, b) of linked sets within groups, from (root, set, n, the fingerprint's words, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, own, _, *words, texts), bounds in buckets(batches, 2, 1 << 12):
            fps = np.stack(words, axis=1).view(np.uint64)
            a, b = [], []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                i, j = linked_forest([shingles(t) for t in texts[low:high]], fps[low:high])
                a.append(own[low:high][i])
                b.append(own[low:high][j])
            yield from _edges(a, b)

    rows = tiled(texts, ["root"], "set", MOST_SHINGLES, "n + 500L").select("root", "tile", "set", "n", *_WORDS, "text")
    return rows.repartition("root", "tile").sortWithinPartitions("root", "tile").mapInArrow(tidied(run), "a long, b long")


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, row_hash of each row of ``with_hashes``, and its group in ``group`` and ``part``."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    with scratch(spark) as stored:
        own = stored(_profiles(docs, _frequent(docs, docs.count())))
        once = own.select("set", "n", *_WORDS, "prefix").dropDuplicates(["set"])
        keyed = once.select("set", F.explode("prefix").alias("key"))
        shared = keyed.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("key")
        met = stored(keyed.join(shared.hint("merge"), "key"))
        profiles = own.select("set", "n", *_WORDS, "t1", "t2", "row_hash").groupBy("set").agg(F.min(F.struct("t1", "t2", "row_hash", "n", *_WORDS)).alias("r")).select("set", "r.*")
        near = components(_near(met.join(profiles.select("set", "n", *_WORDS).hint("merge"), "set")))
        near = cut(near.join(profiles.hint("merge"), F.col("node") == F.col("set")).drop("node"))
        side = F.broadcast(near) if near.count() <= MOST_BROADCAST else near.hint("merge")
        texts = docs.select("t1", "t2", "row_hash", "text").join(side, ["t1", "t2", "row_hash"]).select("root", "set", "n", *_WORDS, "text")
        named = components(_linked(stored(texts)))
        # Rows of two different sets with one digest aren't copies: the second digest tells.
        checks = own.groupBy("set").agg(F.min("check").alias("known"))
        named = checks.join(named.hint("merge"), F.col("set") == F.col("node"), "left").select("set", F.coalesce("root", "set").alias("root"), "known")
        found = own.select("doc_id", "t1", "t2", "row_hash", "set", "check").join(named.hint("merge"), "set")
        return cut(found.select("doc_id", "t1", "t2", "row_hash", F.col("root").alias("group"), F.when(F.col("check") != F.col("known"), F.col("check")).otherwise(0).alias("part")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
