"""Phrase collocations: n-gram counts from word-id suffix arrays, scored by their weakest cut.

Texts are cut into pieces at punctuation and line ends and pieces into words, of which numbers are made; words of two
languages are different words. A task sorts the suffixes of a shard of at most ``SHARD_WORDS`` words by prefix doubling in
numpy, as far as the longest phrase needs. Between neighbours in that order, the number of words that they share gives the
LCP intervals: a run of suffixes that share n words is an n-gram, its length the count. A wall between pieces is a number of
its own, so no interval reaches over it. A shard gives out each of its n-grams once, which is what combines counts before
they are shuffled, by phrase and language; sums there are exact. A text longer than a shard goes on in the next one, which
begins with the words that the last phrases of the shard before still need.

Most phrases of three words occur once, so they would be most of what is shuffled. They are counted in a second pass, of
those whose both pairs of words are frequent enough: a longer phrase can't be more frequent than its parts. The pairs are told
by a bitmap of fixed size; an infrequent one that it lets through costs a row and is counted like any other, so the bitmap
bears on the work only. It fills up as the corpus grows, and then the second pass shuffles more.

A phrase of frequency a that is cut into parts of frequencies l and r has the score floor(10^6 * a * a / (l * r)); its
lowest-scoring cut counts. Arithmetic is in decimals of 38 places, exact for frequencies up to 10^16. What is left after the
least frequency is joined by equi-joins on phrase and language.

Defined cases: a null text counts as empty; a null language is ``und``; repeated rows count again; texts without words, and
phrases over two pieces, give nothing; an empty table gives an empty result; equal scores are ordered by frequency and then
by the phrase's bytes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import cut, small_batches, table, tidied
from ravelin.session import ship

MOST_WORDS, LEAST, COVERED_PERCENT, TOP = 3, 10, 50, 2000
SHARD_WORDS, SLICE_BYTES, ROWS_OUT = 1 << 19, 4 << 20, 1 << 15
#: Bits of the bitmap of frequent phrases, places of each in it, and the blocks in which it is put together.
FILTER_BITS, PLACES, FILTER_BLOCKS = 1 << 26, 2, 64
KIND = "lang string, phrase string, f long"
#: Groups of a language that are ranked by themselves first.
RANK_PARTS = 64
#: Separators all become a full stop, which is one, and a tab a blank.
_PLAIN = bytes(ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b for b in range(256))


def suffix_order(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ordered by their next ``most`` numbers (at least), and how many of these each shares with the place before it."""
    n = len(ids)
    rank, sorted_by = ids.copy(), 1
    order = np.argsort(rank) if most == 1 else np.zeros(n, np.int64)
    while sorted_by < most:
        later = np.zeros(n, np.int64)
        later[: n - sorted_by] = rank[sorted_by:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + later
        order = np.argsort(key)  # the order of equal ones doesn't matter
        key = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        sorted_by *= 2
    shared = np.zeros(n, np.int64)
    same = np.ones(max(0, n - 1), bool)
    padded = np.concatenate((ids, np.full(most, -1)))
    for step in range(most):
        at = padded[order + step]
        same &= (at[1:] == at[:-1]) & (at[1:] >= 0)
        shared[1:] += same
    return order, shared


def intervals(ids: np.ndarray, walls: np.ndarray, starts: int, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of ``lengths``: the length, a place of each n-gram, and how often it begins before ``starts``."""
    n = len(ids)
    order, shared = suffix_order(ids, max(lengths))
    ends = np.flatnonzero(walls)
    room = np.append(ends, n)[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words up to the next wall
    for length in lengths:
        first = np.flatnonzero(shared < length)
        fits = (room[order] >= length) & (order < starts)
        count = np.add.reduceat(fits.astype(np.int64), first)
        kept = count > 0
        yield length, order[first[kept]], count[kept]


def word_hashes(words: list[bytes], languages: list[str]) -> np.ndarray:
    seeds = {lang: zlib.crc32(lang.encode("utf-8")) for lang in set(languages)}
    return np.fromiter(map(xxhash.xxh64_intdigest, words, map(seeds.__getitem__, languages)), np.uint64, len(words))


def places(hashes: list[np.ndarray], bits: int) -> Iterator[np.ndarray]:
    """Where phrases stand in a bitmap of ``bits``, a power of two, from the hashes of their first, second, ... words."""
    mixed = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        mixed = (mixed ^ h) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    for n in range(PLACES):
        yield (mixed >> np.uint64(32 * n) & np.uint64(bits - 1)).astype(np.int64)


def held(bitmap: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """Which phrases are in the bitmap, or seem to be."""
    return np.logical_and.reduce([bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1 for at in places(hashes, 8 * len(bitmap))])


class Shard:
    """Gathers words; gives out n-grams of ``lengths`` when it is full. With a bitmap, only those whose parts that are a word
    shorter are in it."""

    def __init__(self, lengths: tuple[int, ...], size: int, bitmap: np.ndarray | None = None) -> None:
        self.lengths, self.most, self.size, self.bitmap = lengths, max(lengths), size, bitmap
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = []
        self.language_of: list[int] = []
        self.languages: list[str] = []
        self.numbers: dict[str, Any] = {}
        self.parts: list[np.ndarray] = []
        self.length = 0

    def _numbering(self, language: str) -> Any:
        found = self.numbers.get(language)
        if found is None:
            at = len(self.languages)
            self.languages.append(language)

            class Numbers(dict):
                def __missing__(own, word: bytes) -> int:  # noqa: N805
                    own[word] = n = len(self.words)
                    self.words.append(word)
                    self.language_of.append(at)
                    return n

            found = self.numbers[language] = Numbers({b".": -1})
        return found

    def add(self, language: str, words: list[bytes]) -> None:
        """Words, a full stop between pieces."""
        number = self._numbering(language)
        self.parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        self.length += len(words)

    def out(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Phrases and counts; what begins with one of the last words waits for those that follow, unless this is the last."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        waits = 0 if last else min(len(ids), self.most - 1)
        walls = ids < 0
        ids[walls] = len(self.words) + np.arange(int(walls.sum()))
        if len(ids):
            words = pa.array(self.words, pa.binary()).cast(pa.string())
            tags = pa.array(self.languages, pa.string()).take(pa.array(self.language_of, pa.int64()))
            total = defaultdict(int)
            own_hashes = None if self.bitmap is None else np.append(word_hashes(self.words, [self.languages[n] for n in self.language_of]), np.uint64(0))[np.minimum(ids, len(self.words))]
            for length, at, count in intervals(ids, walls, len(ids) - waits, self.lengths):
                if own_hashes is not None:
                    kept = np.logical_and.reduce([held(self.bitmap, [own_hashes[at + first + k] for k in range(length - 1)]) for first in (0, 1)])
                    at, count = at[kept], count[kept]
                for low in range(0, len(at), ROWS_OUT):
                    own = at[low : low + ROWS_OUT]
                    if length == 1:
                        for n, c in zip(ids[own].tolist(), count[low : low + ROWS_OUT].tolist()):
                            total[self.language_of[n]] += c
                    parts = [words.take(pa.array(ids[own + k])) for k in range(length)]
                    phrase = pc.binary_join_element_wise(*parts, " ")
                    yield _batch(tags.take(pa.array(ids[own])), phrase, count[low : low + ROWS_OUT])
            if total:
                yield _batch(pa.array([self.languages[n] for n in total]), pa.array([""] * len(total)), np.array(list(total.values())))
        tail = [("", b".") if walls[n] else (self.languages[self.language_of[ids[n]]], self.words[ids[n]]) for n in range(len(ids) - waits, len(ids))]
        self.clear()
        for language, word in tail:
            self.add(language, [word])


def _batch(languages: pa.Array, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([languages.cast(pa.string()), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "phrase", "f"])


def slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in A-Z, with a full stop between pieces and at the end, a bounded number at a time."""
    raw = text.encode("utf-8").lower().translate(_PLAIN)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].replace(b".", b" . ").split()
        at = end
    yield [b"."]


def shard_counts(docs: DataFrame, lengths: tuple[int, ...], text_col: str = "text", lang_col: str = "lang", bitmap: np.ndarray | None = None, size: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase and f, the n-grams of each shard with their counts; for single words also the number of all, as a
    phrase of no words."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(lengths, size, shared.value)
        for batch in batches:
            for language, text in zip(*batch.columns):
                for words in slices(text.as_py()):
                    for low in range(0, len(words), size):
                        shard.add(language.as_py(), words[low : low + size])
                        if shard.length >= size:
                            yield from shard.out(False)
        yield from shard.out(True)

    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")), F.coalesce(docs[text_col], F.lit("")))
    return rows.mapInArrow(tidied(run), KIND)


def merged(own: DataFrame, least: int) -> DataFrame:
    """The counts of all shards together, of phrases that occur ``least`` times or more."""
    own = own.repartition("lang", "phrase")  # shards have combined already
    total = own.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))
    return total.select("lang", "phrase", F.when(F.col("phrase") != "", F.size(F.split("phrase", " "))).otherwise(0).alias("words"), "f")


def frequent_bitmap(grams: DataFrame, total_bits: int = FILTER_BITS) -> np.ndarray:
    """The bitmap of phrases (lang, phrase). Tasks give their parts of it in blocks, which are put together by block."""
    size = total_bits // 8 // FILTER_BLOCKS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(total_bits, bool)
        for batch in batches:
            by_length = defaultdict(list)
            for lang, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                words = phrase.encode("utf-8").split(b" ")
                by_length[len(words)].append((lang, words))
            for length, rows in by_length.items():
                langs = [lang for lang, _ in rows]
                for at in places([word_hashes([w[k] for _, w in rows], langs) for k in range(length)], total_bits):
                    bits[at] = True
        packed = np.packbits(bits, bitorder="little").reshape(FILTER_BLOCKS, size)
        kept = [n for n in range(FILTER_BLOCKS) if packed[n].any()]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([zlib.compress(packed[n].tobytes(), 1) for n in kept], pa.binary())], names=["part", "bits"])

    def join(own: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint8)
        for raw in own.column("bits"):
            total |= np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
        return pa.table({"part": own.column("part")[:1], "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    parts = grams.select("lang", "phrase").mapInArrow(tidied(mark), "part int, bits binary")
    parts = parts.withColumn("salt", F.spark_partition_id() % 16).groupBy("part", "salt").applyInArrow(lambda t: join(t.select(["part", "bits"])), "part int, bits binary")
    out = np.zeros((FILTER_BLOCKS, size), np.uint8)
    for r in parts.groupBy("part").applyInArrow(join, "part int, bits binary").collect():
        out[r.part] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out.ravel()


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST, bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, words, f: of all phrases of up to ``most`` words that occur ``least`` times or more; and the number of all
    words with an empty phrase."""
    known = cut(merged(shard_counts(docs, tuple(range(1, min(most, 2) + 1)), text_col, lang_col), least))
    for length in range(3, most + 1):
        shorter = known.where(F.col("words") == length - 1)
        if shorter.isEmpty():
            break
        known = known.unionByName(cut(merged(shard_counts(docs, (length,), text_col, lang_col, frequent_bitmap(shorter, bits)), least)))
    return known


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST, covered: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases of 2 to ``most`` words.

    A phrase is left out if a longer one of at least ``covered`` percent of its frequency holds it."""
    known = counts(docs, text_col, lang_col, most, least)
    grams = known.where("words > 0")
    totals = known.where("words = 0").select("lang", F.col("f").alias("n"))
    of = grams.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    long = grams.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    # A row for each cut of each candidate, and its parts' frequencies by two equi-joins; both parts occur as often at least.
    split = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = split.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    cuts = cuts.join(of.withColumnsRenamed({"part": "first", "part_f": "l"}), ["lang", "first"])
    cuts = cuts.join(of.withColumnsRenamed({"part": "rest", "part_f": "r"}), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) * 1000000BD) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    worst = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("at"))
    # What longer candidates hold: each of their parts of 2 words or more, with the greatest frequency of such a one.
    spans = [(at, size) for size in range(2, most) for at in range(most - size + 1)]
    held = [
        long.where(F.col("words") >= at + size).where(F.col("words") > size).select("lang", F.expr(f"substring_index(substring_index(phrase, ' ', {at + size}), ' ', -{size})").alias("phrase"), "a") for at, size in spans
    ]
    if held:
        inner = held[0]
        for more in held[1:]:
            inner = inner.unionByName(more)
        holders = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        worst = worst.join(holders, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    found = worst.select("lang", "phrase", "a", F.col("at.l").alias("l"), F.col("at.r").alias("r"), "at.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's last ranking is of at most top * RANK_PARTS phrases, whatever the corpus.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    found = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_SQL = """WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
    ), q AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
    ), w AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM q
    ), t AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)
    ), g AS (SELECT lang, 1 AS words, w1 AS phrase FROM t UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM t WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM t WHERE w3 IS NOT NULL
    ), f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL
    ), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
    ), e AS MATERIALIZED (SELECT * FROM f WHERE f >= 10
    ), c AS MATERIALIZED (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM e WHERE words > 1
    ), x AS MATERIALIZED (SELECT c.*, e.f AS l FROM (SELECT *, unnest(generate_series(1, words - 1)) AS k FROM c) c JOIN e ON e.lang = c.lang AND e.phrase = array_to_string(c.w[1:k], ' ')
    ), k AS (SELECT x.lang, x.phrase, a, k, l, e.f AS r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * e.f))::BIGINT AS score FROM x JOIN e ON e.lang = x.lang AND e.phrase = array_to_string(x.w[k + 1:], ' ')
    ), worst AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), h AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE words = 3) GROUP BY ALL
    ), kept AS (SELECT worst.* FROM worst LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": _SQL}
