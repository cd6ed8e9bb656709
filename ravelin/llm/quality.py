"""Quality by random-indexing word vectors and a two-layer numpy network with temperature-calibrated probabilities.

Random indexing (Kanerva, Sahlgren): every word type has a sparse random index vector, here two signed places of
``DIMENSIONS``; a word's context vector is the sum of the index vectors of its neighbours, over the whole corpus. The sums
are integers, so they don't depend on order and a rerun gives the same vectors. Types are hashed within classes of shape
(lower case, capitalised, upper case, digits, punctuation, ...), so a rare word shares the contexts of its kind. Each task
adds up its own part of the matrix and gives it out in row blocks; blocks are summed by a shuffle of a bounded number of
rows a task. Counts cover all documents.

A document's features pool its words' vectors: their mean, their standard deviation, and how alike neighbours are. A
network of one hidden layer is fitted by Adam on a bounded sample of labelled rows (see ``labels``), and a temperature
and a bias on rows of it that weren't fitted. Labels, lang, source and ids are never inputs of a score.

Defined cases: a null text is scored as an empty one; a text without words has features of zero; without two classes to
learn from, every score is 1, which rejects nothing; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.bpe import Memory
from ravelin.llm.common import CHUNK_BYTES, map_chunks, small_batches, table, text_udf, tidied
from ravelin.llm.labels import held_out, sample
from ravelin.session import ship

CLASS_BITS, HASH_BITS, DIMENSIONS, WINDOW, SEED = 3, 12, 32, 2, 5
TYPES = 1 << CLASS_BITS + HASH_BITS
ROW_BLOCKS = 64
HIDDEN, EPOCHS, RATE, BATCH, DECAY = 24, 60, 3e-3, 32, 1e-3
THRESHOLD = 0.3
CACHE_ENTRIES = 150_000
_TOKENS = re.compile(r"\w+|[^\w\s]+").findall


def shape(word: str) -> int:
    """A word's class, 0 to 7."""
    if word.isalpha():
        return 0 if word.islower() else 2 if word.isupper() and len(word) > 1 else 1 if word[1:].islower() or len(word) == 1 else 3
    if word.isdecimal():
        return 4
    if word.isalnum() or "_" in word:
        return 5
    return 6 if len(word) == 1 else 7


class Types(Memory):
    """Type numbers of texts' words."""

    def of(self, texts: list[str]) -> list[np.ndarray]:
        split = [_TOKENS(t) for t in texts]
        for word in self.missing(set(chain.from_iterable(split))):
            self[word] = shape(word) << HASH_BITS | xxhash.xxh32_intdigest(word, SEED) & (1 << HASH_BITS) - 1
        return [np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in split]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The two places of each type's index vector and their signs."""
    rng = np.random.default_rng(SEED)
    first = rng.integers(0, DIMENSIONS, TYPES)
    second = (first + rng.integers(1, DIMENSIONS, TYPES)) % DIMENSIONS
    return np.stack([first, second]), rng.choice([-1.0, 1.0], (2, TYPES))


def add_contexts(total: np.ndarray, texts: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> None:
    """Adds the neighbours' index vectors to ``total`` (TYPES * DIMENSIONS, flat)."""
    gap = np.full(WINDOW, -1)
    ids = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
    for start in range(0, len(ids), 1 << 18):
        part = ids[start : start + (1 << 18) + WINDOW]
        at, weight = [], []
        for step in range(1, WINDOW + 1):
            own = slice(0, min(1 << 18, len(part) - step))  # pairs that begin in this part
            a, b = part[own], part[step : own.stop + step]
            near = (a >= 0) & (b >= 0)
            a, b = a[near], b[near]
            for x, y in ((a, b), (b, a)):
                for n in range(2):
                    at.append(x * DIMENSIONS + places[n, y])
                    weight.append(signs[n, y])
        total += np.bincount(np.concatenate(at), np.concatenate(weight), minlength=len(total)).astype(np.int64)


def contexts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The corpus's context vectors, TYPES by DIMENSIONS; their size doesn't depend on the corpus."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = TYPES // ROW_BLOCKS * DIMENSIONS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        types, total = Types(CACHE_ENTRIES), np.zeros(TYPES * DIMENSIONS, np.int64)
        for batch in batches:
            step = max(1, min(512, batch.num_rows * CHUNK_BYTES // 2 // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                add_contexts(total, types.of([t or "" for t in batch.column(0).slice(at, step).to_pylist()]), places, signs)
        dealt = total.reshape(TYPES, DIMENSIONS)  # a block has every ROW_BLOCKS-th row, so blocks are alike
        kept = [n for n in range(ROW_BLOCKS) if dealt[n::ROW_BLOCKS].any()]
        packed = [zlib.compress(dealt[n::ROW_BLOCKS].tobytes(), 1) for n in kept]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(packed, pa.binary())], names=["part", "sums"])

    def add(own: pa.Table) -> pa.Table:
        total = np.zeros(rows, np.int64)
        for raw in own.column("sums"):
            total += np.frombuffer(zlib.decompress(raw.as_py()), np.int64)
        return pa.table({"part": own.column("part")[:1], "sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    kind = "part int, sums binary"
    parts = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(tidied(count), kind)
    # First within each of a number of groups, so that no task takes a row from every other.
    parts = parts.withColumn("salt", F.spark_partition_id() % 16).groupBy("part", "salt").applyInArrow(lambda t: add(t.select(["part", "sums"])), kind)
    out = np.zeros((TYPES, DIMENSIONS), np.int64)
    for r in parts.groupBy("part").applyInArrow(add, kind).collect():
        out[r.part :: ROW_BLOCKS] = np.frombuffer(zlib.decompress(r.sums), np.int64).reshape(-1, DIMENSIONS)
    return out


def vectors(counts: np.ndarray) -> np.ndarray:
    """Unit vectors; zero for types without context."""
    v = np.sign(counts) * np.sqrt(np.abs(counts))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return (v / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A document's features."""
    if not len(ids):
        return np.zeros(2 * DIMENSIONS + 3, np.float32)
    first, second, alike, same, before = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0, None
    for start in range(0, len(ids), 16384):
        part = ids[start : start + 16384]
        v = words[part]
        first += v.sum(axis=0, dtype=np.float64)
        second += np.einsum("ij,ij->j", v, v, dtype=np.float64)
        if before is not None:
            part, v = np.concatenate((before[0], part)), np.concatenate((before[1], v))
        alike += float(np.einsum("ij,ij->", v[1:], v[:-1], dtype=np.float64))
        same += int((part[1:] == part[:-1]).sum())
        before = part[-1:], v[-1:]
    n, pairs = len(ids), max(1, len(ids) - 1)
    mean = first / n
    deviation = np.sqrt(np.maximum(second / n - mean * mean, 0))
    return np.concatenate((mean, deviation, [alike / pairs, same / pairs, np.linalg.norm(mean)])).astype(np.float32)


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    bias: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature + self.bias, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Adam on the cross-entropy, both classes weighing the same."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    parts = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    weight = np.where(y == 1, len(y) / (2 * max(1, (y == 1).sum())), len(y) / (2 * max(1, (y == 0).sum())))
    steps = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            h = np.tanh(z[own] @ parts[0] + parts[1])
            error = (1 / (1 + np.exp(-(h @ parts[2] + parts[3]))) - y[own]) * weight[own] / len(own)
            inner = np.outer(error, parts[2]) * (1 - h * h)
            gradients = [z[own].T @ inner + DECAY * parts[0], inner.sum(axis=0), h.T @ error + DECAY * parts[2], error.sum(keepdims=True)]
            steps += 1
            for p, g, a, b in zip(parts, gradients, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.999**steps)) + 1e-8)
    return Network(mean, scale, parts[0], parts[1], parts[2], float(parts[3][0]))


def calibrate(network: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature and bias of least cross-entropy on rows that weren't fitted, by Newton's method on 1/temperature."""
    z = network.logit(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
        hessian = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(hessian, gradient), -0.5, 0.5)
        a, b = max(0.05, a - step[0]), b - step[1]
    return network._replace(temperature=1 / a, bias=b)


class Model(NamedTuple):
    words: np.ndarray
    network: Network | None


def features(docs: DataFrame, words: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """id and features of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def start() -> Callable[..., Iterable[tuple[Any, ...]]]:
        types = Types(CACHE_ENTRIES)
        return lambda keys, texts: [(k, pool(x, shared.value).tolist()) for k, x in zip(keys, types.of([t or "" for t in texts]))]

    return map_chunks(docs, [id_col, text_col], start, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, features array<float>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Word vectors from all of ``docs``, and the network from the labelled sample, a quarter of which calibrates."""
    words = vectors(contexts(docs, text_col))
    picked = sample(docs.sparkSession, docs, labels, label_col, id_col, text_col, most_bytes=None)  # features are of one size
    known = picked.select(F.struct("key", "label").alias("known"), "text")
    rows = sorted((r.known.key, r.known.label, r.features) for r in features(known, words, "known", "text").collect())
    y = np.array([r[1] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(words, None)
    x = np.array([r[2] for r in rows], np.float64)
    rank = np.zeros(len(y), int)
    for c in (0, 1):
        rank[y == c] = np.arange((y == c).sum())
    apart = rank % 4 == 3
    network = train(x[~apart], y[~apart])
    return Model(words, calibrate(network, x[apart], y[apart]) if 0 < y[apart].sum() < apart.sum() else network)


def score_of(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A column function from texts to scores."""
    shared = spark.sparkContext.broadcast(model)

    def start() -> Callable[[list[str]], Iterable[float]]:
        words, network = shared.value
        if network is None:
            return lambda texts: [1.0] * len(texts)
        types = Types(CACHE_ENTRIES)
        return lambda texts: network.probability(np.stack([pool(x, words) for x in types.of(texts)])).tolist()

    return text_udf(spark, start)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each document, one narrow pass."""
    return docs.select(docs[id_col], score_of(docs.sparkSession, model)(docs[text_col]).alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
