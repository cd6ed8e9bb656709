"""Toxicity by a convolutional text classifier trained in numpy.

A word is hashed into three embedding tables, as a whole, by its first six letters and by its first eight (each with a mark
if it goes on), and the three vectors stand side by side: inflected forms share two of them, and a hash collision in one
table leaves the others apart. Filters of widths 1, 2 and 3 run over a whole text; each
filter's maximum goes into a logistic layer. An entry's first dimension starts at the z-score of its log-odds ratio between
the classes' documents, the others at small random numbers. Training is by AdaGrad, one document at a time: only a filter's
best window gets a gradient. Entries that never got one keep their first dimension only, which is zero for unknown words.

A threshold is calibrated for each language on labelled rows that weren't fitted, and the score is shifted so that the
threshold lies at 0.5. The language is guessed from the text alone, by common words; labels, lang, source and ids are
never inputs of a score.

Fitting uses a bounded sample (see ``labels``). Scoring is one narrow pass over whole texts.

Defined cases: a null text is scored as an empty one; an empty text has the score of a text without known words; without
two classes to learn from, every score is 0; repeated rows give repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.bpe import Memory
from ravelin.llm.common import table, text_udf
from ravelin.llm.labels import held_out, sample

BITS = 17
TABLES, BUCKETS, DIMENSIONS = 3, 1 << BITS, 8
WIDTHS, FILTERS = (1, 2, 3), 4
EPOCHS, RATE, START, DECAY, SEED = 4, 0.03, np.float32(0.01), 1e-5, 11
CACHE_ENTRIES = 150_000
LANGUAGES = ("en", "de", "fr", "es")
#: Words that tell the languages apart.
COMMON = {
    b"the": 0, b"and": 0, b"of": 0, b"to": 0, b"that": 0, b"was": 0, b"with": 0,
    b"der": 1, b"die": 1, b"das": 1, b"und": 1, b"ist": 1, b"nicht": 1, b"den": 1,
    b"le": 2, b"les": 2, b"des": 2, b"et": 2, b"est": 2, b"pour": 2, b"dans": 2,
    b"el": 3, b"los": 3, b"y": 3, b"que": 3, b"del": 3, b"por": 3, b"las": 3,
}
_BLANK = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


class Model(NamedTuple):
    tables: np.ndarray  # TABLES, BUCKETS, DIMENSIONS
    filters: list[np.ndarray]  # for each width: (width, TABLES * DIMENSIONS, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    shift: np.ndarray  # of the logit, for each language and last for texts of none


class Words(Memory):
    """A word's buckets in the three tables and its language, if it is a common word."""

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """For each text its words' packed buckets, and its language."""
        split = [t.lower().encode("utf-8").translate(_BLANK).split() for t in texts]
        keys = set().union(*split) if split else set()
        for word in self.missing(keys):  # type: ignore[arg-type]
            text = word.decode("utf-8")
            packed = COMMON.get(word, -1) + 1
            for n, part in enumerate((text[:8] + " " * (len(text) > 8), text[:6] + " " * (len(text) > 6), text)):
                packed = packed << BITS | xxhash.xxh32_intdigest(part, SEED + n) & BUCKETS - 1
            self[word] = packed
        out = []
        for words in split:
            packed = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            told = np.bincount(packed >> BITS * TABLES, minlength=len(LANGUAGES) + 1)[1:]
            out.append((packed, int(told.argmax()) if told.any() else len(LANGUAGES)))
        return out


def buckets(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> BITS * t & BUCKETS - 1 for t in range(TABLES)])


def odds(examples: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """For each table's entries, how many standard errors its log-odds ratio lies from 0; 0 for entries not met."""
    counts = np.full((2, TABLES, BUCKETS), 0.5)
    for packed, y in examples:
        h = buckets(packed)
        for t in range(TABLES):
            counts[y, t, np.unique(h[t])] += 1
    total = np.array([[[1 + sum(1 for _, y in examples if y == c)]] for c in (0, 1)])
    ratio = np.log(counts / (total - counts + 0.5))
    z = (ratio[1] - ratio[0]) / np.sqrt((1 / counts).sum(axis=0))
    return np.where(counts.sum(axis=0) > 1, z, 0)


def train(examples: list[tuple[np.ndarray, int]], seed: int = SEED) -> Model:
    """From (packed words, label)."""
    rng = np.random.default_rng(seed)
    size = TABLES * DIMENSIONS
    tables = rng.normal(0, 0.05, (TABLES, BUCKETS, DIMENSIONS)).astype(np.float32)
    tables[:, :, 0] = odds(examples) / 4
    filters = [rng.normal(0, 0.1, (w, size, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w, f in zip(WIDTHS, filters):
        f[:, ::DIMENSIONS, 0::2] += 1 / w
        f[:, ::DIMENSIONS, 1::2] -= 1 / w
    biases = [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS]
    out = np.abs(rng.normal(0, 0.5, len(WIDTHS) * FILTERS)).astype(np.float32) * np.tile([1, -1], len(WIDTHS) * FILTERS // 2).astype(np.float32)
    bias = np.zeros(1, np.float32)
    parts = [tables, *filters, *biases, out, bias]
    squares = [np.full_like(p, START) for p in parts]
    n = len(WIDTHS)
    positive = sum(y for _, y in examples)
    balance = (1.0, (len(examples) - positive) / max(1, positive))

    def step(at: int, gradient: np.ndarray) -> None:
        squares[at] += gradient * gradient
        parts[at] -= RATE * gradient / np.sqrt(squares[at])

    ids = [buckets(packed) for packed, _ in examples]
    pads = np.zeros((WIDTHS[-1], size), np.float32)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            h, y = ids[i], examples[i][1]
            length = h.shape[1]
            x = np.concatenate([tables[t, h[t]] for t in range(TABLES)], axis=1)
            x = np.concatenate([x, pads]) if length < WIDTHS[-1] else x
            tops, best = np.zeros((n, FILTERS), np.float32), []
            for k, w in enumerate(WIDTHS):
                c = biases[k] + sum(x[j : len(x) - w + 1 + j] @ filters[k][j] for j in range(w))
                best.append(c.argmax(axis=0))
                tops[k] = c.max(axis=0)
            active = np.maximum(tops, 0).ravel()
            z = min(30.0, max(-30.0, float(active @ out + bias[0])))
            error = (1 / (1 + np.exp(-z)) - y) * balance[y]
            inner = (error * out).reshape(n, FILTERS) * (tops > 0)
            step(len(parts) - 2, (error * active + DECAY * out).astype(np.float32))
            step(len(parts) - 1, np.array([error], np.float32))
            where, towards = [], []
            for k, w in enumerate(WIDTHS):
                at = best[k][:, None] + np.arange(w)
                where.append(at.ravel())
                towards.append((inner[k][:, None, None] * filters[k].transpose(2, 0, 1)).reshape(-1, size))
                step(1 + k, (inner[k][:, None, None] * x[at]).transpose(1, 2, 0))
                step(1 + n + k, inner[k])
            at, gradient = np.concatenate(where), np.concatenate(towards)
            kept = (at < length) & gradient.any(axis=1)
            at, gradient = at[kept], gradient[kept]
            for t in range(TABLES):
                own = gradient[:, t * DIMENSIONS : (t + 1) * DIMENSIONS]
                rows, back = np.unique(h[t, at], return_inverse=True)
                total = np.zeros((len(rows), DIMENSIONS), np.float32)
                np.add.at(total, back, own)
                squares[0][t, rows] += total * total
                tables[t, rows] -= RATE * total / np.sqrt(squares[0][t, rows])
    tables[:, :, 1:][(squares[0] == START).all(axis=2)] = 0
    return Model(tables, filters, biases, out, float(bias[0]), np.zeros(len(LANGUAGES) + 1))


class Scorer:
    """Adds up what each table gives each filter, so a word costs three look-ups."""

    def __init__(self, model: Model) -> None:
        self.model = model
        taps = np.concatenate([f[j] for f in model.filters for j in range(len(f))], axis=1)  # size, taps * FILTERS
        self.given = [np.ascontiguousarray(model.tables[t] @ taps[t * DIMENSIONS : (t + 1) * DIMENSIONS]) for t in range(TABLES)]

    def logit(self, packed: np.ndarray) -> float:
        tops = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
        longest = WIDTHS[-1]
        for start in range(0, max(1, len(packed)), 65536):  # windows overlap by the longest filter
            part = packed[start : start + 65536 + longest - 1]
            h = buckets(part)
            s = self.given[0][h[0]]
            for t in range(1, TABLES):
                s += self.given[t][h[t]]
            if len(s) < longest:
                s = np.concatenate([s, np.zeros((longest - len(s), s.shape[1]), np.float32)])
            tap = 0
            for k, w in enumerate(WIDTHS):
                c = s[: len(s) - w + 1, tap * FILTERS : (tap + 1) * FILTERS]
                for j in range(1, w):
                    c = c + s[j : len(s) - w + 1 + j, (tap + j) * FILTERS : (tap + j + 1) * FILTERS]
                tap += w
                tops[k] = np.maximum(tops[k], c.max(axis=0))
        active = np.maximum(np.concatenate([t + b for t, b in zip(tops, self.model.biases)]), 0)
        return float(active @ self.model.out + self.model.bias)

    def score(self, packed: np.ndarray, language: int) -> float:
        z = self.logit(packed) - self.model.shift[language]
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit that parts the classes with the best sum of both classes' accuracies; the middle of the widest such gap."""
    order = np.argsort(logits)
    z, y = logits[order], labels[order]
    right = np.concatenate(([0], np.cumsum(1 - y))) / max(1, (1 - y).sum()) + np.concatenate(([y.sum()], y.sum() - np.cumsum(y))) / max(1, y.sum())
    cuts = np.flatnonzero(right >= right.max() - 1e-12)
    edge = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    i = max(cuts, key=lambda c: edge[c + 1] - edge[c])
    return float((edge[i] + edge[i + 1]) / 2)


def calibrate(model: Model, held: list[tuple[np.ndarray, int, int]]) -> Model:
    """``held``: packed words, language and label of rows that weren't fitted. A language with under 15 rows of either
    class has the threshold of all."""
    scorer = Scorer(model)
    z = np.array([scorer.logit(p) for p, _, _ in held])
    languages, y = np.array([x for _, x, _ in held]), np.array([x for _, _, x in held])
    shift = np.full(len(LANGUAGES) + 1, threshold(z, y) if 0 < y.sum() < len(y) else 0.0)
    for n in range(len(shift)):
        own = languages == n
        if min(y[own].sum(), (1 - y[own]).sum()) >= 15:
            shift[n] = threshold(z[own], y[own])
    return model._replace(shift=shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model, or None where the labelled rows are all of one class. A quarter of the sample calibrates."""
    rows = sorted((r.key, r.label, r.text) for r in sample(docs.sparkSession, docs, labels, label_col, id_col, text_col).collect())
    if len({y for _, y, _ in rows}) < 2:
        return None
    ids = Words(CACHE_ENTRIES).ids([t or "" for _, _, t in rows])
    fitted, held, seen = [], [], [0, 0]
    for (packed, language), (_, y, _) in zip(ids, rows):
        seen[y] += 1
        if seen[y] % 4:
            fitted.append((packed, y))
        else:
            held.append((packed, language, y))
    model = train(fitted)
    return calibrate(model, held) if {y for *_, y in held} == {0, 1} else model


def score_of(spark: SparkSession, model: Model | None) -> Callable[[Column], Column]:
    """A column function from texts to scores."""
    shared = spark.sparkContext.broadcast(model)

    def start() -> Callable[[list[str]], Iterable[float]]:
        if shared.value is None:
            return lambda texts: [0.0] * len(texts)
        scorer, words = Scorer(shared.value), Words(CACHE_ENTRIES)
        return lambda texts: [scorer.score(*x) for x in words.ids(texts)]

    return text_udf(spark, start)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each document."""
    return docs.select(docs[id_col], score_of(docs.sparkSession, model)(docs[text_col]).alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
