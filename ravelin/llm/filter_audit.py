"""How filters of a cleaning stage bear on each other, for every order in which they could run.

One pass turns each document into a mask of the filters that it fails, and one aggregation turns a part's documents into at
most 32 cells, the numbers of documents, good ones and toxic ones for each mask. All else follows from the cells: the orders
are visited by single swaps of neighbours (Steinhaus, Johnson, Trotter), and as a filter's step depends only on which filters
ran before it, a swap of two neighbours changes their two steps alone, which are looked up anew in the numbers of documents
that pass a set of filters. Shapley values, here a filter's removals summed over all orders, are added up along the walk.

The filters: A under 200 words; B under half of the words distinct; C over 2 % of the code points are A to Z; D holds one of
``#$%&*|``; E is identical to the text of a document of a smaller id, in the whole table. Words are runs of anything but
blanks and line ends, case-sensitive. Identical texts are those of one SHA-256. Copies are counted by text, id and part before
texts meet, and by text and part before the least ids do, so a text that a third of all rows hold is a row a task by then.

Defined cases: a null text counts as empty (under 200 words; equal empty texts are copies); a null source is the part of the
empty name; a null id is smaller than none and greater than none, so its row fails no E; rows of one id aren't each other's
copies; an id labelled twice has its greatest labels, an unlabelled one is neither good nor toxic; very long texts are
counted in slices; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import small_batches, table, tidied
from ravelin.session import ship

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SLICE_BYTES = 4 << 20
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))


class Counts(NamedTuple):
    words: int
    distinct: int
    capitals: int
    characters: int
    marks: int


def measure(text: str) -> Counts:
    raw = text.encode("utf-8")
    words, distinct, at = 0, set(), 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE_BYTES)
        end = len(raw) if end < 0 else end
        own = raw[at:end].split()  # at blanks and line ends, as bytes are
        words += len(own)
        distinct.update(own)
        at = end
    without = lambda which: len(raw) - len(raw.translate(None, which))
    return Counts(words, len(distinct), without(_CAPITALS), len(raw) - without(_CONTINUED), without(_MARKS))


def own_mask(c: Counts) -> int:
    """Bits 0 to 3: the filters A to D that the text fails."""
    fails = (c.words < LEAST_WORDS, 100 * c.distinct < DISTINCT_PERCENT * c.words, 100 * c.capitals > CAPITAL_PERCENT * c.characters, c.marks > 0)
    return sum(1 << n for n, failed in enumerate(fails) if failed)


def text_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask of A to D, and the text's SHA-256."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for text in batch.column(2):
                own = text.as_py()
                masks.append(own_mask(measure(own)))
                digests.append(hashlib.sha256(own.encode("utf-8")).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"])

    return rows.mapInArrow(tidied(run), f"id {docs.schema[id_col].dataType.simpleString()}, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part that fail just the filters of a mask."""
    masks = text_masks(docs, id_col, text_col, part_col)
    once = masks.groupBy("digest", "id", "part").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(labels["doc_id"].alias("labelled")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # Null ids meet no label, so they are dealt by their text.
    own = once.withColumn("deal", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.hex("digest"))))
    known = known.withColumn("known_deal", F.xxhash64(F.col("labelled").cast("string")))
    own = own.join(known, (F.col("deal") == F.col("known_deal")) & (F.col("id") == F.col("labelled")), "left")
    own = own.select("digest", "part", "mask", "id", "n", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("bad"))
    # By text and kind: how many rows, how many of them without an id, the least id and how many rows have it.
    kinds = own.groupBy("digest", "part", "mask", "good", "bad").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("without"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    )
    told = kinds.withColumn("first", F.min("least.id").over(Window.partitionBy("digest")))
    told = told.withColumn("free", F.col("without") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("free").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("free")).alias("n"))))
    dealt = told.select("part", "good", "bad", split.alias("s"))
    n = F.col("s.n")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return dealt.groupBy("part", F.col("s.mask").alias("mask")).agg(total(n).alias("n"), total(F.when(F.col("good"), n)).alias("good"), total(F.when(F.col("bad"), n)).alias("toxic"))


def walk(size: int) -> Iterator[tuple[list[int], int]]:
    """All orders of ``size`` things, and the place at which each differs from the one before by a swap with the next place;
    -1 for the first. The lists are one list, which changes."""
    order, towards = list(range(size)), [-1] * size
    yield order, -1
    while True:
        movable = [x for at, x in enumerate(order) if 0 <= at + towards[x] < size and order[at + towards[x]] < x]
        if not movable:
            return
        top = max(movable)
        at = order.index(top)
        left = min(at, at + towards[top])
        order[left], order[left + 1] = order[left + 1], order[left]
        for x in range(top + 1, size):
            towards[x] = -towards[x]
        yield order, left


def audit(of_mask: np.ndarray) -> list[tuple[str, int, int, int, int, int, int, int, int]]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from a row (n, good,
    toxic) for each of the 32 masks."""
    size = len(FILTERS)
    passing = np.array([of_mask[[m for m in range(1 << size) if not m & s]].sum(axis=0) for s in range(1 << size)])
    fails = [int(passing[0, 0] - passing[1 << f, 0]) for f in range(size)]
    unique = [int(of_mask[1 << f, 0]) for f in range(size)]
    before = [0] * (size + 1)  # the filters that ran before each step
    steps = [(0, 0, 0, 0)] * size
    shapley = [0] * size
    found = []

    def look_up(order: list[int], at: int) -> None:
        own = 1 << order[at]
        before[at + 1] = before[at] | own
        lost = passing[before[at]] - passing[before[at + 1]]
        steps[at] = (int(passing[before[at + 1], 0]), *map(int, lost))

    for order, swapped in walk(size):
        for at in range(size) if swapped < 0 else (swapped, swapped + 1):
            look_up(order, at)
        name = "".join(FILTERS[f] for f in order)
        for at, (f, (kept, removed, good, toxic)) in enumerate(zip(order, steps)):
            shapley[f] += removed
            found.append((name, at + 1, f, kept, removed, fails[f] - removed, unique[f], good, toxic))
    return [(name, step, *rest, shapley[f]) for name, step, f, *rest in found]


COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(of_part: DataFrame) -> DataFrame:
    """Every order's steps for each part, from ``cells``; a task holds a part's 32 cells."""
    ship(of_part.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(key: tuple[str], own: pd.DataFrame) -> pd.DataFrame:
        of_mask = np.zeros((1 << len(FILTERS), 3), np.int64)
        of_mask[own["mask"].to_numpy()] = own[["n", "good", "toxic"]].to_numpy()
        return pd.DataFrame([(key[0], *row) for row in audit(of_mask)], columns=names)

    return of_part.groupBy("part").applyInPandas(run, COLUMNS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_WORDS = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
_SQL = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
    ), l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
    ), firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t
    ), w AS (SELECT d.doc_id, part, d.t, len({_WORDS.replace("(t", "(d.t")}) AS words, len(list_distinct({_WORDS.replace("(t", "(d.t")})) AS kinds, coalesce(d.doc_id > first, false) AS e FROM d JOIN firsts ON d.t = firsts.t
    ), m AS (SELECT part, (words < 200)::INTEGER + 2 * (100 * kinds < 50 * words)::INTEGER + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * e::INTEGER AS mask,
        coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM w LEFT JOIN l USING (doc_id)
    ), c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS toxic FROM m GROUP BY part, mask
    ), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)
    ), o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ), s AS (SELECT filter_order, step, f.bit, coalesce((SELECT bit_or(g.bit) FROM f g WHERE position(g.name IN filter_order) < step), 0) AS before FROM o, (SELECT unnest(generate_series(1, 5)) AS step), f WHERE f.name = filter_order[step]
    ), r AS (SELECT c.part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost FROM s, c GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {"op13_filter_audit": _SQL}
