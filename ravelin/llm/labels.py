"""Labelled rows: which may be learned from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most labelled rows of each class that a classifier is fitted on; they are chosen by a hash of their id.
MOST_OF_CLASS = 1500
#: Texts of more bytes aren't brought to the driver to be learned from, which bounds its memory; they are scored whole like any other.
MOST_BYTES = 16_384


def held_out(key: Column) -> Column:
    """Whether a row's label must not be learned: CRC-32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_OF_CLASS, most_bytes: int | None = MOST_BYTES
) -> DataFrame:
    """(key, text, label) of at most ``2 * most`` rows of ``docs`` that may be learned from; labels other than 0 and 1 and
    null ids are left out, and an id labelled twice has its greatest label. An id has one row, that of the text with the least
    hash; a null text is an empty one. ``most_bytes`` of None lets texts of any length in."""
    known = labels.select(labels["doc_id"].alias("key"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key"))).groupBy("key").agg(F.max("label").alias("label"))
    texts = docs.select(docs[id_col].alias("key"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    if most_bytes is not None:
        texts = texts.where(F.octet_length("text") <= most_bytes)
    there = known.join(texts.select("key"), "key", "left_semi")
    picked = [there.where(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(most) for c in (0, 1)]
    rows = [tuple(r) for r in picked[0].union(picked[1]).collect()]
    kind = f"key {docs.schema[id_col].dataType.simpleString()}, label int"
    found = texts.join(F.broadcast(spark.createDataFrame(rows, kind)), "key")
    return found.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("key", "text", "label")
