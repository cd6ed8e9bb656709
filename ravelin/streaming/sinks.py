"""Sinks of streaming tables: JSON lines of which each batch counts once, and lines on the standard output."""

from __future__ import annotations

import sys
import uuid
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ravelin.session import ship


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in any store that Spark writes; one of that name is replaced."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_once(rows: DataFrame, path: str) -> DataStreamWriter:
    """A writer of a streaming table as JSON lines, each batch once, whatever is killed and started again.

    A run of a batch writes to a folder of its own, and then names that folder in the batch's commit file. A batch that is run
    again, as its first run died before or after that, replaces the commit by its own, which fits the state that Spark keeps;
    folders that no commit names aren't read. Set checkpointLocation and start it."""

    def batch(own: DataFrame, number: int) -> None:
        folder = f"{number:012d}-{uuid.uuid4().hex}"
        own.write.json(f"{path}/data/{folder}")
        _put(own.sparkSession, f"{path}/commits/{number:012d}", folder)

    ship(rows.sparkSession)
    return rows.writeStream.foreachBatch(batch)


def read_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_once`` has committed. A folder a batch is named to the reader."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")  # type: ignore[union-attr]
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    folders = sorted(r.value for r in spark.read.text(f"{path}/commits").where("value <> ''").collect())
    return spark.read.schema(schema).json([f"{path}/data/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def print_lines(rows: DataFrame, out: TextIO | None = None) -> DataStreamWriter:
    """A writer of a streaming table as JSON lines on the standard output, for a person or a pipe: a partition at a time
    comes to the driver."""

    def batch(own: DataFrame, number: int) -> None:
        to = out or sys.stdout
        for (line,) in own.selectExpr("to_json(struct(*)) AS line").toLocalIterator():
            to.write(line + "\n")
        to.flush()

    return rows.writeStream.foreachBatch(batch)
