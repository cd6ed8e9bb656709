"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager, suppress
from itertools import count
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ravelin.session import ship

#: Rows turned into Python objects at a time, fewer if their texts are long: both bound a worker's memory.
CHUNK_ROWS, CHUNK_BYTES = 1024, 8 << 20


def release() -> None:
    """What this process has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[..., Iterator[Any]]) -> Callable[..., Iterator[Any]]:
    """``run``, a task's generator; when it ends, what it has freed goes back to the machine and isn't kept for the worker's
    next task, as the executor's memory is shared with the JVM."""

    def own(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            release()

    return own


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so Arrow batches of the default number of rows or bytes would take much memory on both sides."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", CHUNK_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", CHUNK_BYTES)):
        if not 0 < int(spark.conf.get(name).removesuffix("b")) <= most:
            spark.conf.set(name, str(most))


def schema_of(ddl: str | T.StructType) -> T.StructType:
    return ddl if isinstance(ddl, T.StructType) else T._parse_datatype_string(ddl)


def map_chunks(
    df: DataFrame,
    columns: Sequence[str],
    start: Callable[[], Callable[..., Iterable[tuple[Any, ...]]]],
    schema: str | T.StructType,
) -> DataFrame:
    """Streams the named columns through Python, one call a chunk of rows.

    ``start()`` runs once a task and returns a function that takes a list of values for each column and gives any number
    of output tuples. Only ``columns`` are read, so other columns of ``df`` can have any name. Nothing is kept between
    chunks, so a task's memory doesn't grow with its input. If the function has an attribute ``close``, that is called when
    the task ends, so that a worker that goes on to other work holds nothing of it.
    """
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    out = schema_of(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        try:
            for batch in batches:
                rows = max(1, min(CHUNK_ROWS, batch.num_rows * CHUNK_BYTES // max(1, batch.nbytes)))
                for at in range(0, batch.num_rows, rows):
                    gc.disable()  # a collection amid a chunk walks all that a worker remembers
                    try:
                        made = list(each(*(c.to_pylist() for c in batch.slice(at, rows).columns)))
                    finally:
                        gc.enable()
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), arrow.types)], schema=arrow)
        finally:
            getattr(each, "close", lambda: None)()

    return df.select(*[df[f"`{c}`"] for c in columns]).mapInArrow(tidied(run), out)


def text_udf(spark: SparkSession, start: Callable[[], Callable[[list[str]], Iterable[float]]]) -> Callable[[Column], Column]:
    """A column function from texts to doubles; a null text counts as empty. The other columns stay in the JVM.

    ``start()`` runs once a task and returns a function that takes a chunk of texts."""
    ship(spark)
    small_batches(spark)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        each = start()
        for batch in batches:
            texts = [t or "" for t in batch]
            rows = max(1, min(CHUNK_ROWS, len(texts) * CHUNK_BYTES // max(1, sum(map(len, texts)))))
            gc.disable()
            try:
                found = [x for at in range(0, len(texts), rows) for x in each(texts[at : at + rows])]
            finally:
                gc.enable()
            yield pd.Series(found, dtype="float64")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidied(scored)(batches)

    return F.pandas_udf(run, "double")


def map_rows(
    df: DataFrame,
    columns: Sequence[str],
    start: Callable[[], Callable[..., Iterable[tuple[Any, ...]]]],
    schema: str | T.StructType,
) -> DataFrame:
    """As ``map_chunks``, with one call a row."""

    def start_rows() -> Callable[..., Iterable[tuple[Any, ...]]]:
        each = start()
        return lambda *values: (row for x in zip(*values) for row in each(*x))

    return map_chunks(df, columns, start_rows, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one where it is unset in local mode."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ravelin-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; survives lost executors, and its plan starts anew.

    A checkpoint keeps what its plan told of its columns, which doubles with each join of columns that are equal; so
    nothing is told while it is made."""
    spark = df.sparkSession
    ship(spark)
    shared_folder(spark)
    name = "spark.sql.constraintPropagation.enabled"
    told = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, told)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a table to the shared folder, compressed, and reads it again: as ``cut``, for large ones.
    The tables are deleted at the end, so what is to outlive them must be computed before."""
    folder = f"{shared_folder(spark)}/{fresh_name('scratch')}"
    numbers = count()

    def stored(df: DataFrame) -> DataFrame:
        ship(spark)
        path = f"{folder}/{next(numbers)}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield stored
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # type: ignore[union-attr]
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
