"""What a session needs before Python code of this package runs on its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="ravelin-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that rounds don't compute it again and lost executors don't
    matter: a checkpoint in spark.checkpoint.dir, or in a temporary folder where that is unset in local mode.

    What its plan tells of its columns isn't kept, as that doubles with each join of a round."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            path = tempfile.mkdtemp(prefix="ravelin-checkpoint-")
        sc.setCheckpointDir(path)
    ship(spark)
    name = "spark.sql.constraintPropagation.enabled"
    told = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(name, told)
