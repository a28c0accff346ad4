"""What a loop carries from round to round, written to the folder that driver and executors share."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *paths])


def scratch(df: DataFrame) -> str:
    """A new path in the session's spark.checkpoint.dir or the context's checkpoint folder; where neither is set, and only on one
    machine, in a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="outrate-")
        named = _own[context.applicationId]
    return f"{named.rstrip('/')}/state-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written once and read again: its lineage ends here, and a lost executor costs no recomputation."""
    importable(df.sparkSession)
    path = scratch(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task at least, where there are several, and at most.
LEAST, MOST = 4096, 1 << 18


def tasks_for(spark: SparkSession, n: int) -> int:
    """How many tasks n rows are dealt out to."""
    return max(1, min(math.ceil(n / LEAST), max(spark.sparkContext.defaultParallelism, math.ceil(n / MOST))))


def shared_out(df: DataFrame, *by: str) -> DataFrame:
    """df, ``kept`` in as many files as its rows need tasks: a table of a few megabytes, which Spark reads in one task, is work for many where
    all rows meet all centers.  by: what rows are dealt out by."""
    return kept(df.repartition(tasks_for(df.sparkSession, df.count()), *by))
