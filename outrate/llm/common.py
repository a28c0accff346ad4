"""What several of the operators share: words, scratch tables in the shared folder, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these; the same class for Java's, Python's and RE2's engines.
BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table for A-Z, which leaves UTF-8 sequences alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())

_own_dir: dict[str, str] = {}


def words(text: Column) -> Column:
    """Array of the words of a text; null text: no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, else the context's checkpoint folder.  Only on
    one machine, where neither is set, a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = context.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="outrate-")
    return _own_dir[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys with more rows than one of SHARE, and more than FEW, are joined by broadcast: there are fewer than SHARE of them.
SHARE, FEW = 200, 500


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left (a written table) joined with right, which has one row for each key.  Keys that hold a great part of left's rows would
    bring them to one task; their rows of right, fewer than SHARE, are sent to all tasks instead.  counts: (keys, n), left's rows by key."""
    if counts is None:
        counts = left.groupBy(*on).agg(F.count("*").alias("n"))
    many = table(counts.where(F.col("n") > FEW).select(*on, "n"), "many")
    if many.isEmpty():
        return left.join(right, on, how)
    hot = many.where(F.col("n") > left.count() / SHARE).select(*on)
    few = table(right.join(F.broadcast(hot), on, "left_semi"), "few")
    rest, some = (left.join(F.broadcast(hot), on, x) for x in ("left_anti", "left_semi"))
    return rest.join(right, on, how).unionByName(some.join(F.broadcast(few), on, how))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches of whole texts small, by rows and by bytes."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
