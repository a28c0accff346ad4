"""Neighbour joins.  Distances are by direct subtraction, dimension after dimension.

Nearest neighbours are found block by block (``blocks``): a row asks for those blocks only that may hold something nearer than the k-th
it knows.  The radius join deals rows of few dimensions out to cells of width eps, where an equi-join on the cell and those around it
finds all pairs; in more dimensions blocks ask for what lies within eps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outrate.functions.vectors import dist
from outrate.operators.blocks import distances, matrix, search
from outrate.operators.state import kept

#: Dimensions up to which the radius join takes cells.
FLAT = 3


#: Rows of a block of ``pairs`` at most, blocks of a table that has fewer, and pairs of blocks of a task where there are many.
BLOCK, SOME, TOGETHER = 4000, 16, 8


def pairs(points: DataFrame, dims: int) -> DataFrame:
    """(a, b, d) for a < b.  Rows are dealt out to blocks by a hash, and each pair of blocks is a key of its own, so that a table that is
    one small file is work for as many tasks as its pairs ask for.  Blocks move packed, as one row each, and are unpacked where they meet."""
    points = kept(points.select("row_id", "x").where("row_id IS NOT NULL"))
    n = points.count()
    blocks = max(1, math.ceil(n / min(BLOCK, max(1, math.ceil(n / SOME)))))
    met = blocks * (blocks + 1) // 2
    tasks = min(met, max(4 * points.sparkSession.sparkContext.defaultParallelism, met // TOGETHER))
    own = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")
    packed = kept(points.groupBy(own.alias("block")).agg(F.collect_list(F.struct("row_id", "x")).alias("rows")))  # about BLOCK

    def side(i: str, j: str) -> DataFrame:
        moved = packed.select(F.col("block").alias(i), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(j), "rows").where("i <= j").repartition(tasks, "i", "j")
        return moved.select("i", "j", F.explode("rows").alias("r")).select("i", "j", F.col("r.row_id").alias(f"row_{i}"), F.col("r.x").alias(f"x_{i}"))

    both = side("i", "j").hint("merge").join(side("j", "i"), ["i", "j"]).where("i < j AND row_i <> row_j OR row_i < row_j")
    return both.select(F.least("row_i", "row_j").alias("a"), F.greatest("row_i", "row_j").alias("b"), dist(F.col("x_i"), F.col("x_j"), dims).alias("d"))


def _least(k: int) -> Callable[[np.ndarray], np.ndarray]:
    """Of each row the k least; ties: the earlier."""

    def choose(d: np.ndarray) -> np.ndarray:
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, np.argsort(d, axis=1, kind="stable")[:, :k], True, axis=1)
        return out

    return choose


def _least_with_ties(k: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda d: d <= (np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf)


def knn(points: DataFrame, k: int, dims: int, seen: Accumulator | None = None) -> DataFrame:
    """(a, b, d, rk): the k nearest others; ties: the smaller id.  seen counts distances."""
    near = search(points, None, dims, k, _least(k), seen=seen)
    return near.withColumn("rk", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rk") <= k)


def knn_for(rows: DataFrame, points: DataFrame, k: int, dims: int) -> DataFrame:
    """The same for some rows only, among all points."""
    near = search(rows, points, dims, k, _least(k))
    return near.withColumn("rk", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("rk") <= k)


def knn_with_ties(points: DataFrame, k: int, dims: int, seen: Accumulator | None = None) -> DataFrame:
    """(a, b, d, rk): the others up to the k-th smallest distance, however many are at it."""
    near = search(points, None, dims, k, _least_with_ties(k), seen=seen, ties=True)
    return near.withColumn("rk", F.rank().over(Window.partitionBy("a").orderBy("d"))).where(F.col("rk") <= k)


def nearest_in(points: DataFrame, subset: DataFrame, dims: int, seen: Accumulator | None = None) -> DataFrame:
    """(row_id, b, d): the nearest row of a subset, itself excluded; ties: the smaller id."""
    best = search(points, subset, dims, 1, _least(1), seen=seen).groupBy("a").agg(F.min_by(F.struct("b", "d"), F.struct("d", "b")).alias("m"))
    return best.select(F.col("a").alias("row_id"), "m.b", "m.d")


def within(points: DataFrame, eps: float, dims: int, seen: Accumulator | None = None) -> DataFrame:
    """(a, b, d) with d <= eps, both ways, without a = b.  In more than FLAT dimensions seen counts candidate pairs."""
    if dims > FLAT:
        return search(points, None, dims, None, lambda d: d <= eps, bound=eps, seen=seen)
    width = max(eps, 1e-12)
    cells = [F.floor(F.col("x")[i] / width) for i in range(dims)]
    placed = points.select("row_id", "x", *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    around = F.explode(F.array(*[F.struct(*[(F.col(f"c{i}") + s).alias(f"c{i}") for i, s in enumerate(step)]) for step in product((-1, 0, 1), repeat=dims)]))
    a = placed.select(F.col("row_id").alias("a"), F.col("x").alias("xa"), around.alias("cell")).select("a", "xa", "cell.*")
    b = placed.select(F.col("row_id").alias("b"), F.col("x").alias("xb"), *[f"c{i}" for i in range(dims)])
    return a.join(b, [f"c{i}" for i in range(dims)]).where("a <> b").select("a", "b", dist(F.col("xa"), F.col("xb"), dims).alias("d")).where(F.col("d") <= eps)


def nearest(points: DataFrame, centers: DataFrame, dims: int) -> DataFrame:
    """points with the nearest of the few centers (center, c), ties: the smaller, and its distance d.  The centers, a model of k rows,
    go to every task; rows stay where they are."""
    found = sorted((r.center, r.c) for r in centers.select(F.col("center").cast("long").alias("center"), "c").collect())
    names, c = np.array([n for n, _ in found], np.int64), np.array([x for _, x in found], np.float64).reshape(-1, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(names):
                d = distances(matrix(b["x"], dims), c)
                best = np.round(d, 9).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b["row_id"], pa.array(names[best]), pa.array(d[np.arange(len(best)), best])], names=["row_id", "center", "d"])

    return points.select(F.col("row_id").cast("long").alias("row_id"), "x").mapInArrow(run, "row_id long, center long, d double")
