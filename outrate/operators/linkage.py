"""Complete linkage without a table of all pairs.

The tree grows by phases.  A phase has a height, and lists the pairs of clusters whose distance, that of their farthest rows, is not above
it.  Clusters that are each other's nearest are merged, all such pairs in one round, which leads to the same tree as one merge after
another.  A merged cluster's distance to a third is the greater of both parts' distances, so that a pair stays listed only if all its parts
were; no distance is measured again before the phase ends, when no pair is left.  Then none of the clusters is as near to another as the
height was, and the next height is taken from how far clusters are apart now, so that each has a few partners in the list at any time:
the list grows with the clusters, not with their pairs.

Which pairs may be in the list is found from centers: the mean of all squared distances between two clusters' rows is their centers'
squared distance and both variances, and the farthest rows are not nearer than that.  Pairs that pass are measured by blocks of their rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrate.functions.vectors import dist, mean
from outrate.operators import blocks
from outrate.operators.blocks import distances, plain
from outrate.operators.neighbors import knn, within
from outrate.operators.prefix import numbered
from outrate.operators.state import kept

#: Clusters of which all pairs are listed at once; above, a cluster is to have about NEAR partners in the list.
SMALL, NEAR = 256, 8


def _described(members: DataFrame, dims: int) -> DataFrame:
    """(cluster, x, v, n) of members (row_id, cluster, x): center, variance and rows.  A written table."""
    centers = members.groupBy("cluster").agg(mean(F.col("x"), dims).alias("c"), F.count("*").alias("n"))
    both = members.join(centers, "cluster").withColumn("d", dist(F.col("x"), F.col("c"), dims))
    return kept(both.groupBy("cluster", "n").agg(F.avg(F.col("d") * F.col("d")).alias("v"), F.first("c").alias("x")))


def _farthest(members: DataFrame, sizes: DataFrame, pairs: DataFrame, height: float, dims: int) -> DataFrame:
    """(a, b, d) of pairs (a, b): the distance of their farthest rows, where it is not above height."""
    part = F.pmod(F.xxhash64("row_id"), F.ceil(F.col("n") / blocks.ROWS))
    # A cluster's rows by blocks, however many they are.
    dealt = members.join(sizes.select("cluster", "n"), "cluster").groupBy("cluster", part.alias("part")).agg(F.flatten(F.collect_list("x")).alias("xs"))
    dealt = kept(dealt.select("cluster", "xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [float(distances(plain(batch["xs_a"], i).reshape(-1, dims), plain(batch["xs_b"], i).reshape(-1, dims)).max()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(d, pa.float64())], names=["a", "b", "d"])

    one, two = (dealt.select(F.col("cluster").alias(k), F.col("xs").alias(f"xs_{k}")) for k in "ab")
    met = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "xs_a", "xs_b").mapInArrow(run, "a long, b long, d double")
    return met.groupBy("a", "b").agg(F.max("d").alias("d")).where(F.col("d") <= height)


def _listed(members: DataFrame, dims: int, height: float | None) -> tuple[DataFrame, float]:
    """(a, b, d) for a < b, all pairs of clusters not farther apart than a height; and that height, the next one if none is given."""
    found = _described(members, dims)
    n = found.count()
    centers = found.select(F.col("cluster").alias("row_id"), "x")
    if n <= SMALL:
        height = math.inf
        one, two = (found.select(F.col("cluster").alias(k), F.col("n").alias(f"n{k}"), F.col("x").alias(f"x{k}")) for k in "ab")
        near = one.join(two, F.col("a") < F.col("b")).withColumn("d", dist(F.col("xa"), F.col("xb"), dims))  # SMALL x SMALL
    else:
        if height is None:
            height = knn(centers, NEAR, dims).where(F.col("rk") == NEAR).approxQuantile("d", [0.5], 0.01)[0]
        one, two = (found.select(F.col("cluster").alias(k), F.col("n").alias(f"n{k}"), F.col("v").alias(f"v{k}")) for k in "ab")
        near = within(centers, height * (1 + blocks.SLACK), dims).where("a < b").join(one, "a").join(two, "b")
        near = near.where(F.col("d") * F.col("d") + F.col("va") + F.col("vb") <= height * height * (1 + blocks.SLACK))
    near = kept(near.select("a", "b", "na", "nb", "d"))
    single = near.where("na = 1 AND nb = 1").where(F.col("d") <= height).select("a", "b", "d")
    return kept(single.union(_farthest(members, found, near.where("na > 1 OR nb > 1"), height, dims))), height


def _renamed(names: DataFrame | None, now: DataFrame) -> DataFrame:
    """(cluster, name): what the clusters that were merged in a phase go by, after one more round."""
    into = now.select(F.col("b").alias("cluster"), F.col("a").alias("name"))
    if names is None:
        return kept(into)
    again = into.select(F.col("cluster").alias("name"), F.col("name").alias("next"))
    return kept(names.join(again, "name", "left").select("cluster", F.coalesce("next", "name").alias("name")).union(into))


def merges(points: DataFrame) -> DataFrame:
    """(step, a, b, d) of points (row_id, x): the merges in order; cluster b goes into a, and both go by their first rows.  What is equal
    is merged in the order of (d, a, b)."""
    rows = kept(points.select(F.col("row_id").cast("long").alias("row_id"), F.col("x").cast("array<double>").alias("x")))
    dims = (rows.select(F.size("x").alias("n")).first() or [0])[0]
    first = rows.groupBy("x").agg(F.min("row_id").alias("a"))
    equal = kept(rows.join(first, "x").select("row_id", "x", F.col("a").alias("cluster")))
    found = [equal.where("row_id <> cluster").select(F.col("cluster").alias("a"), F.col("row_id").alias("b"), F.lit(0.0).alias("d"), F.lit(0).alias("round"))]
    # Equal rows are as far from all others: one of them stands for all.
    members = kept(equal.where("row_id = cluster"))
    left, height = members.count(), None
    while left > 1:
        near, height = _listed(members, dims, height)
        names, merged = None, 0
        while True:
            ends = near.select(F.explode(F.array("a", "b")).alias("end"), "d", "a", "b")
            best = ends.groupBy("end").agg(F.min(F.struct("d", "a", "b")).alias("m"))
            now = kept(best.groupBy("m").count().where("count = 2").select("m.a", "m.b", "m.d", F.lit(len(found)).alias("round")))
            n = now.count()
            if not n:
                break
            merged += n
            found.append(now)
            if height < math.inf:  # else all pairs are listed, and no phase follows
                names = _renamed(names, now)
            both = now.select(F.explode(F.array("a", "b")).alias("end"), F.col("a").alias("to"))
            for c in "ab":
                near = near.join(both.select(F.col("end").alias(c), F.col("to").alias(f"to_{c}")), c, "left")
            parts = F.when(F.col("to_a").isNull(), 1).otherwise(2) * F.when(F.col("to_b").isNull(), 1).otherwise(2)
            near = near.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "d", parts.alias("parts")).where("a <> b")
            near = near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("d").alias("d"), F.count("*").alias("n"), F.max("parts").alias("parts"))
            near = kept(near.where("n = parts").select("a", "b", "d"))
        height = height * 2 if not merged else None
        left -= merged
        if names is not None:
            members = kept(members.join(names, "cluster", "left").select("row_id", "x", F.coalesce("name", "cluster").alias("cluster")))
    every = kept(reduce(DataFrame.union, found))
    return kept(numbered(every, ["d", "round", "a", "b"], "step").select(F.col("step").cast("int").alias("step"), "a", "b", "d"))
