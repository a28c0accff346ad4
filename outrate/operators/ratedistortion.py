"""Rate-distortion curves of clusterings, and the rows that no clustering on the curve represents well.

A clustering is a DataFrame (clustering_id, row_id, cluster, x, rep); representations are cluster
means unless given.  What a row costs is Euclidean distance unless another distortion is given.  Everything is one or two aggregations by key; only per-clustering and per-cluster
results, whose number does not grow with the rows, are joined back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from outrate.functions.vectors import Distortion, change_of_entropy, dist, mean, xlog2x
from outrate.operators.state import importable, kept


def represent(clusters: DataFrame, dims: int) -> DataFrame:
    """(clustering_id, row_id, cluster, x) with rep, the cluster's mean.  Means are written first, so that Spark knows their size: where it
    broadcasts them, no row moves, however many rows a cluster holds."""
    means = kept(clusters.groupBy("clustering_id", "cluster").agg(mean(F.col("x"), dims).alias("rep")))
    return clusters.join(means, ["clustering_id", "cluster"])


def distances(represented: DataFrame, dims: int, distortion: Distortion = dist) -> DataFrame:
    return represented.withColumn("d", distortion(F.col("x"), F.col("rep"), dims))


def cluster_stats(measured: DataFrame) -> DataFrame:
    """Rows and distortion of each cluster, its number in order of first appearance, and the rows of its clustering."""
    per = measured.groupBy("clustering_id", "cluster").agg(F.count("*").alias("f"), F.sum("d").alias("distortion"), F.min("row_id").alias("first_row"))
    w = Window.partitionBy("clustering_id")
    return per.withColumns({"n": F.sum("f").over(w), "place": F.row_number().over(w.orderBy("first_row"))})


def rd_points(stats: DataFrame) -> DataFrame:
    """(clustering_id, distortion, entropy in bits)."""
    h = F.log2(F.sum("f")) - F.sum(xlog2x(F.col("f"))) / F.sum("f")
    return stats.groupBy("clustering_id").agg(F.sum("distortion").alias("distortion"), F.greatest(h, F.lit(0.0)).alias("entropy"))


def _chain(points: list[tuple]) -> list[tuple]:
    """The strict lower hull of (distortion, entropy, clustering_id): of equal distortions the lowest, of equal points the first."""
    out: list[tuple] = []
    for p in sorted(points):
        if out and out[-1][0] == p[0]:
            continue
        while len(out) > 1 and (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) >= (p[1] - out[-2][1]) * (out[-1][0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out


def _hulls(points: DataFrame) -> DataFrame:
    """The lower hull of each partition's points; of all points only those on some partition's hull can be on theirs."""
    names, schema = points.columns, points.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held = _chain(held + list(zip(*(b[c].to_pylist() for c in names))))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), b.schema.types)], names=names)

    return points.mapInArrow(run, schema)


#: Hulls that are merged at a time.
MERGED = 8


def lower_hull(points: DataFrame) -> DataFrame:
    """The descending part of the strict lower hull, by distortion: clustering_id, distortion, entropy, curve_pos.

    Tasks find the hulls of their own points by a monotone chain, and some hulls at a time are merged to the next one, until one is left:
    nothing meets that isn't on a hull, and the last task gets what may be on the curve."""
    importable(points.sparkSession)
    p = _hulls(points.select("distortion", "entropy", "clustering_id"))
    parts = points.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = int(parts) // MERGED
    while parts > 1:
        p, parts = _hulls(p.repartition(parts)), parts // MERGED
    p = _hulls(p.repartition(1))  # what is left of all others
    names = ["clustering_id", "distortion", "entropy", "curve_pos"]

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pos = math.inf, 0
        for b in batches:
            h = np.minimum.accumulate(np.concatenate([[last], b["entropy"].to_numpy()]))
            b = b.filter(pa.array(h[1:] < h[:-1]))
            yield pa.RecordBatch.from_arrays([b["clustering_id"], b["distortion"], b["entropy"], pa.array(np.arange(pos + 1, pos + 1 + b.num_rows, dtype=np.int32))], names=names)
            last, pos = h[-1], pos + b.num_rows

    return p.mapInArrow(down, StructType([p.schema["clustering_id"], p.schema["distortion"], p.schema["entropy"], StructField("curve_pos", IntegerType())]))


def slopes(curve: DataFrame) -> DataFrame:
    """curve with slope to the vertex before; the first has the second's."""
    w = Window.orderBy("distortion")
    k = (F.col("entropy") - F.lag("entropy").over(w)) / (F.col("distortion") - F.lag("distortion").over(w))
    return curve.withColumn("slope", k).withColumn("slope", F.coalesce("slope", F.lead("slope").over(w)))


def boundaries(stats: DataFrame, curve: DataFrame) -> DataFrame:
    """(curve_pos, clustering_id, cluster, radius) for the vertices that are tested, all but the first."""
    radius = change_of_entropy(F.col("f"), F.col("n")) / -F.col("slope")
    return stats.join(F.broadcast(slopes(curve).where("curve_pos >= 2")), "clustering_id").select("curve_pos", "clustering_id", "cluster", radius.alias("radius"))  # a row per clustering


def purge(clusters: DataFrame, dims: int, distortion: Distortion = dist) -> DataFrame:
    """Rows at or beyond their cluster's radius at every tested vertex: row_id.  Curves of one vertex: none.

    What each row costs is written once, without its vector, as the curve and the test both read it."""
    measured = kept(distances(represent(clusters, dims), dims, distortion).select("clustering_id", "cluster", "row_id", "d"))
    stats = cluster_stats(measured)
    edges = kept(boundaries(stats, lower_hull(rd_points(stats))))  # a row for each tested cluster; its size is known to the join
    tested = measured.join(edges, ["clustering_id", "cluster"])
    return tested.groupBy("row_id").agg(F.bool_and(F.col("d") >= F.col("radius")).alias("out")).where("out").select("row_id")


def zones(clusters: DataFrame, dims: int, distortion: Distortion = dist) -> DataFrame:
    """Distinct representations with a positive radius at each tested vertex."""
    represented = represent(clusters, dims)
    stats = cluster_stats(distances(represented, dims, distortion))
    edges = boundaries(stats, lower_hull(rd_points(stats))).where("radius > 0")
    return represented.select("clustering_id", "cluster", "rep").dropDuplicates(["clustering_id", "cluster"]).join(edges, ["clustering_id", "cluster"])


def purge_parametric(clusters: DataFrame, dims: int, ks: list[float], distortion: Distortion = dist) -> DataFrame:
    """(row_id, k) beyond change of entropy / k * total distortion, for every k with one pass over the rows."""
    measured = distances(represent(clusters, dims), dims, distortion)
    stats = cluster_stats(measured)
    total = Window.partitionBy("clustering_id")
    edges = stats.withColumn("total", F.sum("distortion").over(total)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    edges = edges.select("clustering_id", "cluster", "k", (change_of_entropy(F.col("f"), F.col("n")) / F.col("k") * F.col("total")).alias("radius"))
    return measured.join(edges, ["clustering_id", "cluster"]).where("d >= radius").select("row_id", "k")


def perturb(measured: DataFrame, kind: str) -> DataFrame:
    """Labels of (row_id, cluster, d) with one row moved to a cluster of its own: of the largest or smallest cluster of
    several rows (``max``, ``min``), the farthest or nearest row (``max``, ``min``), e.g. ``maxmin``.  Ties: the first."""
    which, row = kind[:3], kind[3:]
    size = F.desc("n") if which == "max" else F.asc("n")
    sizes = measured.groupBy("cluster").agg(F.count("*").alias("n"))
    target = (sizes if which == "max" else sizes.where("n > 1")).orderBy(size, "cluster").limit(1).select("cluster")
    far = F.round("d", 9)
    moved = measured.join(F.broadcast(target), "cluster").orderBy(far.desc() if row == "max" else far.asc(), "row_id").limit(1).select(F.col("row_id").alias("moved"))  # one row
    label = measured.agg((F.max("cluster") + 1).alias("label"))
    return measured.join(F.broadcast(moved.crossJoin(label)), F.col("row_id") == F.col("moved"), "left").select("row_id", F.coalesce("label", "cluster").alias("cluster"))


def envelope(points: DataFrame, at: DataFrame) -> DataFrame:
    """For each value of at (i): the least h of points (d, h) with d <= i."""
    both = points.select("d", "h", F.lit(None).cast("long").alias("i")).union(at.select(F.col("i").cast("double"), F.lit(None).cast("double"), "i"))
    w = Window.orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("least", F.min("h").over(w)).where("i IS NOT NULL AND least IS NOT NULL").select("i", F.col("least").alias("h"))


def interpolate(curve: DataFrame, n: int) -> DataFrame:
    """n equidistant points of the piecewise linear curve (d, h)."""
    w = Window.orderBy("d")
    parts = curve.select("d", "h", F.lead("d").over(w).alias("d2"), F.lead("h").over(w).alias("h2")).where("d2 IS NOT NULL")
    ends = curve.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    x = curve.sparkSession.range(n).crossJoin(F.broadcast(ends)).select("id", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("id") / (n - 1)).alias("x"), "hi")  # n points
    inside = (F.col("x") >= F.col("d")) & ((F.col("x") < F.col("d2")) | ((F.col("d2") == F.col("hi")) & (F.col("x") >= F.col("hi"))))
    return x.join(F.broadcast(parts), inside).select("id", "x", (F.col("h") + (F.col("h2") - F.col("h")) * (F.col("x") - F.col("d")) / (F.col("d2") - F.col("d"))).alias("h"))


def single(clusters: DataFrame, name: int = 1) -> DataFrame:
    """(row_id, cluster, x) as the one clustering of that id."""
    return clusters.select(F.lit(name).alias("clustering_id"), "row_id", "cluster", "x")


def with_perturbed(clusters: DataFrame, kind: str, dims: int, distortion: Distortion = dist) -> DataFrame:
    """The clustering (1) and its perturbation (2)."""
    base = single(clusters)
    labels = perturb(distances(represent(base, dims), dims, distortion).select("row_id", "cluster", "d"), kind)
    return base.union(clusters.select("row_id", "x").join(labels, "row_id").select(F.lit(2).alias("clustering_id"), "row_id", "cluster", "x"))


def rate(d: Column) -> Column:
    """The theoretical curve log2(1000 / D)."""
    return F.log2(F.lit(1000.0) / d)


# -- many clusterings at once: (grid, row_id, cluster, x), one for each point of a grid of parameters


def measure(clusters: DataFrame, dims: int, distortion: Distortion = dist) -> DataFrame:
    """clusters (grid, row_id, cluster, x) with rep, the cluster's mean, and d, the distortion by it."""
    means = clusters.groupBy("grid", "cluster").agg(mean(F.col("x"), dims).alias("rep"))
    return clusters.join(means, ["grid", "cluster"]).withColumn("d", distortion(F.col("x"), F.col("rep"), dims))


def moves(measured: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(grid, cluster, f) of all clusters, and for each grid the row that a perturbation of that kind moves: grid, n, total (distortion), s
    (sum of f log2 f), cluster, f, moved (row_id), and first, its row.  See ``perturb`` for kinds and ties."""
    extra = [c for c in ("x", "rep", "d", "second") if c in measured.columns]
    row, far = F.struct("row_id", *extra), F.round("d", 9)
    pick = F.max_by(row, F.struct(far, -F.col("row_id"))) if kind[3:] == "max" else F.min_by(row, F.struct(far, "row_id"))
    stats = measured.groupBy("grid", "cluster").agg(F.count("*").alias("f"), F.sum("d").alias("distortion"), pick.alias("row"))
    target = F.struct("cluster", "f", "row")
    if kind[:3] == "max":
        chosen = F.max_by(target, F.struct("f", -F.col("cluster")))
    else:
        chosen = F.min_by(target, F.when(F.col("f") > 1, F.struct("f", "cluster")))
    picks = stats.groupBy("grid").agg(F.sum("f").alias("n"), F.sum("distortion").alias("total"), F.sum(xlog2x(F.col("f"))).alias("s"), chosen.alias("t"))
    return stats.select("grid", "cluster", "f"), picks.select("grid", "n", "total", "s", "t.cluster", "t.f", F.col("t.row.row_id").alias("moved"), F.col("t.row").alias("first"))


def purge_moved(measured: DataFrame, stats: DataFrame, picks: DataFrame, after: DataFrame) -> DataFrame:
    """(grid, row_id) beyond the radius that the slope between a clustering and its perturbation sets.  after (grid, total2): the
    perturbation's distortion.  None where the perturbation does not lower the distortion and raise the entropy: a curve of one vertex.
    Where nothing else changes, the moved row lies on its cluster's radius, so what is equal in nine decimals is beyond it."""
    f, n = F.col("f"), F.col("n")
    gain = (xlog2x(f) - xlog2x(f - 1)) / n
    slopes = picks.join(after, "grid").where(F.col("total2") < F.col("total")).select("grid", "n", (-gain / (F.col("total") - F.col("total2"))).alias("slope")).where("slope < 0")
    edges = stats.join(slopes, "grid").select("grid", "cluster", (change_of_entropy(f, n) / -F.col("slope")).alias("radius"))
    return measured.select("grid", "cluster", "row_id", "d").join(edges, ["grid", "cluster"]).where(F.round(F.col("d") - F.col("radius"), 9) >= 0).select("grid", "row_id")


def purge_against(first: DataFrame, second: DataFrame) -> DataFrame:
    """(grid, row_id): purging by each grid's curve of two clusterings (grid, row_id, cluster, d) of the same rows.  The one with more
    distortion is tested; where it hasn't the lower entropy, or the two are equal in nine decimals, the curve has one vertex and nothing
    is purged.  What is equal in nine decimals to its radius is beyond it.  Both should be written tables."""
    names = ["grid", "row_id", "cluster", "d"]
    both = first.select(F.lit(1).alias("side"), *names).unionByName(second.select(F.lit(2).alias("side"), *names))
    stats = both.groupBy("grid", "side", "cluster").agg(F.count("*").alias("f"), F.sum("d").alias("distortion"))
    h = F.log2(F.sum("f")) - F.sum(xlog2x(F.col("f"))) / F.sum("f")
    points = stats.groupBy("grid", "side").agg(F.sum("f").alias("n"), F.sum("distortion").alias("total"), h.alias("h"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    pair = points.groupBy("grid").agg(F.max("n").alias("n"), *[of(k, c).alias(f"{c}{k}") for k in (1, 2) for c in ("total", "h")])
    slope = (F.col("h1") - F.col("h2")) / (F.col("total1") - F.col("total2"))
    apart = (F.round(F.abs(F.col("total1") - F.col("total2")), 9) > 0) & (F.round(F.abs(F.col("h1") - F.col("h2")), 9) > 0)
    tested = F.when(F.col("total1") > F.col("total2"), 1).otherwise(2).alias("side")
    curve = pair.where(apart).select("grid", tested, "n", slope.alias("slope")).where("slope < 0")
    edges = stats.join(curve, ["grid", "side"]).select("grid", "side", "cluster", (change_of_entropy(F.col("f"), F.col("n")) / -F.col("slope")).alias("radius"))
    return both.join(edges, ["grid", "side", "cluster"]).where(F.round(F.col("d") - F.col("radius"), 9) >= 0).select("grid", "row_id")


#: Clusterings (grid, row_id, cluster, x, rep, d) -> the labels (grid, row_id, cluster) they are held against.
Perturbation = Callable[[DataFrame], DataFrame]


def each_farthest(measured: DataFrame) -> DataFrame:
    """A perturbation: of every cluster of several rows the farthest row forms a cluster of its own.  Ties: the first.  Labels are from 0."""
    row = F.max_by("row_id", F.struct(F.round("d", 9), -F.col("row_id")))
    moved = measured.groupBy("grid", "cluster").agg(F.count("*").alias("f"), row.alias("row_id")).where("f > 1")
    moved = moved.select("grid", "row_id", (-1 - F.col("row_id")).alias("alone"))
    return measured.join(moved, ["grid", "row_id"], "left").select("grid", "row_id", F.coalesce("alone", F.col("cluster").cast("long")).alias("cluster"))


def purge_perturbed(measured: DataFrame, kind: str | Perturbation, dims: int, distortion: Distortion = dist) -> DataFrame:
    """(grid, row_id): purging of each clustering, by means, against its perturbation: one of ``perturb``'s kinds, or any function.  The
    kinds change one cluster's mean, so only that cluster's rows are measured again; what a function returns is measured as a whole.
    measured should be a written table, as three scans read it."""
    if callable(kind):
        labels = kind(measured).join(measured.select("grid", "row_id", "x"), ["grid", "row_id"])
        return purge_against(measured, kept(measure(labels, dims, distortion)))
    stats, picks = moves(measured, kind)
    rest = F.array(*[(F.col("f") * F.col("first.rep")[i] - F.col("first.x")[i]) / (F.col("f") - 1) for i in range(dims)])
    target = picks.where("f > 1").select("grid", "cluster", "moved", rest.alias("mean2"))
    again = measured.select("grid", "cluster", "row_id", "x", "d").join(target, ["grid", "cluster"]).where("row_id <> moved")
    change = again.groupBy("grid").agg(F.sum(distortion(F.col("x"), F.col("mean2"), dims)).alias("new"), F.sum("d").alias("old"))
    after = picks.join(change, "grid").select("grid", (F.col("total") - F.col("old") - F.col("first.d") + F.col("new")).alias("total2"))
    return purge_moved(measured, stats, picks, after)


def flagged_by(measured: DataFrame, ks: list[float]) -> DataFrame:
    """(grid, row_id, flags): how many of the ascending ks, from the largest down, flag the row by the parametric purge."""
    per = measured.groupBy("grid", "cluster").agg(F.count("*").alias("f"), F.sum("d").alias("distortion"))
    total = per.groupBy("grid").agg(F.sum("f").alias("n"), F.sum("distortion").alias("total"))
    change = per.join(total, "grid").select("grid", "cluster", change_of_entropy(F.col("f"), F.col("n")).alias("change"), "total")
    flags = F.size(F.filter(F.array(*map(F.lit, ks)), lambda k: F.col("d") >= F.col("change") / k * F.col("total")))
    return measured.select("grid", "cluster", "row_id", "d").join(change, ["grid", "cluster"]).select("grid", "row_id", flags.alias("flags"))


def critical(measured: DataFrame) -> DataFrame:
    """(grid, row_id, k): the least multiplier with which the parametric purge flags a row; null: none does."""
    per = measured.groupBy("grid", "cluster").agg(F.count("*").alias("f"), F.sum("d").alias("distortion"))
    total = per.groupBy("grid").agg(F.sum("f").alias("n"), F.sum("distortion").alias("total"))
    change = per.join(total, "grid").select("grid", "cluster", (change_of_entropy(F.col("f"), F.col("n")) * F.col("total")).alias("limit"))
    k = F.when(F.col("limit") == 0, 0.0).when(F.col("d") > 0, F.col("limit") / F.col("d"))
    return measured.select("grid", "cluster", "row_id", "d").join(change, ["grid", "cluster"]).select("grid", "row_id", k.alias("k"))
