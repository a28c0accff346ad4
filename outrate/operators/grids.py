"""Grid searches: every detector over its grid of parameters, and the best point of the grid by each metric.

A grid is a small table; all its points are computed together, keyed by ``grid``, from what they share: one pass over the rows for all
centers, one table of neighbours, one tree of merges.  Results are counted where they are, and only a row for each grid point comes
together.  Grids are those of the published experiments: ks from 10 down to 2, 30 multipliers from 0.1 to 10, all cuts of a tree, all
distinct neighbour distances; ``thin`` takes every so many of the long ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outrate.functions.vectors import Distortion, dist
from outrate.operators import cuts, dense, detectors, factors, walks
from outrate.operators import density as trees
from outrate.operators import ratedistortion as rd
from outrate.operators.metrics import best, rates
from outrate.operators.neighbors import knn
from outrate.operators.prefix import numbered, running
from outrate.operators.state import kept, shared_out


class Task(NamedTuple):
    """Points (row_id, x), rows that are truly outliers (row_id), how many there are of both, and what several searches have in common."""

    points: DataFrame
    truth: DataFrame
    dims: int
    n: int
    m: int
    shared: dict

    def once(self, key: tuple, make: Callable[[], object]):
        """What make makes, at the first call with that key."""
        if key not in self.shared:
            self.shared[key] = make()
        return self.shared[key]


def task(points: DataFrame, truth: DataFrame, dims: int) -> Task:
    points = shared_out(points.select(F.col("row_id").cast("long").alias("row_id"), "x"))
    truth = kept(truth.select(F.col("row_id").cast("long").alias("row_id")).distinct())
    return Task(points, truth, dims, points.count(), truth.count(), {})


Params = list[tuple[float, float | None]]
SCORED = "grid long, p1 double, p2 double"


def spread(a: float, b: float, n: int) -> list[float]:
    """n numbers from a to b, evenly."""
    return [a + (b - a) * i / (n - 1) for i in range(n)] if n > 1 else [a]


def _table(t: Task, params: Params) -> DataFrame:
    return t.points.sparkSession.createDataFrame([(g, float(p), None if q is None else float(q)) for g, (p, q) in enumerate(params)], SCORED)


def _counted(t: Task, counts: DataFrame, params: DataFrame) -> DataFrame:
    """counts (grid, tp, p): right and all predictions -> grid_order, p1, p2 and the metrics; grid points without predictions have none right."""
    tp, p = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("tp", "p"))
    every = params.join(counts, "grid", "left").select(F.col("grid").alias("grid_order"), "p1", "p2", tp.alias("tp"), (p - tp).alias("fp"), (t.m - tp).alias("fn"), (t.n - t.m - (p - tp)).alias("tn"))
    return rates(every, ["grid_order", "p1", "p2"])


def scored(t: Task, found: DataFrame, params: Params | DataFrame) -> DataFrame:
    """found (grid, row_id): each grid point's predictions; params: the grid, as a list or as a table (grid, p1, p2)."""
    hit = t.truth.withColumn("hit", F.lit(True))
    counts = found.join(hit, "row_id", "left").groupBy("grid").agg(F.count("hit").alias("tp"), F.count("*").alias("p"))
    return _counted(t, counts, params if isinstance(params, DataFrame) else _table(t, params))


def flag_counts(t: Task, found: DataFrame, ks: list[float]) -> DataFrame:
    """found (grid, row_id, flags) -> (grid, k, tp, p): k, a place in ks; see ``scored_flags``."""
    hit = t.truth.withColumn("hit", F.lit(True))
    per = found.where("flags > 0").join(hit, "row_id", "left").groupBy("grid", "flags").agg(F.count("hit").alias("tp"), F.count("*").alias("p"))
    each = per.select("grid", "tp", "p", F.explode(F.sequence(F.lit(len(ks)) - F.col("flags"), F.lit(len(ks) - 1))).alias("k"))
    return each.groupBy("grid", "k").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"))


def scored_flags(t: Task, found: DataFrame, grids: int, ks: list[float], names: list[float]) -> DataFrame:
    """found (grid, row_id, flags): by how many of the ascending ks a row is flagged, the largest first.  A grid point is a clustering and a k."""
    counts = flag_counts(t, found, ks).select((F.col("grid") * len(ks) + F.col("k")).alias("grid"), "tp", "p")
    return _counted(t, counts, _table(t, [(names[g], k) for g in range(grids) for k in ks]))


def top(t: Task, scores: DataFrame) -> DataFrame:
    """The m rows of each grid point with the highest scores (grid, row_id, score); not-a-number first; ties: the later row."""
    w = Window.partitionBy("grid").orderBy(F.isnan("score").desc(), F.col("score").desc_nulls_first(), F.desc("row_id"))
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= t.m).select("grid", "row_id")


def winners(graded: DataFrame) -> DataFrame:
    """(metric, p1, p2, value): the grid point with the highest value of each metric; ties: the first."""
    return best(graded.withColumn("params", F.struct("p1", "p2")), "params").select("metric", "params.p1", "params.p2", "value")


KS = list(range(10, 1, -1))
MULTIPLIERS = spread(0.1, 10, 30)


def ocrd(t: Task, thin: int = 1) -> DataFrame:
    """As many betas as there are rows, as a table."""
    number = t.points.sparkSession.range(0, t.n, thin).select(F.floor(F.col("id") / thin).cast("long").alias("grid"), (0.1 + (10 - 0.1) * F.col("id") / max(1, t.n - 1)).alias("beta"))
    betas = kept(number)
    even = kept(detectors.scaled(t.points, t.dims).withColumn("x", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))))
    return _counted(t, detectors.ocrd_counts(even, t.truth, t.dims, betas), betas.select("grid", F.col("beta").alias("p1"), F.lit(None).cast("double").alias("p2")))


def kmeans(t: Task, ks: list[int], starts: int = 1) -> DataFrame:
    return t.once(("kmeans", *ks, starts), lambda: kept(_kmeans(t, ks, starts)))


def _kmeans(t: Task, ks: list[int], starts: int) -> DataFrame:
    """(grid, row_id, cluster, d) for each k, numbered as in ks: of several starts, the first of which takes the first rows and the others
    rows drawn by a hash, that with the least sum of squares.  All starts of all ks advance together, one job a round."""
    centers = {}
    for s, rows in enumerate(detectors.drawn(t.points, max(ks), starts, t.dims)):
        centers |= {i * starts + s: (np.arange(len(rows[:k])), rows[:k]) for i, k in enumerate(ks)}
    found = kept(detectors.hartigan_all(t.points, centers, t.dims, starts))
    return found.select(F.floor(F.col("grid") / starts).cast("long").alias("grid"), "row_id", "cluster", "d")


def _with_rows(t: Task, clusters: DataFrame) -> DataFrame:
    return clusters.select("grid", "row_id", "cluster").join(t.points, "row_id")


def kmeans_singletons(t: Task, ks: list[int] = KS, starts: int = 1) -> DataFrame:
    return scored(t, detectors.singletons_all(kmeans(t, ks, starts)), [(k, None) for k in ks])


def _starts(t: Task, grids: dict[int, int]) -> detectors.Centers:
    return detectors.started(detectors.first_rows(t.points, max(grids.values())), grids)


def kmeans_mm(t: Task, ks: list[int] = KS) -> DataFrame:
    return scored(t, detectors.kmeans_mm_all(t.points, _starts(t, dict(enumerate(ks))), t.dims, t.m), [(k, None) for k in ks])


def kmor(t: Task, ks: list[int] = KS, gammas: list[float] = MULTIPLIERS, rounds: int = 10) -> DataFrame:
    params = [(k, g) for k in ks for g in gammas]
    centers = _starts(t, {i: k for i, (k, _) in enumerate(params)})
    return scored(t, detectors.kmor_all(t.points, centers, t.dims, {i: g for i, (_, g) in enumerate(params)}, rounds), params)


def _large(grids: list[int]) -> F.Column:
    return F.create_map(*[F.lit(v).cast("long") for i, k in enumerate(grids) for v in (i, min(k - 1, 5))])[F.col("grid")].alias("large")


def cblof_kmeans(t: Task, ks: list[int] = KS, starts: int = 1) -> DataFrame:
    rows = kept(_with_rows(t, kmeans(t, ks, starts)).select("*", _large(ks)))
    return scored(t, top(t, detectors.cblof_all(rows, t.dims)), [(k, None) for k in ks])


def cp_kmeans(t: Task, ks: list[int] = KS, kind: str | rd.Perturbation = "maxmax", starts: int = 1, distortion: Distortion = dist) -> DataFrame:
    measured = kept(rd.measure(_with_rows(t, kmeans(t, ks, starts)), t.dims, distortion))
    return scored(t, rd.purge_perturbed(measured, kind, t.dims, distortion), [(k, None) for k in ks])


def cpp_kmeans(t: Task, ks: list[int] = KS, multipliers: list[float] = MULTIPLIERS, starts: int = 1, distortion: Distortion = dist) -> DataFrame:
    measured = kept(rd.measure(_with_rows(t, kmeans(t, ks, starts)), t.dims, distortion))
    return scored_flags(t, rd.flagged_by(measured, multipliers), len(ks), multipliers, ks)


def tree(t: Task, thetas: list[int]) -> DataFrame:
    """(grid, row_id, cluster, x): the cuts of one complete-linkage tree, numbered as in thetas."""
    merges = t.once(("merges",), lambda: detectors.hac_merges(t.points))
    found = detectors.cut(t.points, merges, thetas)
    number = t.points.sparkSession.createDataFrame([(k, i) for i, k in enumerate(thetas)], "theta long, grid long")
    return kept(found.withColumnRenamed("grid", "theta").join(number, "theta").select("grid", "row_id", "cluster").join(t.points, "row_id"))  # the grid


def hac_singletons(t: Task, thin: int = 1) -> DataFrame:
    """A row is alone until its first merge, so that one number of each row stands for all cuts."""
    merges = t.once(("merges",), lambda: detectors.hac_merges(t.points))
    until = merges.select(F.explode(F.array("a", "b")).alias("row_id"), F.col("step").cast("long").alias("at")).groupBy("row_id").agg(F.min("at").alias("at"))
    hit = t.truth.withColumn("hit", F.lit(1))
    rows = t.points.select("row_id").join(until, "row_id", "left").join(hit, "row_id", "left").select(F.coalesce("at", F.lit(t.n)).alias("at"), F.lit(1).alias("p"), F.coalesce("hit", F.lit(0)).alias("tp"), F.lit(-1).cast("long").alias("grid"))
    # The cut into theta clusters comes after n - theta merges.
    cuts = t.points.sparkSession.range(0, t.n, thin).select(F.col("id").alias("at"), F.lit(0).alias("p"), F.lit(0).alias("tp"), F.floor(F.col("id") / thin).cast("long").alias("grid"))
    gone = kept(running(rows.union(cuts), "at", ["p", "tp"]).where("grid >= 0"))
    counts = gone.select("grid", (t.m - F.col("sum_tp")).alias("tp"), (t.n - F.col("sum_p")).alias("p"))
    return _counted(t, counts, gone.select("grid", (t.n - F.col("at")).cast("double").alias("p1"), F.lit(None).cast("double").alias("p2")))


def cblof_hac(t: Task, thin: int = 1) -> DataFrame:
    if t.n > 3 and walks.walkable(t.n, t.dims + 8):
        merges = t.once(("merges",), lambda: detectors.hac_merges(t.points))
        counts = walks.cblof_cuts(t.points, t.truth, merges, detectors.stretches(t.points, merges), t.n, t.m, t.dims, thin)
        number = t.points.sparkSession.range(3, t.n, thin).select(F.floor((F.col("id") - 3) / thin).cast("long").alias("grid"), F.col("id").cast("double").alias("p1"), F.lit(None).cast("double").alias("p2"))
        return _counted(t, counts.select(F.floor((t.n - F.col("step") - 3) / thin).cast("long").alias("grid"), "tp", "p"), number)
    thetas = list(range(3, t.n))[::thin]
    return scored(t, top(t, detectors.cblof_all(kept(tree(t, thetas).select("*", _large(thetas))), t.dims)), [(k, None) for k in thetas])


def cp_hac(t: Task, kind: str | rd.Perturbation = "maxmax", thin: int = 1, distortion: Distortion = dist) -> DataFrame:
    if callable(kind):  # which may give any labels to any row, so that all rows are labelled at all cuts
        thetas = list(range(t.n - 1, 0, -1))[::thin]
        return scored(t, rd.purge_perturbed(kept(rd.measure(tree(t, thetas), t.dims, distortion)), kind, t.dims, distortion), [(k, None) for k in thetas])
    grown = _growth(t, distortion)
    counts = cuts.purged(grown, t.n, kind, t.dims, distortion)
    cut = _cuts(t, thin)
    return _counted(t, counts.join(cut, "step").select("grid", "tp", "p"), cut.select("grid", F.col("theta").alias("p1"), F.lit(None).cast("double").alias("p2")))


def cpp_hac(t: Task, multipliers: list[float] = MULTIPLIERS, thin: int = 1, mode: str = "canonical", distortion: Distortion = dist) -> DataFrame:
    """mode ``reference``: the original's grid, which by a slip holds the first cut only."""
    cut = _cuts(t, thin)
    cut = cut.where("grid = 0") if mode == "reference" else cut
    ks = t.points.sparkSession.createDataFrame(list(enumerate(multipliers)), "k long, p2 double")
    every = cut.crossJoin(F.broadcast(ks)).withColumn("place", F.col("grid") * len(multipliers) + F.col("k"))  # the multipliers
    counts = cuts.flagged(_growth(t, distortion), cut.select("step"), t.n, multipliers).join(cut, "step")
    counts = counts.select((F.col("grid") * len(multipliers) + F.col("k")).alias("grid"), "tp", "p")
    return _counted(t, counts, every.select(F.col("place").alias("grid"), F.col("theta").alias("p1"), "p2"))


def _growth(t: Task, distortion: Distortion) -> cuts.Growth:
    merges = t.once(("merges",), lambda: detectors.hac_merges(t.points))
    return t.once(("growth", distortion), lambda: cuts.growth(t.points, t.truth, merges, t.n, t.dims, distortion))


def _cuts(t: Task, thin: int) -> DataFrame:
    """(grid, theta, step): the cuts into n - 1 to 1 clusters, theta clusters are left after n - theta merges."""
    number = t.points.sparkSession.range(0, max(0, t.n - 1), thin)
    return number.select(F.floor(F.col("id") / thin).cast("long").alias("grid"), (t.n - 1 - F.col("id")).cast("double").alias("theta"), (F.col("id") + 1).alias("step"))


def least_points(t: Task) -> list[int]:
    return [t.dims + i for i in range(1, 11)]


def _lists(t: Task) -> DataFrame:
    """Neighbour lists (a, b, d, rk) for all numbers of points."""
    return t.once(("lists",), lambda: kept(knn(t.points, max(least_points(t)), t.dims)))


def dbscan_noise(t: Task) -> DataFrame:
    """All distinct neighbour distances as eps, for each number of points.  A row is noise below the least of its own core distance and the
    greater of the distance to a neighbour and that one's core distance, so one number of each row stands for all eps."""
    leasts = least_points(t)
    near = _lists(t)
    spark = t.points.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(k,) for k in leasts], "least int"))  # ten numbers
    core = kept(near.join(sizes, F.col("rk") == F.col("least") - 1).select("least", "a", F.col("d").alias("core")))
    other = core.select("least", F.col("a").alias("b"), F.col("core").alias("core_b"))
    reach = near.join(sizes, F.col("rk") < F.col("least")).join(other, ["least", "b"]).groupBy("least", "a").agg(F.min(F.greatest("d", "core_b")).alias("reach"))
    hit = t.truth.select(F.col("row_id").alias("a"), F.lit(1).alias("hit"))
    rows = core.join(reach, ["least", "a"]).join(hit, "a", "left").select("least", F.least("core", "reach").alias("v"), F.coalesce("hit", F.lit(0)).alias("hit"), F.lit(False).alias("eps"))
    eps = near.join(sizes, F.col("rk") == F.col("least")).select("least", F.col("d").alias("v"), F.lit(0).alias("hit"), F.lit(True).alias("eps")).distinct()
    w = Window.partitionBy("least").orderBy("v").rangeBetween(Window.unboundedPreceding, 0)
    reached = F.sum(F.when(F.col("eps"), 0).otherwise(1)).over(w)
    below = rows.unionByName(eps).select("least", "v", "eps", reached.alias("reached"), F.sum("hit").over(w).alias("hits")).where("eps")
    graded = kept(numbered(below, ["least", "v"], "grid").select(F.col("grid").cast("long").alias("grid"), F.col("least").cast("double").alias("p1"), F.col("v").alias("p2"), (t.m - F.col("hits")).alias("tp"), (t.n - F.col("reached")).alias("p")))
    return _counted(t, graded.select("grid", "tp", "p"), graded.select("grid", "p1", "p2"))


def density(t: Task) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.once(("density",), lambda: _density(t))


def _forest(t: Task) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Neighbour lists, ``density.forest``, and the grid (grid, eps, least): for each number of points all distinct neighbour distances, in their order."""
    leasts = least_points(t)
    near = _lists(t)
    eps = near.where(F.col("rk").isin(leasts)).select(F.col("rk").cast("int").alias("least"), F.col("d").alias("eps")).distinct()
    grid = kept(numbered(eps, ["least", "eps"], "grid").select((F.col("grid") - 1).cast("long").alias("grid"), "eps", "least"))
    return near, trees.forest(t.points, near, leasts, t.dims), grid


def _density(t: Task) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid, row_id, cluster) with noise as clusters of its own; neighbour lists; and the grid."""
    near, tree, grid = t.once(("forest",), lambda: _forest(t))
    return kept(detectors.alone(trees.clusters(t.points, near, tree, grid))), near, grid


def _dense(t: Task) -> dense.Dense:
    return t.once(("dense",), lambda: _spans(t))


def _spans(t: Task) -> dense.Dense:
    near, tree, grid = t.once(("forest",), lambda: _forest(t))
    return dense.Dense(dense.represented(t.points, near, dense.members(near, tree, grid), grid, t.dims), t.truth, grid, t.n, t.m)


def _walked(t: Task, visit: Callable[[walks.Dense], object]) -> tuple[DataFrame, DataFrame] | None:
    """(step, k, p, tp) of ``walks.dense_counts``, and the grid; None: the table is too large."""
    listed = max(least_points(t))
    if not walks.walkable(t.n, walks.dense_numbers(t.dims, listed)):
        return None
    near, tree, grid = t.once(("forest",), lambda: _forest(t))
    if grid.isEmpty():
        return None
    held = t.once(("cores",), lambda: dense.cores(tree, grid))
    return kept(walks.dense_counts(t.points, t.truth, near, held, grid, t.m, t.dims, listed, visit)), grid


def _named(grid: DataFrame) -> DataFrame:
    return grid.select("grid", F.col("least").cast("double").alias("p1"), F.col("eps").alias("p2"))


def cblof_dbscan(t: Task) -> DataFrame:
    if walked := _walked(t, walks.Dense.factors):
        return _counted(t, walked[0].select(F.col("step").alias("grid"), "tp", "p"), _named(walked[1]))
    clusters, near, grid = density(t)
    large = clusters.groupBy("grid").agg(F.least(F.count_distinct("cluster") - 1, F.lit(5)).alias("large"))
    scores = trees.cblof_knn(clusters.join(large, "grid"), t.points, near, t.dims, t.m)
    return scored(t, top(t, scores.withColumn("score", F.round("score", 9))), _named(grid))


def cp_dbscan(t: Task, kind: str = "maxmax") -> DataFrame:
    if walked := _walked(t, lambda at: at.purged(kind)):
        return _counted(t, walked[0].select(F.col("step").alias("grid"), "tp", "p"), _named(walked[1]))
    found = _dense(t)
    return _counted(t, found.purged(kind).select(F.col("step").alias("grid"), "tp", "p"), _named(found.grid))


def cpp_dbscan(t: Task, multipliers: list[float] = MULTIPLIERS) -> DataFrame:
    """p1: eps; the number of points is told by the order of the grid."""
    walked = _walked(t, lambda at: at.flagged(multipliers))
    found, grid = walked or (_dense(t).flagged(multipliers), _dense(t).grid)
    ks = t.points.sparkSession.createDataFrame(list(enumerate(multipliers)), "k int, p2 double")
    counts = found.select((F.col("step") * len(multipliers) + F.col("k")).alias("grid"), "tp", "p")
    place = (F.col("grid") * len(multipliers) + F.col("k")).alias("grid")
    return _counted(t, counts, grid.crossJoin(F.broadcast(ks)).select(place, F.col("eps").alias("p1"), "p2"))  # the multipliers


def lps(t: Task, ks: list[int] | None = None) -> DataFrame:
    ks = ks or list(range(max(2, -(-t.dims // 2)), 1, -1))
    near, even = kept(knn(t.points, max(ks), t.dims)), kept(detectors.scaled(t.points, t.dims))
    return scored(t, top(t, detectors.lps_all(near, even, ks, 2, t.dims)), [(k, None) for k in ks])


def lof(t: Task, ks: list[int] | None = None) -> DataFrame:
    """For each k, from n - 1 down to 1."""
    ks = ks or list(range(t.n - 1, 0, -1))
    spark = t.points.sparkSession
    number = list(enumerate(ks))
    if not ks or max(ks) <= factors.LISTED:
        rows = factors.lof_every(t.points, ks, t.dims).join(spark.createDataFrame(number, "grid long, k int"), "k").select("grid", "row_id", F.round("score", 9).alias("score"))
        return scored(t, top(t, rows), [(k, None) for k in ks])
    classes, members = detectors.equal_rows(t.points)
    found, as_ = factors.lof_classes(classes, ks, t.dims)
    counts = top_classes(t, found.select("k", "class", F.round("score", 9).alias("score")), members)
    names = spark.createDataFrame([(g, as_[k]) for g, k in number if k in as_], "grid long, k long")
    return _counted(t, names.join(counts, "k").drop("k"), _table(t, [(k, None) for k in ks]))


def top_classes(t: Task, scores: DataFrame, members: DataFrame) -> DataFrame:
    """(k, tp, p): what ``top`` finds, from a score for each class of equal rows (k, class, score) and members (row_id, class): rows count by
    score, and only those of the score that the last of the m rows has are put in order."""
    hit = t.truth.withColumn("hit", F.lit(1))
    own = kept(members.join(hit, "row_id", "left").select("class", "row_id", F.coalesce("hit", F.lit(0)).alias("hit")))
    sizes = own.groupBy("class").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    levels = scores.join(sizes, "class").groupBy("k", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    levels = kept(levels.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy(F.desc_nulls_first("score")))))
    whole = levels.where(F.col("upto") <= t.m).select("k", F.col("n").alias("p"), F.col("hits").alias("tp"))
    last = levels.where((F.col("upto") > t.m) & (F.col("upto") - F.col("n") < t.m)).select(F.col("k").alias("of"), F.col("score").alias("edge"), (t.m - F.col("upto") + F.col("n")).alias("need"))
    tied = scores.join(last, (F.col("k") == F.col("of")) & F.col("score").eqNullSafe(F.col("edge"))).select("k", "class", "need").join(own, "class")
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("row_id")))
    part = tied.withColumn("place", place).where(F.col("place") <= F.col("need")).select("k", F.lit(1).cast("long").alias("p"), F.col("hit").cast("long").alias("tp"))
    return whole.union(part).groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"))


def roc(t: Task, clusters: DataFrame, multipliers: list[float]) -> DataFrame:
    """clusters (grid, row_id, cluster, x), one clustering -> (k, fpr, tpr) of the parametric purge for any number of multipliers: a row is
    flagged from its own multiplier on, so that counts of rows up to each multiplier are running sums."""
    own = rd.critical(kept(rd.measure(clusters, t.dims))).join(t.truth.withColumn("hit", F.lit(1)), "row_id", "left")
    rows = own.where("k IS NOT NULL").select("k", F.lit(1).alias("p"), F.coalesce("hit", F.lit(0)).alias("tp"), F.lit(False).alias("asked"))
    ks = t.points.sparkSession.createDataFrame([(float(k),) for k in multipliers], "k double").select("k", F.lit(0).alias("p"), F.lit(0).alias("tp"), F.lit(True).alias("asked"))
    found = running(rows.union(ks), "k", ["p", "tp"]).where("asked")
    n = found.select(F.col("k").alias("grid_order"), F.col("sum_tp").cast("double").alias("tp"), (F.col("sum_p") - F.col("sum_tp")).cast("double").alias("fp"), (t.m - F.col("sum_tp")).cast("double").alias("fn"), (t.n - t.m - F.col("sum_p") + F.col("sum_tp")).cast("double").alias("tn"))
    return rates(n, ["grid_order"]).select(F.col("grid_order").alias("k"), "fpr", "tpr")


#: Multipliers of the published curve, at the cut into THETA clusters.
CURVE, THETA = spread(0.1, 100, 3000), 5


def cpp_hac_roc(t: Task, multipliers: list[float] = CURVE, theta: int = THETA) -> DataFrame:
    return roc(t, tree(t, [theta]), multipliers)


SEARCHERS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (
    ocrd, kmeans_singletons, kmeans_mm, kmor, cblof_kmeans, cp_kmeans, cpp_kmeans, hac_singletons, cblof_hac, cp_hac, cpp_hac,
    dbscan_noise, cblof_dbscan, cp_dbscan, cpp_dbscan, lof, lps,
)}
KINDS = ("minmin", "minmax", "maxmin", "maxmax")
#: The same purge under every perturbation, for each way of clustering.
ABLATION: dict[str, Callable[..., DataFrame]] = {f"{name}_{kind}": partial(search, kind=kind) for name, search in (("kmeans", cp_kmeans), ("hac", cp_hac), ("dbscan", cp_dbscan)) for kind in KINDS}
EVALUATED = "dataset string, detector string, precision double, recall double, f_score double, mcc double, seconds double"
METRICS = ("precision", "recall", "f_score", "mcc")


def graded(datasets: dict[str, Task], searchers: dict[str, Callable[[Task], DataFrame]]) -> DataFrame:
    """(dataset, detector, grid_order, p1, p2, the metrics, seconds): every point of every grid in one table, seconds for each grid point.
    Points are scaled by their largest absolute value first; what several searches of a dataset need is computed once, for the first."""
    out = []
    for dataset, t in datasets.items():
        most = t.points.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))))).first()[0] or 1.0
        even = t._replace(points=kept(t.points.select("row_id", F.transform("x", lambda v: v / F.lit(most)).alias("x"))), shared={})
        for detector, search in searchers.items():
            began = time.time()
            found = kept(search(even).select(F.lit(dataset).alias("dataset"), F.lit(detector).alias("detector"), F.col("grid_order").cast("long").alias("grid_order"), "p1", "p2", *METRICS))
            out.append(found.withColumn("seconds", F.lit((time.time() - began) / max(1, found.count()))))
    return reduce(DataFrame.union, out)


def competition(datasets: dict[str, Task], searchers: dict[str, Callable[[Task], DataFrame]]) -> DataFrame:
    """(dataset, detector, precision, recall, f_score, mcc, seconds): each metric from its own best grid point, seconds for each grid point."""
    every = graded(datasets, searchers)
    return every.groupBy("dataset", "detector").agg(*[F.coalesce(F.max(m), F.lit(0.0)).alias(m) for m in METRICS], F.max("seconds").alias("seconds"))


def wide(evaluated: DataFrame, metric: str) -> DataFrame:
    """A row for each dataset with the metric of every detector."""
    return evaluated.groupBy("dataset").pivot("detector").agg(F.first(metric))


def report(evaluated: DataFrame) -> DataFrame:
    """Means over datasets, with two decimals: detector, precision, recall, f_score, mcc."""
    return evaluated.groupBy("detector").agg(*[F.round(F.avg(m), 2).alias(m) for m in ("precision", "recall", "f_score", "mcc")])
