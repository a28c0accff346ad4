"""Density clusters for every eps from one forest.

For a number of points ``least`` a row is a core from its core distance on, the distance to its (least - 1)-th neighbour; two cores are
joined from their mutual reachability on, the greatest of both core distances and their distance.  Boruvka's rounds build the minimum
spanning forest: in each round every component takes its least edge outwards, and components joined by such edges become one, so that
rounds grow with the logarithm of the rows.  What is kept of the forest is the tree of components, each with the weight of the edge that
it left by.  The greatest weight on the way between two rows in the spanning tree is the greatest on their way through this tree, so at
eps a row belongs to the component it reaches by edges of at most eps: a row has a few stretches of eps, one for each round at most.

Least edges come from neighbour lists where these can tell: a row that isn't listed is farther off than the last one that is.  Other rows
search, within the weight of an edge that their component knows already, by the blocks of ``blocks``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outrate.operators.blocks import NEED, Space, dealt, distances, gathered, need_array, pairs_of, plain, space
from outrate.operators.neighbors import knn_for
from outrate.operators.state import kept


def core_distances(points: DataFrame, near: DataFrame, leasts: list[int]) -> DataFrame:
    """(row_id, cores): for each of leasts the distance from which on a row is a core; near (a, b, d, rk)."""
    at = F.array(*[F.lit(0.0) if k <= 1 else F.coalesce(F.max(F.when(F.col("rk") == k - 1, F.col("d"))), F.lit(math.inf)) for k in leasts])
    some = near.groupBy(F.col("a").alias("row_id")).agg(at.alias("cores"))
    none = F.array(*[F.lit(0.0 if k <= 1 else math.inf) for k in leasts])
    return points.select("row_id").join(some, "row_id", "left").select("row_id", F.coalesce("cores", none).alias("cores"))


def _edge(a: str, b: str, w: str = "w") -> F.Column:
    """An edge's place in the one order that all components choose by."""
    return F.struct(F.col(w).alias("w"), F.least(a, b).alias("one"), F.greatest(a, b).alias("two"))


def _listed(near: DataFrame, state: DataFrame) -> DataFrame:
    """(l, a, comp, w, b, other) of listed neighbours in other components; state (l, row_id, comp, core)."""
    one = state.select("l", F.col("row_id").alias("a"), "comp", "core")
    two = state.select("l", F.col("row_id").alias("b"), F.col("comp").alias("other"), F.col("core").alias("core_b"))
    both = near.select("a", "b", "d").join(one, "a").join(two, ["l", "b"]).where("comp <> other")
    return both.select("l", "a", "comp", F.greatest("d", "core", "core_b").alias("w"), "b", "other").where(F.col("w") < math.inf)


def _searching(placed: DataFrame, state: DataFrame, known: DataFrame, last: DataFrame, s: Space, dims: int, n: int) -> DataFrame | None:
    """(l, comp, w, a, b, other): least edges of rows whose lists cannot tell, by component and pair of blocks; none: no row
    has to search.  placed: rows with their blocks; known (l, comp, w); last (row_id, last): the distance of the last listed neighbour."""
    rows = state.join(known, ["l", "comp"], "left").join(last, "row_id", "left").withColumn("w", F.coalesce("w", F.lit(math.inf)))
    # Beyond an edge of this weight, or of a weight under what the lists reach, a row has nothing to look for.
    idle = (F.greatest("core", F.coalesce("last", F.lit(0.0))) > F.col("w")) | (F.col("core") == math.inf)
    rows = kept(rows.withColumn("limit", F.when(idle, F.lit(-1.0)).otherwise(F.col("w"))))
    if rows.where("limit >= 0").isEmpty():
        return None
    arrays = F.sort_array(F.collect_list(F.struct("l", "comp", "core", "limit")))  # one for each of leasts
    packed = rows.groupBy("row_id").agg(arrays.alias("s")).select("row_id", F.col("s.comp").alias("comps"), F.col("s.core").alias("cores"), F.col("s.limit").alias("limits"))
    every = kept(placed.join(packed, "row_id"))
    held = {r.row_id: (r.comps, r.cores) for r in every.join(state.sparkSession.createDataFrame([(int(i),) for i in s.ids], "row_id long"), "row_id").select("row_id", "comps", "cores").collect()}  # the pivots
    at = np.array([i in held for i in s.ids.tolist()])
    comps_p, cores_p = (np.array([held[i][k] for i in s.ids[at].tolist()]).reshape(at.sum(), n) for k in (0, 1))
    pivots = s.pivots[at]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need, limits = [], []
            for i in range(batch.num_rows):
                x, cell = plain(batch["xs"], i).reshape(-1, dims), batch["cell"][i].as_py()
                comps, cores, limit = (np.array(batch[c][i].as_py()).reshape(len(x), n).copy() for c in ("comps", "cores", "limits"))
                d = distances(x, pivots)
                for k in range(n):  # an edge to a pivot of another component bounds too
                    w = np.maximum(np.maximum(d, cores[:, k, None]), cores_p[None, :, k])
                    w[comps[:, k, None] == comps_p[None, :, k]] = np.inf
                    least = w.min(axis=1) if w.shape[1] else np.full(len(x), np.inf)
                    for c in np.unique(comps[:, k]):
                        some = comps[:, k] == c
                        limit[some, k] = np.where(limit[some, k] < 0, -1.0, np.minimum(limit[some, k], least[some].min()))
                bound = limit.max(axis=1)
                rows = np.flatnonzero(bound >= 0)
                need.append(s.asked(x[rows], np.full(len(rows), cell), bound[rows]) if len(rows) else (np.zeros(0),) * 3)
                limits.append(limit.ravel())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("block", "cell", "ids", "xs")), pa.array(limits, pa.list_(pa.float64())), *(batch[c] for c in ("comps", "cores")), need_array(need)], names=["block", "cell", "ids", "xs", "limits", "comps", "cores", "need"])

    there = gathered(every, ("comps", "cores", "limits"))
    there = there.select("block", "cell", "low", "high", "ids", "xs", *[F.flatten(c).alias(c) for c in ("comps", "cores", "limits")])
    asking = kept(there.drop("low", "high").mapInArrow(ask, f"block long, cell long, ids array<long>, xs array<double>, limits array<double>, comps array<long>, cores array<double>, need {NEED}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for i in range(batch.num_rows):
                a, b = plain(batch["ids"], i), plain(batch["ids_b"], i)
                xa, xb = (plain(batch[c], i).reshape(-1, dims) for c in ("xs", "xs_b"))
                limit, comps, cores = (plain(batch[c], i).reshape(len(a), n) for c in ("limits", "comps", "cores"))
                comps_b, cores_b = (plain(batch[c], i).reshape(len(b), n) for c in ("comps_b", "cores_b"))
                rows = np.flatnonzero(limit.max(axis=1) >= 0)
                d = distances(xa[rows], xb)
                for k in range(n):
                    some = rows[limit[rows, k] >= 0]
                    if not len(some):
                        continue
                    w = np.maximum(np.maximum(d[limit[rows, k] >= 0], cores[some, k, None]), cores_b[None, :, k])
                    w[(comps[some, k, None] == comps_b[None, :, k]) | (w > limit[some, k, None])] = np.inf
                    best = w.min(axis=1)
                    p, q = np.nonzero((w == best[:, None]) & np.isfinite(w))
                    if len(p):
                        one, two = np.minimum(a[some][p], b[q]), np.maximum(a[some][p], b[q])
                        order = np.lexsort((two, one, best[p], comps[some, k][p]))
                        own = comps[some, k][p][order]
                        first = order[np.concatenate([[True], own[1:] != own[:-1]])]
                        out.append([np.full(len(first), k), comps[some, k][p[first]], best[p[first]], a[some][p[first]], b[q[first]], comps_b[q[first], k]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["l", "comp", "w", "a", "b", "other"])

    two = there.select(F.col("block").alias("other"), *[F.col(c).alias(f"{c}_b") for c in ("ids", "xs", "comps", "cores")])
    found = asking.drop("need").join(pairs_of(asking, there), "block").join(two, "other").drop("block", "other", "cell")
    return found.mapInArrow(compare, "l long, comp long, w double, a long, b long, other long")


def _roots(chosen: DataFrame) -> DataFrame:
    """chosen (l, comp, other), what each component joins -> (l, comp, root): ways end in two that chose each other; the smaller is the root."""
    back = chosen.select("l", F.col("comp").alias("other"), F.col("other").alias("back"))
    at = F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other"))
    now = kept(chosen.join(back, ["l", "other"]).select("l", "comp", at.alias("to")))
    while True:
        step = now.select("l", F.col("comp").alias("to"), F.col("to").alias("next"))
        new = kept(now.join(step, ["l", "to"]).select("l", "comp", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        now = new.select("l", "comp", "to")
        if new.where("moved").isEmpty():
            return now.select("l", "comp", F.col("to").alias("root"))


def forest(points: DataFrame, near: DataFrame, leasts: list[int], dims: int) -> DataFrame:
    """(least, row_id, level, node, since, until): row_id is a core of component node, numbered within its level, for eps from since on,
    before until.  near (a, b, d, rk): neighbour lists, to max(leasts) - 1 at least.  points and near should be written tables."""
    spark = points.sparkSession
    cores = core_distances(points, near, leasts)
    state = kept(cores.select("row_id", F.posexplode("cores").alias("l", "core")).select(F.col("l").cast("long").alias("l"), "row_id", F.col("row_id").alias("comp"), "core"))
    last = kept(near.groupBy(F.col("a").alias("row_id")).agg(F.max("d").alias("last")))
    s = space(points, points.count(), dims)
    placed = kept(dealt(points, s, dims))
    here = state.where(F.col("core") < math.inf).select("l", "row_id", "comp", F.col("core").alias("since"))
    stretches, level = [], 0
    while True:
        listed = kept(_listed(near, state))
        known = listed.groupBy("l", "comp").agg(F.min("w").alias("w"))
        searched = _searching(placed, state, known, last, s, dims, len(leasts))
        edges = listed.select("l", "comp", "w", "a", "b", "other")
        edges = edges if searched is None else edges.unionByName(searched)
        best = kept(edges.groupBy("l", "comp").agg(F.min_by(F.struct("w", "other"), _edge("a", "b")).alias("m")).select("l", "comp", "m.w", "m.other"))
        if best.isEmpty():
            stretches.append(here.select("l", "row_id", F.lit(level).alias("level"), F.col("comp").alias("node"), "since", F.lit(math.inf).alias("until")))
            break
        to = _roots(best.select("l", "comp", "other")).join(best.select("l", "comp", "w"), ["l", "comp"])
        here = kept(here.join(to, ["l", "comp"], "left").withColumn("w", F.coalesce("w", F.lit(math.inf))))
        stretches.append(here.where("since < w").select("l", "row_id", F.lit(level).alias("level"), F.col("comp").alias("node"), "since", F.col("w").alias("until")))
        here = here.select("l", "row_id", F.coalesce("root", "comp").alias("comp"), F.greatest("since", "w").alias("since")).where(F.col("since") < math.inf)
        state = kept(state.join(to.select("l", "comp", "root"), ["l", "comp"], "left").select("l", "row_id", F.coalesce("root", "comp").alias("comp"), "core"))
        level += 1
    out = reduce(DataFrame.union, stretches)
    names = spark.createDataFrame([(i, k) for i, k in enumerate(leasts)], "l long, least int")
    return kept(out.join(F.broadcast(names), "l").select("least", "row_id", "level", "node", "since", "until"))  # a row for each of leasts


#: Rows of a number of points are dealt out to so many parts where they meet its values of eps.
PARTS = 16


def _over(ranges: DataFrame, grid: DataFrame) -> DataFrame:
    """ranges (least, since, until, ...) for each point of the grid (grid, eps, least) with since <= eps < until."""
    dealt = ranges.withColumn("part", F.pmod(F.xxhash64(*ranges.columns), F.lit(PARTS)).cast("int"))
    each = grid.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(each, ["least", "part"]).where("since <= eps AND eps < until").drop("part", "since", "until", "eps")


def clusters(points: DataFrame, near: DataFrame, tree: DataFrame, grid: DataFrame) -> DataFrame:
    """(grid, row_id, cluster) for every row and point of the grid (grid, eps, least): the smallest core row_id reachable; border rows take
    the smallest such within eps, noise null.  A border row is nearer than its core distance to cores that its list names before."""
    held = kept(_over(tree, grid))
    label = held.groupBy("grid", "level", "node").agg(F.min("row_id").alias("cluster"))
    core = kept(held.join(label, ["grid", "level", "node"]).select("grid", "row_id", "cluster"))
    leasts = grid.select("least").distinct()
    own = tree.groupBy("least", "row_id").agg(F.min("since").alias("core"))
    one = points.select("row_id").crossJoin(F.broadcast(leasts)).join(own, ["least", "row_id"], "left")  # the numbers of points
    one = one.select("least", F.col("row_id").alias("a"), F.coalesce("core", F.lit(math.inf)).alias("until"))
    two = own.select("least", F.col("row_id").alias("b"), F.col("core").alias("core_b"))
    reach = near.select("a", "b", "d").join(one, "a").join(two, ["least", "b"])
    reach = reach.select("least", "a", "b", F.greatest("d", "core_b").alias("since"), "until").where("since < until")
    border = _over(reach, grid).select("grid", "a", "b").join(core.select("grid", F.col("row_id").alias("b"), "cluster"), ["grid", "b"])
    found = core.union(border.groupBy("grid", F.col("a").alias("row_id")).agg(F.min("cluster").alias("cluster")).select("grid", "row_id", "cluster"))
    every = points.select("row_id").crossJoin(grid.select("grid"))  # a row for each grid point, which is the result
    return every.join(found, ["grid", "row_id"], "left")


def nearest_where(rows: DataFrame, points: DataFrame, near: DataFrame, accepted: DataFrame, dims: int, want: int, same: bool = False) -> DataFrame:
    """(grid, a, b, d, mark, place): the first ``want`` neighbours of each row (grid, a, cluster, eps) that are accepted (grid, b, cluster,
    mark) at its point of the grid and within eps; same: only those of its own cluster.

    Lists of neighbours (near, ranked) are read from the front, each time twice as far, and only for rows that have not found enough."""
    n, most = points.count(), near.agg(F.max("rk")).first()[0] or 0
    open_, found, done, to = kept(rows.withColumn("hits", F.lit(0).cast("long"))), [], 0, 4
    while True:
        to = min(to, n - 1)
        if to > most:
            most = to
            ids = open_.select(F.col("a").alias("row_id")).distinct()
            near = kept(knn_for(points.join(ids, "row_id", "left_semi"), points, most, dims))
        some = open_.join(near.where(f"rk > {done} AND rk <= {to}").select("a", "b", "d"), "a").where("d <= eps")
        hits = some.join(accepted.withColumnRenamed("cluster", "other"), ["grid", "b"])
        found.append(kept((hits.where("cluster = other") if same else hits).select("grid", "a", "b", "d", "mark")))
        if to >= n - 1:
            break
        more = found[-1].groupBy("grid", "a").agg(F.count("*").alias("more"))
        last = near.where(F.col("rk") == to).select("a", F.col("d").alias("last"))
        rest = open_.join(more, ["grid", "a"], "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0))).drop("more")
        open_ = kept(rest.where(F.col("hits") < want).join(last, "a").where("last <= eps").drop("last"))
        if open_.isEmpty():
            break
        done, to = to, most if to < most else 4 * to
    place = F.row_number().over(Window.partitionBy("grid", "a").orderBy("d", "b"))
    return reduce(DataFrame.union, found).withColumn("place", place).where(F.col("place") <= want)


def represented(clusters: DataFrame, points: DataFrame, near: DataFrame, grid: DataFrame, dims: int) -> DataFrame:
    """clusters (grid, row_id, cluster) -> with rep (row_id of the nearest row of the same cluster within eps, else the row itself), d, and
    second, the distance to the second nearest of these, 0 without one; rows alone in their cluster need no search."""
    several = clusters.groupBy("grid", "cluster").agg(F.count("*").alias("f")).where("f > 1").select("grid", "cluster")
    own = kept(clusters.join(several, ["grid", "cluster"]).select("grid", F.col("row_id").alias("a"), "cluster"))
    rows = own.join(grid.select("grid", "eps"), "grid")
    accepted = own.select("grid", F.col("a").alias("b"), "cluster", F.lit(None).cast("double").alias("mark"))
    two = nearest_where(rows, points, near, accepted, dims, 2, same=True)
    at = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    two = two.groupBy("grid", F.col("a").alias("row_id")).agg(at(1, "b").alias("b1"), at(1, "d").alias("d1"), at(2, "d").alias("d2"))
    found = clusters.join(two, ["grid", "row_id"], "left")
    return found.select("grid", "row_id", "cluster", F.coalesce("b1", "row_id").alias("rep"), F.coalesce("d1", F.lit(0.0)).alias("d"), F.coalesce("d2", F.lit(0.0)).alias("second"))


#: Rows of a block at most, of one grid point, where rows of small clusters meet those of large ones.
BLOCK = 2048


def cblof_knn(clusters: DataFrame, points: DataFrame, near: DataFrame, dims: int, most: int | None = None) -> DataFrame:
    """clusters (grid, row_id, cluster, large) -> (grid, row_id, score): the factor of ``detectors.cblof_knn`` at every point of a grid.

    At each grid point rows of small clusters meet those of large ones by blocks, as lists of neighbours would be read to their ends where
    large clusters are small.  most: of each block only so many of the highest scores, and what is as high but for rounding."""
    rows = clusters.join(near.where("rk = 1").select(F.col("a").alias("row_id"), F.col("d").alias("d1")), "row_id")
    stats = rows.groupBy("grid", "cluster", "large").agg(F.count("*").alias("f"), F.avg("d1").alias("m"))
    stats = stats.withColumn("big", F.row_number().over(Window.partitionBy("grid").orderBy(F.desc("f"), "cluster")) <= F.col("large"))
    x = points.select("row_id", F.col("x").cast("array<double>").alias("x"))
    rows = rows.drop("large").join(stats.select("grid", "cluster", "f", "m", "big"), ["grid", "cluster"]).join(x, "row_id")
    parts = max(1, math.ceil(points.count() / BLOCK))
    part = F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int").alias("part")
    fields = ["row_id", "d1", "f", "m", "big"]
    packed = rows.groupBy("grid", part).agg(F.sort_array(F.collect_list(F.struct(*fields, "x"))).alias("r"))  # about BLOCK rows
    packed = packed.select("grid", "part", *[F.col(f"r.{c}").alias(c) for c in fields], F.flatten("r.x").alias("xs"))
    if parts > 1:  # a block, and after it those that it meets
        packed = kept(packed)
        own = packed.select(F.lit(-1).alias("other"), "*")
        met = packed.where(F.exists("big", lambda v: v)).withColumnRenamed("part", "other").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        packed = own.unionByName(met).repartition("grid", "part").sortWithinPartitions("grid", "part", "other")
    else:
        packed = packed.withColumn("other", F.lit(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for i in range(batch.num_rows):
                block = [plain(batch[c], i) for c in fields] + [plain(batch["xs"], i).astype(float).reshape(-1, dims)]
                key = (batch["grid"][i].as_py(), batch["part"][i].as_py())
                if batch["other"][i].as_py() < 0:
                    if found is not None:
                        yield found.scores(most)
                    found = _Factors(key, *block)
                    if parts == 1:
                        found.meet(*block)
                elif found is not None and found.key == key:
                    found.meet(*block)
        if found is not None:
            yield found.scores(most)

    return packed.mapInArrow(run, "grid long, row_id long, score double")


class _Factors:
    """The rows of a block at a grid point, and for those of small clusters the nearest row of a large one so far; ties: the smaller id."""

    def __init__(self, key: tuple[int, int], ids: np.ndarray, d1: np.ndarray, f: np.ndarray, m: np.ndarray, big: np.ndarray, x: np.ndarray) -> None:
        self.key, self.ids, self.big, self.f, self.x = key, ids, big.astype(bool), f, x
        self.inside = f * (d1 - m)
        self.small = np.flatnonzero(~self.big)
        self.d, self.b, self.m = np.full(len(self.small), np.inf), np.full(len(self.small), np.iinfo(np.int64).max), np.full(len(self.small), np.nan)

    def meet(self, ids: np.ndarray, d1: np.ndarray, f: np.ndarray, m: np.ndarray, big: np.ndarray, x: np.ndarray) -> None:
        at = np.flatnonzero(big.astype(bool))
        if not len(at) or not len(self.small):
            return
        d = distances(self.x[self.small], x[at])
        d[~np.isfinite(d)] = np.inf
        first = d.argmin(axis=1)  # rows stand in the order of their ids
        d, b = d[np.arange(len(d)), first], ids[at][first]
        nearer = (d < self.d) | (d == self.d) & (b < self.b)
        self.d, self.b, self.m = np.where(nearer, d, self.d), np.where(nearer, b, self.b), np.where(nearer, m[at][first], self.m)

    def scores(self, most: int | None) -> pa.RecordBatch:
        there = np.isfinite(self.d)
        score = self.inside.copy()
        score[self.small] = self.f[self.small] * (self.d - self.m)
        rows = np.concatenate([np.flatnonzero(self.big), self.small[there]])
        score = score[rows]
        if most is not None and len(rows) > most:
            high = np.where(np.isnan(score), np.inf, score)
            edge = np.partition(high, len(high) - most)[len(high) - most] if most else np.inf
            keep = high >= edge - 2e-9 - 1e-12 * abs(edge) if math.isfinite(edge) else high >= edge
            rows, score = rows[keep], score[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), self.key[0])), pa.array(self.ids[rows]), pa.array(score)], names=["grid", "row_id", "score"])
