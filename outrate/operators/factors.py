"""Local outlier factors for many k at once.

A row's k-distances, one for each k, are its sorted distances.  Blocks of rows that carry them meet once for the reachability sums and once
for the densities of neighbours: for each k, what of a block lies within a row's k-distance counts.  A pair of rows stands in one pair of
blocks, whatever the number of ks, and what leaves a task is a sum for each row and k.  Where all ks are small, lists of neighbours up to the
largest are enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrate.operators.blocks import distances, plain
from outrate.operators.detectors import equal_rows
from outrate.operators.neighbors import knn_with_ties
from outrate.operators.state import kept

#: ks that a block's rows carry at once, 8 bytes for each row; and the largest k up to which neighbours are listed.
TOGETHER, LISTED = 512, 64
#: Rows of a block, at most and at least, and ks that a product of matrices sums up at once.
MOST, LEAST, WIDE = 1024, 64, 32


def _dealt(rows: DataFrame, more: list[str]) -> DataFrame:
    """(ids, xs, and an array of each of more): rows by blocks, one for each core at least where there are enough.  A written table."""
    n = rows.count()
    size = max(LEAST, min(MOST, math.ceil(n / rows.sparkSession.sparkContext.defaultParallelism)))
    parts = max(1, math.ceil(n / size))
    part = F.pmod(F.xxhash64("row_id"), F.lit(parts)).alias("part")
    packed = rows.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("row_id", "x", *more))).alias("rows"))  # about MOST
    return kept(packed.repartition(parts, "part").select(F.col("rows.row_id").alias("ids"), F.flatten("rows.x").alias("xs"), *[F.col(f"rows.{c}").alias(c) for c in more]))


def _all_pairs(there: DataFrame, more: list[str]) -> DataFrame:
    """Every block (ids, xs, more) with every block (ids_b, xs_b, more_b), which the definition asks for: k may be all rows."""
    two = there.select(*[F.col(c).alias(f"{c}_b") for c in ("ids", "xs", *more)])
    return there.select("ids", "xs", *more).crossJoin(two)


def sorted_distances(there: DataFrame, dims: int) -> DataFrame:
    """(row_id, ds, cs): of each class of equal rows all distances to others, ascending, and how many rows are up to each; its own rows but one
    are at no distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, d, w = _met(batch, i, dims)
                keep = w > 0
                yield pa.RecordBatch.from_arrays([pa.array(a), *(pa.array([x[m] for x, m in zip(v, keep)], pa.list_(pa.float64())) for v in (d, w))], names=["row_id", "ds", "ws"])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], []]
            for i in range(batch.num_rows):
                d, w = (plain(batch[c], i) for c in ("ds", "ws"))
                order = np.argsort(d, kind="stable")
                out[0].append(d[order]), out[1].append(np.cumsum(w[order]))
            yield pa.RecordBatch.from_arrays([batch["row_id"], *(pa.array(v, pa.list_(pa.float64())) for v in out)], names=["row_id", "ds", "cs"])

    parts = _all_pairs(there, ["w"]).mapInArrow(run, "row_id long, ds array<double>, ws array<double>")
    whole = parts.groupBy("row_id").agg(F.collect_list(F.struct("ds", "ws")).alias("v")).select("row_id", F.flatten("v.ds").alias("ds"), F.flatten("v.ws").alias("ws"))
    return whole.mapInArrow(up, "row_id long, ds array<double>, cs array<double>")


def _met(batch: pa.RecordBatch, i: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, the distances to another block's classes, and how many rows these are for each, a row itself left out."""
    a, b = plain(batch["ids"], i), plain(batch["ids_b"], i)
    d = distances(*(plain(batch[c], i).reshape(-1, dims) for c in ("xs", "xs_b")))
    own = a[:, None] == b
    return a, d, plain(batch["w_b"], i) - own.astype(float)


def _summed(there: DataFrame, more: list[str], dims: int, reach: bool) -> DataFrame:
    """(row_id, counts, sums), arrays by k: neighbours within the k-distance (kd), and what they add: reach: the greater of the distance and
    their own k-distance; else their density (lrd).  Classes count as often as they have rows (w)."""

    def batch_of(a: np.ndarray | pa.Array, counts: np.ndarray | list, sums: np.ndarray | list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a) if isinstance(a, np.ndarray) else a, *(pa.array(list(v), pa.list_(pa.float64())) for v in (counts, sums))], names=["row_id", "counts", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # what a block has added up so far; it comes with one block after the other
        for batch in batches:
            for i in range(batch.num_rows):
                a, d, w = _met(batch, i, dims)
                kd = plain(batch["kd"], i).reshape(len(a), -1)
                other = plain(batch["kd_b" if reach else "lrd_b"], i).reshape(d.shape[1], -1)
                plainly = np.isfinite(kd).all() and (not reach or np.isfinite(other).all())
                counts, sums = (_from_ranks if plainly else _one_by_one)(d, w, kd, other, reach)
                if last is not None and np.array_equal(last[0], a):
                    last = (a, last[1] + counts, last[2] + sums)
                    continue
                if last is not None:
                    yield batch_of(*last)
                last = (a, counts, sums)
        if last is not None:
            yield batch_of(*last)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch["parts"].to_pylist()
            yield batch_of(batch["row_id"], *([plain(batch[c], i).reshape(n, -1).sum(axis=0) for i, n in enumerate(parts)] for c in ("counts", "sums")))

    schema = "row_id long, counts array<double>, sums array<double>"
    parts = _all_pairs(there, more).mapInArrow(run, schema).groupBy("row_id").agg(F.count("*").alias("parts"), F.flatten(F.collect_list("counts")).alias("counts"), F.flatten(F.collect_list("sums")).alias("sums"))
    return parts.mapInArrow(add, schema)


def _one_by_one(d: np.ndarray, w: np.ndarray, kd: np.ndarray, other: np.ndarray, reach: bool) -> tuple[np.ndarray, np.ndarray]:
    """counts and sums of ``_summed`` for two blocks, for one k after the other."""
    counts, sums = np.zeros(kd.shape), np.zeros(kd.shape)
    for k in range(kd.shape[1]):
        near = (d <= kd[:, k, None]) & (w > 0)
        times = np.where(near, w, 0.0)
        counts[:, k] = times.sum(axis=1)
        sums[:, k] = (times * np.where(near, np.maximum(d, other[None, :, k]) if reach else other[None, :, k], 0.0)).sum(axis=1)  # densities of equal rows are infinite
    return counts, sums


def _from_ranks(d: np.ndarray, w: np.ndarray, kd: np.ndarray, other: np.ndarray, reach: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same.  k-distances grow with k, so a pair counts from one k on, and from one k on its distance is not above the other's k-distance:
    what pairs add from there is a product of matrices, but for pairs that begin among the few ks that a product takes."""
    n, ks = kd.shape
    begin = np.stack([np.searchsorted(kd[i], d[i]) for i in range(n)])
    rows = np.broadcast_to(np.arange(n)[:, None], d.shape)
    held = begin < ks

    def upto(at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Sums of v over the pairs with at <= k, for each row and k."""
        some = at < ks
        return np.bincount(rows[some] * ks + at[some], v[some], n * ks).reshape(n, ks).cumsum(axis=1)

    counts, sums = upto(begin, w), np.zeros(kd.shape)
    if reach:
        start = np.maximum(begin, np.stack([np.searchsorted(other[j], d[:, j]) for j in range(d.shape[1])], axis=1))
        own = np.where(held, w * np.where(held, d, 0.0), 0.0)
        sums = upto(begin, own) - upto(start, own)
        begin = start
    endless = np.isinf(other)
    for part, add in ((np.where(endless, 0.0, other), False), (endless.astype(float), True)):
        if add and not endless.any():
            break
        found = np.zeros(kd.shape)
        for at in range(0, ks, WIDE):
            to = min(at + WIDE, ks)
            found[:, at:to] = np.where(begin <= at, w, 0.0) @ part[:, at:to]
            i, j = np.nonzero((begin > at) & (begin < to))
            order = np.argsort(begin[i, j], kind="stable")
            i, j = i[order], j[order]
            ends = np.searchsorted(begin[i, j], np.arange(at, to), side="right")
            for k in range(at + 1, to):
                p, q = i[: ends[k - at]], j[: ends[k - at]]
                found[:, k] += np.bincount(p, w[p, q] * part[q, k], n)
        sums = np.where(found > 0, np.inf, sums) if add else sums + found
    return counts, sums


def _flat(there: DataFrame, more: list[str]) -> DataFrame:
    return there.select("ids", "xs", "w", *[F.flatten(c).alias(c) for c in more])


def _lof_listed(points: DataFrame, ks: list[int], dims: int) -> DataFrame:
    """``lof_every`` from lists up to the largest of ks: as many rows as the ks together for each row, and ties."""
    listed = kept(knn_with_ties(points, max(ks), dims).select("a", "b", "d", "rk"))
    near = kept(listed.withColumn("k", F.explode(F.filter(F.array(*map(F.lit, sorted(set(ks)))), lambda k: k >= F.col("rk")))).drop("rk"))
    kd = near.groupBy("k", F.col("a").alias("b")).agg(F.max("d").alias("kd"))
    reached = near.join(kd, ["k", "b"]).groupBy("k", "a").agg(F.count("*").alias("n"), F.sum(F.greatest("d", "kd")).alias("r"))
    lrd = kept(reached.select("k", "a", F.when(F.col("r") > 0, F.col("n") / F.when(F.col("r") > 0, F.col("r"))).otherwise(float("inf")).alias("lrd")))
    means = near.join(lrd.select("k", F.col("a").alias("b"), F.col("lrd").alias("other")), ["k", "b"]).groupBy("k", "a").agg(F.avg("other").alias("m"))
    return means.join(lrd, ["k", "a"]).select("k", F.col("a").alias("row_id"), (F.col("m") / F.col("lrd")).alias("score"))


def lof_every(points: DataFrame, ks: list[int], dims: int) -> DataFrame:
    """(k, row_id, score): the local outlier factor for every one of ks; rows at the k-distance all count as neighbours."""
    points = kept(points.select(F.col("row_id").cast("long").alias("row_id"), F.col("x").cast("array<double>").alias("x")))
    if max(ks) <= LISTED:
        return _lof_listed(points, ks, dims)
    classes, members = equal_rows(points)
    found, as_ = lof_classes(classes, ks, dims)
    names = points.sparkSession.createDataFrame(sorted(as_.items()), "k long, as long")
    return names.join(found.withColumnRenamed("k", "as"), "as").join(members, "class").select(F.col("k").cast("int").alias("k"), "row_id", "score")


def lof_classes(classes: DataFrame, ks: list[int], dims: int) -> tuple[DataFrame, dict[int, int]]:
    """(k, class, score) for classes of equal rows (row_id, x, n), and for each of ks the k whose scores it has: k-distances change only where a
    class's k-th neighbour is of another class than the one before, so that ks between two such places are one."""
    rows = kept(classes.select(F.col("row_id").cast("long").alias("row_id"), F.col("x").cast("array<double>").alias("x"), F.col("n").cast("double").alias("w")))
    ds = kept(sorted_distances(_dealt(rows, ["w"]), dims))
    ends = np.array(sorted(int(r.c) for r in ds.select(F.explode("cs").alias("c")).distinct().collect()), np.int64)  # as many as ks at most
    as_ = {k: int(ends[min(np.searchsorted(ends, k), len(ends) - 1)]) for k in ks} if len(ends) else {}
    asked = sorted(set(as_.values()))
    out = classes.sparkSession.createDataFrame([], "k long, class long, score double")
    for at in range(0, len(asked), TOGETHER):
        some = np.array(asked[at : at + TOGETHER])

        def kth(batches: Iterator[pa.RecordBatch], some: np.ndarray = some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # Beyond the last neighbour every one counts.
                lists = [plain(batch["ds"], i)[np.minimum(np.searchsorted(c := plain(batch["cs"], i), some), len(c) - 1)] for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch["row_id"], pa.array(lists, pa.list_(pa.float64()))], names=["row_id", "kd"])

        here = kept(rows.join(ds.where(F.size("ds") > 0).mapInArrow(kth, "row_id long, kd array<double>"), "row_id"))
        reached = _summed(kept(_flat(_dealt(here, ["kd", "w"]), ["kd"])), ["kd", "w"], dims, True)
        lrd = F.zip_with("counts", "sums", lambda n, r: F.when(r > 0, n / F.when(r > 0, r)).otherwise(float("inf")))
        here = kept(here.join(reached.select("row_id", lrd.alias("lrd")), "row_id"))
        there = kept(_flat(_dealt(here, ["kd", "lrd", "w"]), ["kd", "lrd"]))
        found = _summed(there, ["kd", "lrd", "w"], dims, False).join(here.select("row_id", "lrd"), "row_id")
        score = F.zip_with(F.zip_with("sums", "counts", lambda r, n: r / n), "lrd", lambda m, r: m / r)
        each = found.select("row_id", F.posexplode(F.arrays_zip(F.lit(some.tolist()).alias("k"), score.alias("score"))).alias("i", "v"))
        out = out.union(each.select(F.col("v.k").cast("long"), "row_id", "v.score"))
    return kept(out), as_
