"""Blocks of rows that lie close together, and which of them need to meet.

Some rows serve as pivots.  Each row goes to the cell of its nearest pivot, and a cell is dealt out to blocks of about ROWS rows by rings
of distance to the pivot; a ring that is too full, of equal rows say, is dealt out by a hash.  So no block grows with the data, however
many rows a cell holds.

A row with something to find within a bound asks for the rings that the triangle inequality leaves: of cell j those from d - bound to d +
bound, d being its distance to pivot j, and none if the plane half-way between its own pivot and pivot j is farther off than the bound.
Blocks ask for what their rows do.  Pairs of blocks come from an equi-join on the cell; a task compares two blocks, and within them only
rows that still may find something.  Where the bounds are no help (rows about as far from each other as from everything, in many
dimensions), which shows in how many pairs are asked for, all rows meet all in larger blocks, so that fewer copies of them move.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from outrate.operators.state import importable, kept

#: Rows of a block, and pivots and rings of a cell at most: what is sent to all tasks doesn't grow with the rows.
ROWS, PIVOTS, RINGS = 1024, 1024, 256
#: Blocks' worth of rows up to which all meet all at once.  Rows of the blocks that come to all others, the share of all pairs of blocks from
#: which on they do, and distances that stand at once.
WHOLE, COARSE, MOST, AT_ONCE = 4, 4096, 0.5, 1 << 20
#: Rows of a block at most that all others come to, how many such blocks there are before they are that large, and tasks in all at least.
LARGE, FEW, TASKS = 16384, 16, 128
#: Squares between which single precision is used at all, the part of a limit that its rounding may add to it, and what is too small for it.
FINE, FEW_MORE, TINY = 1e-18, 0.01, 1e-30
#: Bounds are widened by this share, so that rounding decides nothing.
SLACK = 1e-9


def matrix(x: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array<double> column."""
    return np.asarray(x.flatten(), np.float64).reshape(-1, dims)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(out)


class Space(NamedTuple):
    """The pivots: their rows and how far they are from each other."""

    ids: np.ndarray
    pivots: np.ndarray
    apart: np.ndarray

    def reach(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray, cells: slice | np.ndarray = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows and cells: whether a row may find something in the cell, and from and to which distance to its pivot."""
        d = distances(x, self.pivots[cells])
        wide = (bound * (1 + SLACK) + SLACK)[:, None]
        near = np.sqrt(((x - self.pivots[own]) ** 2).sum(axis=1))
        between = self.apart[own][:, cells]
        plane = np.divide(d**2 - near[:, None] ** 2, 2 * between, out=np.full_like(d, -np.inf), where=between > 0)
        # Squares lose digits: a plane's distance is good to a share of the squares it comes from.
        plane -= np.divide(d**2, between, out=np.zeros_like(d), where=between > 0) * SLACK
        return (plane <= wide) & np.isfinite(wide) | ~np.isfinite(wide), d - wide, d + wide

    def asked(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells in which some of the rows may find something, and the rings between which they may."""
        some, low, high = self.reach(x, own, bound)
        cells = np.flatnonzero(some.any(axis=0))
        return cells, np.where(some, low, np.inf).min(axis=0)[cells], np.where(some, high, -np.inf).max(axis=0)[cells]


def space(points: DataFrame, n: int, dims: int) -> Space:
    """Pivots drawn from points by a hash of their ids, about four for a block's rows."""
    k = min(PIVOTS, math.ceil(4 * n / ROWS)) if n > ROWS else 1
    rows = points.select("row_id", "x").orderBy(F.xxhash64("row_id"), "row_id").limit(k).collect()  # PIVOTS at most
    pivots = np.array([r.x for r in rows], np.float64).reshape(-1, dims)
    return Space(np.array([r.row_id for r in rows], np.int64), pivots, distances(pivots, pivots))


def placed(points: DataFrame, s: Space, dims: int) -> DataFrame:
    """points with cell, the number of the nearest pivot, and far, the distance to it."""
    names = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(s.pivots):
                d = distances(matrix(b["x"], dims), s.pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell])], names=[*names, "cell", "far"])

    return points.mapInArrow(run, StructType([*points.schema.fields, StructField("cell", LongType()), StructField("far", DoubleType())]))


def dealt(points: DataFrame, s: Space, dims: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, x, cell, far, block, and further columns): the block of each row.  A written table."""
    rows = kept(placed(points.select(F.col("row_id").cast("long").alias("row_id"), F.col("x").cast("array<double>").alias("x"), *more), s, dims))
    most = rows.groupBy("cell").agg(F.max("far").alias("most"))  # a row for each pivot
    ring = F.when(F.col("most") > 0, F.least(F.floor(RINGS * F.col("far") / F.col("most")), F.lit(RINGS - 1))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(most), "cell").withColumn("ring", ring).drop("most")
    w = Window.partitionBy("cell").orderBy("ring")  # RINGS at most
    counts = rows.groupBy("cell", "ring").agg(F.count("*").alias("n")).withColumn("part", F.floor((F.sum("n").over(w) - F.col("n")) / ROWS))
    parts = counts.withColumn("split", F.ceil(F.sum("n").over(Window.partitionBy("cell", "part")) / ROWS)).select("cell", "ring", "part", "split")
    rows = rows.join(F.broadcast(parts), ["cell", "ring"])  # PIVOTS x RINGS rows at most
    block = F.col("cell") * (1 << 42) + F.col("part") * (1 << 21) + F.pmod(F.xxhash64("row_id"), F.col("split"))
    return rows.select("row_id", "x", *more, "cell", "far", block.alias("block"))


def gathered(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(block, cell, low, high, ids, xs, and an array of each further column): low and high, between which distances to the pivot lie; xs,
    all coordinates one row after the other.  A written table."""
    grouped = rows.groupBy("block", "cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.sort_array(F.collect_list(F.struct("row_id", "x", *more))).alias("rows"))  # about ROWS
    return kept(grouped.select("block", "cell", "low", "high", F.col("rows.row_id").alias("ids"), F.flatten("rows.x").alias("xs"), *[F.col(f"rows.{c}").alias(c) for c in more]))


def blocks(points: DataFrame, s: Space, dims: int, more: tuple[str, ...] = ()) -> DataFrame:
    return gathered(dealt(points, s, dims, more), more)


def pairs_of(asking: DataFrame, others: DataFrame) -> DataFrame:
    """(block, other): asking (block, need) has in need the cells and rings that a block asks for."""
    want = asking.select("block", F.explode("need").alias("w")).select("block", "w.*")
    rings = others.select(F.col("block").alias("other"), F.col("cell").alias("at"), F.col("low").alias("ring_low"), F.col("high").alias("ring_high"))
    return want.join(rings, (F.col("cell") == F.col("at")) & (F.col("ring_low") <= F.col("high")) & (F.col("ring_high") >= F.col("low"))).select("block", "other")


NEED = "array<struct<cell: long, low: double, high: double>>"
NEED_TYPE = pa.list_(pa.struct([("cell", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]))


def need_array(asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    """What each of some blocks asks for, as a column."""
    return pa.array([[{"cell": c, "low": x, "high": y} for c, x, y in zip(*(v.tolist() for v in a))] for a in asked], NEED_TYPE)


def plain(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.slice(k, 1).flatten())


def search(points: DataFrame, others: DataFrame | None, dims: int, k: int | None, choose: Callable[[np.ndarray], np.ndarray], bound: float = math.inf, seen: Accumulator | None = None, ties: bool = False) -> DataFrame:
    """(a, b, d): of each row of points what ``choose`` takes of its distances to the others of a block, a mask, ordered by their ids, as long
    as they are within the bound; a row itself is left out.  others None: points themselves.

    With k the bound is found first, row by row: the distance to the k-th of the block that the row's own block has next to it.  seen
    counts the distances that were computed, those to pivots included.  Where all rows meet all, k, ties (whether all at the k-th distance
    count) and the bound say what ``choose`` does."""
    importable(points.sparkSession)
    own = points.select("row_id", "x")
    base = kept(own) if others is None else kept(others.select("row_id", "x"))
    n = base.count()
    if n <= WHOLE * ROWS:
        return _all(own, base, n, dims, k, ties, bound, seen)
    s = space(base, n, dims)
    there = blocks(base, s, dims)
    here = there if others is None else blocks(own, s, dims)
    if k is None:
        asking, found = _ask(here, s, dims, bound), None
    else:
        asking = _first(here, there, s, dims, k, choose, bound, seen, others is None)
        found = asking.select(F.explode(F.arrays_zip("a", "b", "d")).alias("f")).select("f.*")
    pairs = kept(pairs_of(asking, there))
    if pairs.count() > MOST * here.count() * there.count():
        return _all(own, base, n, dims, k, ties, bound, seen)
    if k is not None:
        pairs = pairs.join(asking.select("block", "home"), "block").where("home IS NULL OR home <> other").select("block", "other")
    one = asking.select("block", "cell", F.col("ids").alias("ids_a"), F.col("xs").alias("xs_a"), "bounds")
    two = there.select(F.col("block").alias("other"), F.col("cell").alias("at"), F.col("low").alias("ring_low"), F.col("high").alias("ring_high"), F.col("ids").alias("ids_b"), F.col("xs").alias("xs_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, bounds = (plain(batch[c], i) for c in ("ids_a", "ids_b", "bounds"))
                xa, xb = (plain(batch[c], i).reshape(-1, dims) for c in ("xs_a", "xs_b"))
                cell, at = batch["cell"][i].as_py(), batch["at"][i].as_py()
                some, low, high = (v[:, 0] for v in s.reach(xa, np.full(len(xa), cell), bounds, np.array([at])))
                rows = np.flatnonzero(some & (low <= batch["ring_high"][i].as_py()) & (high >= batch["ring_low"][i].as_py()))
                if seen is not None:
                    seen.add(len(rows) * len(b))
                yield from _taken(a[rows], b, distances(xa[rows], xb), bounds[rows], choose)

    more = one.join(pairs, "block").join(two, "other").drop("block", "other").mapInArrow(run, "a long, b long, d double")
    return more if found is None else found.union(more)


def _all(points: DataFrame, others: DataFrame, n: int, dims: int, k: int | None, ties: bool, bound: float, seen: Accumulator | None) -> DataFrame:
    """The same by blocks dealt out by a hash, each with each.

    A share of the others' blocks comes to a block of points one after the other, so that a task holds two blocks and what it has found.
    Products of matrices tell which pairs may count: they are good to a share of the squared lengths, and no pair within that share is
    left out.  Those that may are measured like all others."""
    m = points.count()
    size = min(LARGE, max(ROWS, math.ceil(m / FEW)))
    own, parts = max(1, math.ceil(m / size)), max(1, math.ceil(n / COARSE))
    shares = min(parts, math.ceil(TASKS / own))

    def packed(df: DataFrame, name: str, count: int) -> DataFrame:
        rows = df.select(F.pmod(F.xxhash64("row_id"), F.lit(count)).cast("int").alias(name), F.struct(F.col("row_id").cast("long").alias("row_id"), F.col("x").cast("array<double>").alias("x")).alias("r"))
        rows = rows.groupBy(name).agg(F.sort_array(F.collect_list("r")).alias("r"))  # about LARGE or COARSE rows
        return rows.select(name, F.col("r.row_id").alias("ids"), F.flatten("r.x").alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = plain(batch["ids"], i), plain(batch["xs"], i).astype(np.float64).reshape(-1, dims)
                if batch["other"][i].as_py() < 0:  # a block of points, before the others that it meets
                    if found is not None:
                        yield found.batch()
                    key, found = (batch["a"][i].as_py(), batch["s"][i].as_py()), Found(ids, x, k, ties, bound)
                elif key == (batch["a"][i].as_py(), batch["s"][i].as_py()):
                    found.meet(ids, x)
                    if seen is not None:
                        seen.add(len(found.ids) * len(ids))
        if found is not None:
            yield found.batch()

    every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    one = packed(points, "a", own).select("a", every(shares, "s"), F.lit(-1).alias("other"), "ids", "xs")
    two = packed(others, "other", parts).select(every(own, "a"), F.pmod("other", F.lit(shares)).alias("s"), "other", "ids", "xs")
    return one.union(two).repartition("a", "s").sortWithinPartitions("a", "s", "other").mapInArrow(run, "a long, b long, d double")


class Found:
    """What the rows of a block have found so far in the blocks that they met."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int | None, ties: bool, bound: float) -> None:
        self.ids, self.x, self.k, self.ties, self.bound = ids, x, k, ties, bound
        self.limit = np.full(len(ids), bound)
        self.rows, self.others, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        rows, others, d = [self.rows], [self.others], [self.d]
        step = max(1, AT_ONCE // len(ids))
        with np.errstate(invalid="ignore", over="ignore"):
            na, nb = (self.x**2).sum(axis=1), (x**2).sum(axis=1)
            longest = na.max() + nb.max()
            most = nb[np.isfinite(nb)].max(initial=0.0)
            sides = {}
            for at in range(0, len(self.ids), step):
                part = slice(at, at + step)
                limit = self.limit[part] ** 2
                kind = self.kind(longest, limit)
                share = 8 * (self.x.shape[1] + 8) * np.finfo(kind).eps
                if kind not in sides:
                    sides[kind] = np.vstack([-2 * x.T, np.ones(len(x)), (1 - share) * nb]).astype(kind)
                least = np.column_stack([self.x[part], (1 - share) * na[part], np.ones(len(na[part]))]).astype(kind) @ sides[kind]  # not above the squared distances
                if self.k is not None and len(ids) > self.k and np.isinf(limit).any():  # the row itself may be among the others
                    first = np.partition(least, self.k, axis=1)[:, self.k] + 2 * share * (na[part] + most)
                    limit = np.minimum(limit, np.where(np.isnan(first), np.inf, first))
                upto = np.nextafter((limit * (1 + SLACK) + TINY).astype(kind), kind(np.inf))  # never below the limit, in either precision
                i, j = np.divmod(np.flatnonzero(least <= upto[:, None]), len(ids))
                i += at
                keep = self.ids[i] != ids[j]
                i, j = i[keep], j[keep]
                exact = between(self.x, x, i, j)
                keep = np.isfinite(exact) & (exact <= self.limit[i])
                rows.append(i[keep]), others.append(ids[j[keep]]), d.append(exact[keep])
        self.rows, self.others, self.d = (np.concatenate(v) for v in (rows, others, d))
        if self.k is not None and sum(map(len, rows[1:])):
            self.cut()

    def kind(self, longest: float, limit: np.ndarray) -> type:
        """The precision of products: single, where its share of the squared lengths (longest: of two rows together) is a small part of the limits."""
        some = float(np.median(limit))
        return np.float32 if FINE < some < 1 / FINE and longest < 1 / FINE and 8 * (self.x.shape[1] + 8) * np.finfo(np.float32).eps * longest < FEW_MORE * some else np.float64

    def cut(self) -> None:
        """Of each row what the k nearest are, ties by the smaller id or all of them."""
        order = np.lexsort((self.others, self.d, self.rows))
        rows, d = self.rows[order], self.d[order]
        starts = np.searchsorted(rows, np.arange(len(self.ids) + 1))
        kth = starts[:-1] + self.k - 1
        full = kth < starts[1:]
        self.limit = np.where(full, np.minimum(self.bound, d[np.where(full, kth, 0)]), self.bound)
        keep = d <= self.limit[rows] if self.ties else np.arange(len(rows)) - starts[rows] < self.k
        self.rows, self.others, self.d = rows[keep], self.others[order][keep], d[keep]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.rows]), pa.array(self.others), pa.array(self.d)], names=["a", "b", "d"])


def between(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``distances`` of some pairs, by the same additions; AT_ONCE of them at a time."""
    out = np.zeros(len(i))
    for at in range(0, len(i), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        for c in range(a.shape[1]):
            out[part] += (a[i[part], c] - b[j[part], c]) ** 2
    return np.sqrt(out)


def _taken(a: np.ndarray, b: np.ndarray, d: np.ndarray, bounds: np.ndarray, choose: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    d[(a[:, None] == b) | (d > bounds[:, None])] = np.inf
    i, j = np.nonzero(choose(d) & np.isfinite(d)) if d.size else (np.zeros(0, np.int64),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(a[i]), pa.array(b[j]), pa.array(d[i, j])], names=["a", "b", "d"])


_ASKING = f"block long, cell long, home long, ids array<long>, xs array<double>, bounds array<double>, need {NEED}, a array<long>, b array<long>, d array<double>"


def _ask(here: DataFrame, s: Space, dims: int, bound: float) -> DataFrame:
    """Blocks with what they ask for within one bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need, bounds = [], []
            for i in range(batch.num_rows):
                x = plain(batch["xs"], i).reshape(-1, dims)
                bounds.append(np.full(len(x), bound))
                need.append(s.asked(x, np.full(len(x), batch["cell"][i].as_py()), bounds[-1]))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["cell"], batch["ids"], batch["xs"], pa.array(bounds, pa.list_(pa.float64())), need_array(need)], names=["block", "cell", "ids", "xs", "bounds", "need"])

    return kept(here.select("block", "cell", "ids", "xs").mapInArrow(run, f"block long, cell long, ids array<long>, xs array<double>, bounds array<double>, need {NEED}"))


def _first(here: DataFrame, there: DataFrame, s: Space, dims: int, k: int, choose: Callable[[np.ndarray], np.ndarray], bound: float, seen: Accumulator | None, same: bool) -> DataFrame:
    """Blocks with what their rows find in one block of the same cell, the one whose ring is nearest, and what they ask for beyond it."""
    if same:
        both = there.select("block", "cell", F.col("block").alias("home"), "ids", "xs", F.col("ids").alias("ids_b"), F.col("xs").alias("xs_b"))
    else:
        ring = there.select("cell", F.col("block").alias("home"), ((F.col("low") + F.col("high")) / 2).alias("mid"))
        off = F.abs((F.col("low") + F.col("high")) / 2 - F.col("mid"))
        home = here.select("block", "cell", "low", "high").join(ring, "cell").groupBy("block").agg(F.min_by("home", F.struct(off, "home")).alias("home"))
        other = there.select(F.col("block").alias("home"), F.col("ids").alias("ids_b"), F.col("xs").alias("xs_b"))
        both = here.join(home, "block", "left").join(other, "home", "left").select("block", "cell", "home", "ids", "xs", "ids_b", "xs_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                a, b = plain(batch["ids"], i), plain(batch["ids_b"], i)
                xa, xb = (plain(batch[c], i).astype(np.float64).reshape(-1, dims) for c in ("xs", "xs_b"))
                d = distances(xa, xb)
                d[a[:, None] == b] = np.inf
                kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(a), np.inf)
                bounds = np.minimum(kth, bound)
                if seen is not None:
                    seen.add(d.size + len(a) * len(s.pivots))
                (got,) = _taken(a, b, d, bounds, choose)
                for o, v in zip(out, (bounds, s.asked(xa, np.full(len(a), batch["cell"][i].as_py()), bounds), *got.columns)):
                    o.append(v)
            arrays = [pa.array(out[0], pa.list_(pa.float64())), need_array(out[1]), *(pa.array([v.to_numpy() for v in o], pa.list_(t)) for o, t in zip(out[2:], (pa.int64(), pa.int64(), pa.float64())))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("block", "cell", "home", "ids", "xs")), *arrays], names=["block", "cell", "home", "ids", "xs", "bounds", "need", "a", "b", "d"])

    return kept(both.mapInArrow(run, _ASKING))
