"""Density clusters over a whole grid of eps as spans of the grid, without a label for each row and grid point.

Points of the grid are numbered by number of points and eps.  A row keeps its label, the smallest core that it reaches, over a span of the
grid, and changes it as often as a smaller core joins.  Its nearest rows of the same cluster follow from its neighbours' spans.  Sizes and
totals are running sums of spans' ends, and rows beyond a limit are counted by ``spans``, by cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outrate.functions.vectors import change_of_entropy, xlog2x
from outrate.operators.neighbors import knn_for
from outrate.operators.prefix import running
from outrate.operators.spans import counted, foremost, parted
from outrate.operators.state import kept


def _placed(values: DataFrame, grid: DataFrame) -> DataFrame:
    """(least, v, at) of values (least, v): the first point of the grid (grid, eps, least) with that number of points and eps >= v; without one,
    what comes after the last."""
    key = lambda v, after: F.struct("least", F.col(v).alias("v"), F.lit(after).alias("after"))
    both = values.distinct().select(key("v", 0).alias("key"), F.lit(0).alias("n")).union(grid.select(key("eps", 1), F.lit(1)))
    return running(both, "key", ["n"]).where("key.after = 0").select("key.least", "key.v", F.col("sum_n").alias("at"))


def _held(tree: DataFrame, at: DataFrame) -> DataFrame:
    lo, hi = (at.select("least", F.col("v").alias(c), F.col("at").alias(k)) for c, k in (("since", "lo"), ("until", "hi")))
    return kept(tree.join(lo, ["least", "since"]).join(hi, ["least", "until"]).where("lo < hi").select("least", "level", "node", "row_id", "lo", "hi"))


def cores(tree: DataFrame, grid: DataFrame) -> DataFrame:
    """(least, level, node, row_id, lo, hi): from which point of the grid to which a row is a core of a component of ``density.forest``."""
    values = _union([tree.select("least", F.col(c).alias("v")) for c in ("since", "until")])
    return _held(tree, kept(_placed(values, grid)))


def _cut(lo: str, hi: str, since: str, until: str) -> tuple:
    return F.greatest(lo, since).alias("lo"), F.least(hi, until).alias("hi")


def members(near: DataFrame, tree: DataFrame, grid: DataFrame) -> DataFrame:
    """(least, row_id, label, lo, hi): the spans of the grid for which a row has a label, as ``density.clusters`` gives them; noise has none."""
    own = tree.groupBy("least", "row_id").agg(F.min("since").alias("core"))
    one = grid.select("least").distinct().crossJoin(near.select("a").distinct()).join(own.withColumnRenamed("row_id", "a"), ["least", "a"], "left")  # the numbers of points
    one = one.select("least", "a", F.coalesce("core", F.lit(math.inf)).alias("until"))
    reach = near.select("a", "b", "d").join(one, "a").join(own.select("least", F.col("row_id").alias("b"), F.col("core").alias("core_b")), ["least", "b"])
    reach = kept(reach.select("least", "a", "b", F.greatest("d", "core_b").alias("since"), "until").where("since < until"))
    values = _union([df.select("least", F.col(c).alias("v")) for df in (tree, reach) for c in ("since", "until")])
    at = kept(_placed(values, grid))
    lo, hi = (at.select("least", F.col("v").alias(c), F.col("at").alias(k)) for c, k in (("since", "lo"), ("until", "hi")))
    held = _held(tree, at)
    # A component's label from each of the places where rows join that are smaller than all before.
    joins = held.groupBy("least", "level", "node", "lo", "hi").agg(F.min("row_id").alias("least_row"))
    by = Window.partitionBy("least", "level", "node").orderBy("lo")
    joins = joins.withColumn("label", F.min("least_row").over(by)).where("label = least_row")
    labels = joins.select("least", "level", "node", "label", F.col("lo").alias("start"), F.coalesce(F.lead("lo").over(by), F.col("hi")).alias("stop"))
    core = held.join(labels, ["least", "level", "node"]).select("least", "row_id", "label", *_cut("lo", "hi", "start", "stop")).where("lo < hi")
    core = kept(core)
    border = reach.join(lo, ["least", "since"]).join(hi, ["least", "until"]).where("lo < hi").select("least", "a", "b", "lo", "hi")
    reached = core.select("least", F.col("row_id").alias("b"), "label", F.col("lo").alias("start"), F.col("hi").alias("stop"))
    border = kept(border.join(reached, ["least", "b"]).select("least", F.col("a").alias("row_id"), "label", *_cut("lo", "hi", "start", "stop")).where("lo < hi"))
    parts = parted(border, "least", "row_id").join(border, ["least", "row_id"]).where("lo <= start AND stop <= hi")
    return kept(core.union(parts.groupBy("least", "row_id", "start", "stop").agg(F.min("label").alias("label")).select("least", "row_id", "label", F.col("start").alias("lo"), F.col("stop").alias("hi"))))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def represented(points: DataFrame, near: DataFrame, held: DataFrame, grid: DataFrame, dims: int) -> DataFrame:
    """(row_id, label, lo, hi, rep, d, second) of held, ``members``: see ``density.represented``.  Lists of neighbours (near, ranked) are made four
    times as long for rows that don't find two of their cluster in them, until they do or what is left is beyond eps."""
    n, most = points.count(), near.agg(F.max("rk")).first()[0] or 0
    open_, found = held, []
    while True:
        last = near.groupBy("a").agg(F.max("d").alias("last"))
        least = grid.select("least").distinct()
        values = near.select(F.col("d").alias("v")).distinct().crossJoin(F.broadcast(least)).select("least", "v")  # the numbers of points
        at = kept(_placed(values, grid))
        one = open_.select("least", F.col("row_id").alias("a"), "label", "lo", "hi")
        two = held.select("least", F.col("row_id").alias("b"), "label", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        met = one.join(near.select("a", "b", "d"), "a").join(two, ["least", "b", "label"]).join(at.withColumnRenamed("v", "d"), ["least", "d"])
        met = met.select("least", "a", "label", F.col("lo").alias("first"), F.greatest("lo", "lo_b", "at").alias("lo"), F.least("hi", "hi_b").alias("hi"), "d", "b").where("lo < hi")
        met = kept(met)
        of = ["least", "a", "label", "first"]
        whole = one.select("least", "a", "label", F.col("lo").alias("first"), "lo", "hi")
        pieces = parted(whole.union(met.select(*of, "lo", "hi")), *of).withColumnRenamed("start", "s")
        hits = pieces.join(met, of).where("lo <= s AND stop <= hi").groupBy(*of, "s", "stop").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b"))), 1, 2).alias("m"))
        two_of = pieces.join(hits, [*of, "s", "stop"], "left").join(last, "a").join(at.select("least", F.col("v").alias("last"), "at"), ["least", "last"])
        short = (F.coalesce(F.size("m"), F.lit(0)) < 2) & (F.col("at") < F.col("stop")) & F.lit(most < n - 1)
        all_ = kept(two_of.select(*of, "s", "stop", "m", short.alias("short")))
        again = kept(all_.where("short").select("least", F.col("a").alias("row_id")).distinct())
        found.append(all_.join(again.withColumnRenamed("row_id", "a"), ["least", "a"], "left_anti"))
        if again.isEmpty():
            break
        open_, most = kept(open_.join(again, ["least", "row_id"], "left_semi")), min(4 * most, n - 1)
        near = kept(knn_for(points.join(again.select("row_id").distinct(), "row_id", "left_semi"), points, most, dims))
    every = _union(found)
    m = lambda k: F.when(F.size("m") > k, F.col("m")[k])
    return kept(every.select(F.col("a").alias("row_id"), "label", F.col("s").alias("lo"), F.col("stop").alias("hi"), F.coalesce(m(0)["b"], F.col("a")).alias("rep"), F.coalesce(m(0)["d"], F.lit(0.0)).alias("d"), F.coalesce(m(1)["d"], F.lit(0.0)).alias("second")))


def _both(spans: DataFrame, **columns) -> DataFrame:
    """Spans' ends: what is there from lo on is gone from hi on."""
    return spans.select("name", F.col("lo").alias("step"), *[c.alias(k) for k, c in columns.items()]).union(spans.select("name", "hi", *[-c for c in columns.values()]))


def sizes(spans: DataFrame) -> DataFrame:
    """(name, lo, hi, f, hits): how many rows, of spans (row_id, name, lo, hi, hit), a cluster of several has, from when to when."""
    ends = _both(spans, f=F.lit(1), hits=F.col("hit")).groupBy("name", "step").agg(F.sum("f").alias("f"), F.sum("hits").alias("hits"))
    # A name's ends add up to nothing, so that sums over all names before it are its own.
    held = running(ends.withColumn("key", F.struct("name", "step")), "key", ["f", "hits"])
    hi = F.lead("step").over(Window.partitionBy("name").orderBy("step"))
    return kept(held.select("name", F.col("step").alias("lo"), hi.alias("hi"), F.col("sum_f").alias("f"), F.col("sum_hits").alias("hits")).where("f > 1 AND hi IS NOT NULL"))


def totals(spans: DataFrame, grid: DataFrame) -> DataFrame:
    """(step, total): all rows' distances at each point of the grid; as decimals, so that what is added and taken away leaves nothing."""
    most = spans.agg(F.max("d")).first()[0] or 1.0
    part = (F.col("d") / F.lit(most)).cast("decimal(30,24)")
    rows = _both(spans, total=part).drop("name").withColumn("asked", F.lit(False)).union(grid.select("grid", F.lit(0).cast("decimal(30,24)"), F.lit(True)))
    return kept(running(rows, "step", ["total"]).where("asked").select("step", (F.col("sum_total").cast("double") * F.lit(most)).alias("total")))


class Dense:
    """What counts over the grid need: spans (row_id, name, lo, hi, rep, d, second, hit), sizes, totals and each point's clusters."""

    def __init__(self, spans: DataFrame, truth: DataFrame, grid: DataFrame, n: int, m: int):
        hit = truth.select("row_id", F.lit(1).alias("hit"))
        self.spans = kept(spans.withColumnRenamed("label", "name").join(hit, "row_id", "left").fillna(0, ["hit"]))
        self.n, self.m, self.grid = n, m, grid
        self.sizes, self.totals = sizes(self.spans), totals(self.spans, grid)
        each = self.sizes.select("name", "f", "hits", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("step"))
        self.each = kept(each.join(self.totals, "step"))  # a row for each cluster and point of the grid
        several = self.each.groupBy(F.col("step").alias("grid")).agg(F.sum("f").alias("f"), F.sum("hits").alias("hits"))
        rest = lambda c, most: (F.lit(most) - F.coalesce(c, F.lit(0))).alias(c + "_alone")
        self.alone = kept(grid.join(several, "grid", "left").select(F.col("grid").alias("step"), rest("f", n), rest("hits", m)))

    def _counted(self, slack: float, limits: DataFrame, steps: DataFrame, ks: list[float]) -> DataFrame:
        """(step, k, p, tp): rows with d + slack >= base / ks[k] of their cluster (step, name, base), and rows that are alone, of steps (step)."""
        spans = kept(self.spans.select("lo", "hi", (F.col("d") + slack).alias("v"), "name", F.lit(1).cast("long").alias("p"), F.col("hit").cast("long").alias("tp")))
        found = counted(spans, kept(limits), ks)
        every = self.alone.join(steps, "step").select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in range(len(ks))])).alias("k"))
        return every.join(found, ["step", "k"], "left").select("step", "k", (F.coalesce("p", F.lit(0)) + F.col("f_alone")).alias("p"), (F.coalesce("tp", F.lit(0)) + F.col("hits_alone")).alias("tp"))

    def flagged(self, ks: list[float]) -> DataFrame:
        """(step, k, p, tp): rows beyond change of entropy / ks[k] * total distortion."""
        limits = self.each.select("step", "name", (change_of_entropy(F.col("f"), F.lit(self.n)) * F.col("total")).alias("base"))
        return self._counted(0.0, limits, self.alone.select("step"), ks)

    def purged(self, kind: str) -> DataFrame:
        """(step, p, tp): what ``detectors.purge_density`` finds at each point of the grid; see ``ratedistortion.perturb`` for kinds and ties."""
        bits, far = (self.grid.count() + 1).bit_length(), F.round("d", 9)
        key = F.struct(-F.col("f"), "name") if kind[:3] == "max" else F.struct("f", "name")
        steps = self.grid.select(F.col("grid").alias("step"))
        picked = kept(foremost(self.sizes, steps, key, F.struct("name", "f"), bits).select("step", "m.name", "m.f"))
        of = self.spans.join(picked.select("name").distinct(), "name")
        first = foremost(of, picked, F.struct(-far if kind[3:] == "max" else far, "row_id"), F.struct("row_id", "d"), bits, "name").select("step", F.col("m.row_id").alias("moved"), F.col("m.d").alias("d"))
        first = kept(first.join(picked, "step"))
        by = self.spans.where("rep <> row_id").select(F.col("rep").alias("moved"), "lo", "hi", (F.col("second") - F.col("d")).alias("change"))
        lost = first.join(by, "moved").where("lo <= step AND step < hi").groupBy("step").agg(F.sum("change").alias("change"))
        f, less = F.col("f"), F.col("d") - F.coalesce("change", F.lit(0.0))
        edges = first.join(lost, "step", "left").withColumn("less", less).where("less > 0").select("step", (F.col("less") / ((xlog2x(f) - xlog2x(f - 1)) / self.n)).alias("inverse"))
        edges = kept(edges)
        limits = self.each.join(edges, "step").select("step", "name", (change_of_entropy(F.col("f"), F.lit(self.n)) * F.col("inverse")).alias("base"))
        return self._counted(5e-10, limits, edges.select("step"), [1.0]).drop("k")
