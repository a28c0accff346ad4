"""All cuts of a tree of merges at once, without a label for each row and cut.

Between two merges of its cluster nothing changes for a row, so a row is measured once for each cluster it is ever in: as many times as
the tree is deep.  Equal rows, which merge first, are one with a weight.  What all cuts share, totals and the cluster that a perturbation
picks, follows from the clusters' spans; rows beyond each cut's limits are counted by ``spans``.
"""

from __future__ import annotations

import sys
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outrate.functions.vectors import Distortion, change_of_entropy, xlog2x
from outrate.operators.prefix import running
from outrate.operators.spans import counted, foremost
from outrate.operators.state import kept


class Growth(NamedTuple):
    """clusters (node, name, f, distortion, lo, hi, rep) of several different rows, node being the merge that makes them and [lo, hi) the numbers of
    merges that they are there for; members (node, row_id, x, w, hits, d), equal rows by their first with how many they are;
    and classes (row_id, w, hits, lo, hi), equal rows before their first merge with others."""

    clusters: DataFrame
    members: DataFrame
    classes: DataFrame


def growth(points: DataFrame, truth: DataFrame, merges: DataFrame, n: int, dims: int, distortion: Distortion) -> Growth:
    """points (row_id, x), truth (row_id), merges (step, a, b, d) of ``linkage``."""
    hit = truth.select("row_id", F.lit(1).alias("hit"))
    classes = points.join(hit, "row_id", "left").groupBy("x").agg(F.min("row_id").alias("row_id"), F.count("*").alias("w"), F.count("hit").alias("hits"))
    classes = kept(classes)
    equal = n - classes.count()  # the first merges
    made = kept(merges.select(F.col("step").cast("long").alias("step"), "a", "b").where(F.col("step") > equal))
    up = made.select(F.col("b").alias("name"), F.col("a").alias("into"), "step")
    here = kept(classes.select("row_id", F.col("row_id").alias("name"), F.lit(0).cast("long").alias("since")).join(up, "name", "left"))
    ways = []
    while not here.isEmpty():
        ways.append(here)
        here = here.where("step IS NOT NULL").select("row_id", F.col("into").alias("name"), F.col("step").alias("since"))
        here = kept(here.join(up, "name", "left"))
    ends = made.select(F.explode(F.array("a", "b")).alias("name"), "step")
    until = F.coalesce(F.lead("step").over(Window.partitionBy("name").orderBy("step")), F.lit(n))
    nodes = made.select(F.col("step").alias("node"), F.col("a").alias("name")).join(ends.select("name", F.col("step").alias("node"), until.alias("hi")), ["name", "node"])
    every = reduce(DataFrame.unionByName, ways)
    inside = every.join(nodes, "name").where((F.col("node") >= F.col("since")) & (F.col("step").isNull() | (F.col("node") < F.col("step"))))
    inside = kept(inside.select("node", "name", "hi", "row_id").join(classes, "row_id"))
    center = F.array(*[F.sum(F.col("w") * F.col("x")[i]) / F.sum("w") for i in range(dims)])
    means = kept(inside.groupBy("node", "name", "hi").agg(F.sum("w").alias("f"), center.alias("rep")))
    members = kept(inside.drop("name", "hi").join(means.select("node", "rep"), "node").withColumn("d", distortion(F.col("x"), F.col("rep"), dims)).drop("rep"))
    clusters = means.join(members.groupBy("node").agg(F.sum(F.col("w") * F.col("d")).alias("distortion")), "node").withColumn("lo", F.col("node"))
    first = ends.groupBy(F.col("name").alias("row_id")).agg(F.min("step").alias("hi"))
    leaves = classes.drop("x").join(first, "row_id", "left").withColumn("hi", F.coalesce("hi", F.lit(n))).withColumn("lo", F.lit(0).cast("long"))
    return Growth(kept(clusters), members, kept(leaves))


def totals(g: Growth, steps: DataFrame) -> DataFrame:
    """(step, total): the distortion of all rows after each number of merges."""
    change = g.clusters.select(F.col("lo").alias("step"), F.col("distortion").alias("total")).union(g.clusters.select("hi", -F.col("distortion")))
    rows = change.withColumn("asked", F.lit(False)).union(steps.select("step", F.lit(0.0), F.lit(True)))
    return kept(running(rows, "step", ["total"]).where("asked").select("step", F.col("sum_total").alias("total")))


def _spans(g: Growth, n: int, slack: float) -> DataFrame:
    """(lo, hi, v, p, tp): v, how often a row's cluster's change of entropy goes into its distance and the slack; without limit, where there is none."""
    change = change_of_entropy(F.col("f"), F.lit(n))
    v = F.when(change > 0, (F.col("d") + slack) / change).otherwise(sys.float_info.max)
    some = g.members.join(g.clusters.select("node", "f", "lo", "hi"), "node").select("lo", "hi", v.alias("v"), F.col("w").alias("p"), F.col("hits").alias("tp"))
    # Before they are all together equal rows are as far from their mean as after: not at all.
    leaves = g.classes.withColumns({"f": F.col("w"), "d": F.lit(0.0)}).select("lo", "hi", v.alias("v"), F.col("w").alias("p"), F.col("hits").alias("tp"))
    return kept(some.union(leaves))


def flagged(g: Growth, steps: DataFrame, n: int, ks: list[float]) -> DataFrame:
    """(step, k, p, tp): rows beyond change of entropy / ks[k] * total distortion."""
    return counted(_spans(g, n, 0.0), totals(g, steps).select("step", F.col("total").alias("base")), ks)


def purged(g: Growth, n: int, kind: str, dims: int, distortion: Distortion) -> DataFrame:
    """(step, p, tp): rows that ``ratedistortion.purge_perturbed`` finds at each cut; see there, and ``perturb`` for kinds and ties."""
    far = F.round("d", 9)
    row = F.struct("row_id", "x", "d")
    pick = F.max_by(row, F.struct(far, -F.col("row_id"))) if kind[3:] == "max" else F.min_by(row, F.struct(far, "row_id"))
    moved = kept(g.members.groupBy("node").agg(pick.alias("m")).join(g.clusters.select("node", "f", "rep", "distortion"), "node"))
    rest = F.array(*[(F.col("f") * F.col("rep")[i] - F.col("m.x")[i]) / (F.col("f") - 1) for i in range(dims)])
    again = g.members.join(moved.select("node", F.col("m.row_id").alias("moved"), rest.alias("mean2")), "node")
    times = F.col("w") - F.when(F.col("row_id") == F.col("moved"), 1).otherwise(0)
    new = again.groupBy("node").agg(F.sum(times * distortion(F.col("x"), F.col("mean2"), dims)).alias("new"))
    less = moved.join(new, "node").select("node", (F.col("distortion") - F.col("new")).alias("less"))
    # Equal rows have nothing to lose; before they are all together, all clusters' rows are equal.
    names = g.clusters.join(less, "node").select("lo", "hi", "f", "name", "less").union(g.classes.select("lo", "hi", F.col("w"), "row_id", F.lit(0.0)))
    key = F.struct(-F.col("f"), "name") if kind[:3] == "max" else F.struct("f", "name")
    steps = g.clusters.select(F.col("lo").alias("step"))  # each of these merges is a step
    picked = foremost(kept(names if kind[:3] == "max" else names.where("f > 1")), steps, key, F.struct("f", "less"), n.bit_length())
    f = F.col("m.f")
    limits = picked.where("m.less > 0").select("step", (F.col("m.less") / ((xlog2x(f) - xlog2x(f - 1)) / n)).alias("base"))
    # A row is beyond its radius if that holds when its distance is rounded up by half of the last decimal.
    return counted(_spans(g, n, 5e-10), kept(limits), None).drop("k")
