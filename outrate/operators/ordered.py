"""k-means with outlier removal as first published: rows are judged one after another, each by the limit that the rows before it left.

A row's limit is gamma times the mean distance of the rows that are inliers when its turn comes, those before it as this pass judged
them and those after it as the last pass did.  Whether a row is an inlier changes the limit of all later rows, but what it then adds to
their mean does not depend on the limit.  So a pass is found from its own result: guess who is an inlier, add up by running sums what each
row's limit would be, judge all rows by these limits, and repeat until nobody changes.  After t turns the first t rows are right at
least, so the end is the one result of the row-by-row scan; a few turns do where limits hardly move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrate.functions.vectors import dist, mean
from outrate.operators.prefix import ranged, summed
from outrate.operators.state import kept


def _pass(rows: DataFrame, gamma: float) -> DataFrame:
    """rows (range_, row_id, x, d, out, m), m being the distance to the center -> range_, row_id, x, d, out after a pass over all rows in
    order of row_id.  With the limit l: a row is out beyond l, or if it was out and is no nearer than before; what is out lies at l at most."""
    near = F.least("d", "m")
    rows = rows.withColumn("now", F.col("out"))
    total, n = rows.where("NOT out").agg(F.sum("d"), F.count("*")).first()
    while True:
        rows = rows.withColumns({"s": F.when(F.col("now"), 0.0).otherwise(near) - F.when(F.col("out"), 0.0).otherwise(F.col("d")), "c": F.col("out").cast("long") - F.col("now").cast("long")})
        sums = summed(rows, "row_id", ["s", "c"])
        count = n + F.col("sum_c") - F.col("c")
        limit = F.when(count > 0, gamma * (total + F.col("sum_s") - F.col("s")) / count).otherwise(float("inf"))
        found = sums.withColumn("l", limit).withColumn("new", (near > F.col("l")) | (F.col("out") & (F.col("m") >= F.col("d"))))
        found = kept(found.select("range_", "row_id", "x", "d", "out", "m", "l", "new", (F.col("new") != F.col("now")).alias("changed")))
        if found.where("changed").isEmpty():
            return found.select("range_", "row_id", "x", F.when(F.col("new"), F.least(near, "l")).otherwise(near).alias("d"), F.col("new").alias("out"))
        rows = found.select("range_", "row_id", "x", "d", "out", "m", F.col("new").alias("now"))


def kmor_in_order(points: DataFrame, init: DataFrame, dims: int, gamma: float, delta: float = 1e-6, rounds: int = 10) -> DataFrame:
    """points (row_id, x), each row_id once, and first centers (center, c) -> row_id, d of the rows that are out, d being what the scan
    leaves as their distance.  The first pass judges nobody, and after each pass all centers are set to the mean of all inliers, as
    published; so only it needs all centers.  Ends when the sum of distances changes by less than delta, or after rounds passes.  Without
    inliers there is no limit; an empty table gives an empty result."""
    centers = [list(r.c) for r in init.select("c").collect()]  # as many as the model has
    rows = ranged(points.select(F.col("row_id").cast("long").alias("row_id"), "x"), ["row_id"])
    first = reduce(lambda a, b: F.least(a, b), [dist(F.col("x"), F.array(*map(F.lit, c)), dims) for c in centers], F.lit(float("inf")))
    rows = kept(rows.withColumns({"d": first, "out": F.lit(False)}))
    was = rows.agg(F.sum("d")).first()[0] or 0.0
    if abs(was) < delta:
        rounds = 1
    for _ in range(rounds - 1):
        center = rows.where("NOT out").agg(mean(F.col("x"), dims).alias("c")).first().c
        if center[0] is None:
            break
        rows = _pass(kept(rows.withColumn("m", dist(F.col("x"), F.array(*map(F.lit, center)), dims))), gamma)
        now = rows.agg(F.sum("d")).first()[0]
        if abs(was - now) < delta:
            break
        was = now
    return rows.where("out").select("row_id", "d")
