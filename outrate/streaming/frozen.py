"""Parametric purging of rows as they come, against boundaries of a clustering that stands.

The clustering's centers, radii and multipliers are a static table.  A streamed row goes to its nearest center and is flagged where it lies
at its radius or beyond; nothing is kept between batches, so that late rows, restarts and lost executors need no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outrate.functions.vectors import change_of_entropy, mean
from outrate.operators import ratedistortion as rd
from outrate.operators.neighbors import nearest


def boundaries(clusters: DataFrame, dims: int, ks: list[float]) -> DataFrame:
    """(center, c, k, radius) of a clustering (row_id, cluster, x): what ``purge_parametric`` holds rows against.  A table to be written."""
    measured = rd.distances(rd.represent(rd.single(clusters), dims), dims)
    per = measured.groupBy("cluster").agg(F.count("*").alias("f"), F.sum("d").alias("distortion"), mean(F.col("x"), dims).alias("c"))
    total = per.agg(F.sum("f").alias("n"), F.sum("distortion").alias("total"))
    each = per.crossJoin(total).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))  # one row
    return each.select(F.col("cluster").cast("long").alias("center"), "c", "k", (change_of_entropy(F.col("f"), F.col("n")) / F.col("k") * F.col("total")).alias("radius"))


def flagged(rows: DataFrame, frozen: DataFrame, dims: int) -> DataFrame:
    """(row_id, center, d, k) of rows (row_id, x), streamed or not, at or beyond the radius of their nearest center."""
    placed = nearest(rows, frozen.select("center", "c").distinct(), dims)
    return placed.join(frozen.select("center", "k", "radius"), "center").where("d >= radius").select("row_id", "center", "d", "k")
