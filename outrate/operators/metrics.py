"""Classification metrics of flagged rows, and the best of a grid of parameters by each metric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """flags (by..., predicted, actual booleans) -> precision, recall, f_score, mcc, fpr, tpr; all metrics 0 without a true positive."""
    p, a = F.col("predicted"), F.col("actual")
    n = flags.groupBy(*by or []).agg(*(F.count_if(c).cast("double").alias(x) for x, c in (("tp", p & a), ("fp", p & ~a), ("fn", ~p & a), ("tn", ~p & ~a))))
    return rates(n, by or [])


def rates(n: DataFrame, by: list[str]) -> DataFrame:
    """The same from counts (by..., tp, fp, fn, tn)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = tp / (tp + fp), tp / (tp + fn)
    mcc = F.when(tn > 0, (tp * tn - fp * fn) / (F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn))).otherwise(0.0)
    some = lambda c: F.when(tp > 0, c).otherwise(0.0)
    rate = lambda x, y: F.when(x + y > 0, x / F.when(x + y > 0, x + y)).otherwise(0.0)
    return n.select(*by, "tp", "fp", "fn", "tn", some(precision).alias("precision"), some(recall).alias("recall"), some(2 * precision * recall / (precision + recall)).alias("f_score"), some(mcc).alias("mcc"), rate(fp, tn).alias("fpr"), rate(tp, fn).alias("tpr"))


def best(scored: DataFrame, params: str) -> DataFrame:
    """(metric, params, value) of each metric's winner; ties: the smallest place in the grid (grid_order)."""
    tidy = scored.select("grid_order", params, F.explode(F.map_from_arrays(F.array(*map(F.lit, ("precision", "recall", "f_score", "mcc"))), F.array("precision", "recall", "f_score", "mcc"))).alias("metric", "value"))
    return tidy.groupBy("metric").agg(F.max_by(F.struct(params, "value"), F.struct(F.round("value", 9), -F.col("grid_order"))).alias("m")).select("metric", f"m.{params}", "m.value")
