"""Numbers and running sums in an order over all rows, without a task that sees all of them.

Rows are dealt out by ranges of the order; each range counts or sums up on its own, and what the ranges before it hold, a row for each
range, is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outrate.operators.state import kept


def ranged(df: DataFrame, by: list[str | Column]) -> DataFrame:
    """df by ranges, with range_, the number of the range; equal rows stand in one.  A written table, so that ranges stay as they are."""
    return kept(df.repartitionByRange(*by).withColumn("range_", F.spark_partition_id()))


def _offsets(totals: DataFrame, columns: list[str]) -> DataFrame:
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    return totals.select("range_", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in columns])


def numbered(df: DataFrame, by: list[str | Column], name: str) -> DataFrame:
    """df with the place of each row, from 1, in the order of ``by``, which should tell all rows apart."""
    rows = ranged(df, by)
    offsets = _offsets(rows.groupBy("range_").agg(F.count("*").alias("n")), ["n"])
    place = F.row_number().over(Window.partitionBy("range_").orderBy(*by))
    return rows.withColumn(name, place).join(F.broadcast(offsets), "range_").withColumn(name, F.col(name) + F.col("before_n")).drop("range_", "before_n")  # a row for each range


def running(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """df with the sums of columns over all rows up to each one's value of ``by``, rows with the same value included: sum_<column>."""
    return summed(ranged(df, [by]), by, columns).drop("range_")


def summed(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """The same of rows that ``ranged`` has dealt out by the same column; their ranges stay."""
    offsets = _offsets(rows.groupBy("range_").agg(*[F.sum(c).alias(c) for c in columns]), columns)
    own = Window.partitionBy("range_").orderBy(by).rangeBetween(Window.unboundedPreceding, 0)
    both = rows.withColumns({f"sum_{c}": F.sum(c).over(own) for c in columns}).join(F.broadcast(offsets), "range_")  # a row for each range
    return both.withColumns({f"sum_{c}": F.col(f"sum_{c}") + F.col(f"before_{c}") for c in columns}).drop(*[f"before_{c}" for c in columns])
