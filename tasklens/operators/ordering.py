"""Global row numbers, neighbours and runs without a window over all rows in one task.

The caller names a bucket: an expression that never falls along the order (a number divided, the first letters of an
id). Rows are numbered inside each bucket, and only one row for each bucket goes through a single window. A bucket is a
function of the row alone, so a retry or a second branch of the plan sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, bucket: Column, *order: str, name: str = "pos") -> DataFrame:
    """rows with their place (from 0, a long) along the order; the bucket must be the first part of the order."""
    made = rows.withColumn("_b", bucket)
    counts = made.groupBy("_b").agg(F.count("*").alias("_c"))
    ahead = F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_b", ahead.alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*order)).cast("long") - 1
    return made.withColumn("_own", own).join(starts, "_b").withColumn(name, F.col("_ahead") + F.col("_own")).drop("_b", "_own", "_ahead")


def _previous(rows: DataFrame, bucket: Column, order: str, value: str) -> DataFrame:
    """rows with _b and _prev, a struct of the value of the row before, null for the first row of all."""
    made = rows.withColumn("_b", bucket)
    lasts = made.groupBy("_b").agg(F.max_by(F.struct(value), order).alias("_last"))
    before = lasts.select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_before"))
    inside = F.lag(F.struct(value)).over(Window.partitionBy("_b").orderBy(order))
    return made.withColumn("_inside", inside).join(before, "_b").withColumn("_prev", F.coalesce("_inside", "_before")).drop("_inside", "_before")


def with_previous(rows: DataFrame, bucket: Column, order: str, value: str, name: str = "previous") -> DataFrame:
    """rows with the value of the row before, null for the first; a bucket's first row looks at the last of the bucket before."""
    return _previous(rows, bucket, order, value).withColumn(name, F.col("_prev")[value]).drop("_b", "_prev")


def with_runs(rows: DataFrame, bucket: Column, order: str, value: str, name: str = "run") -> DataFrame:
    """rows with the number of their run, from 1: neighbours of one value share it (null is a value)."""
    new = F.when(F.col("_prev").isNull() | ~F.col("_prev")[value].eqNullSafe(F.col(value)), 1).otherwise(0)
    made = _previous(rows, bucket, order, value).withColumn("_new", new)
    sums = made.groupBy("_b").agg(F.sum("_new").alias("_s"))
    ahead = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("_new").over(Window.partitionBy("_b").orderBy(order))
    return made.withColumn("_own", own).join(sums.select("_b", ahead.alias("_ahead")), "_b").withColumn(name, F.col("_ahead") + F.col("_own")).drop("_b", "_own", "_ahead", "_new", "_prev")
