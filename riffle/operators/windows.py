"""Ordered operators: islands, carry-forward, first wins, running numbers, top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(points: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """keys, start, end of each maximal run of consecutive integers `at`."""
    w = Window.partitionBy(*keys).orderBy(at)
    runs = points.select(*keys, at).distinct().withColumn("__i", F.col(at) - F.row_number().over(w))
    return runs.groupBy(*keys, "__i").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("__i")


def carry_forward(rows: DataFrame, keys: Sequence[str], order: str, opens: Column, closes: Column, value: Column, out: str) -> DataFrame:
    """Rows that close, with the value of the last opener before them in their group, each opener being used once at most."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    opened = rows.withColumn("__island", F.count(F.when(opens, 1)).over(w)).withColumn("__value", F.last(F.when(opens, value), ignorenulls=True).over(w))
    nth = F.count(F.when(closes, 1)).over(Window.partitionBy(*keys, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return opened.withColumn("__nth", nth).where(closes & (F.col("__nth") == 1) & (F.col("__island") > 0)).withColumnRenamed("__value", out).drop("__island", "__nth")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for each key: values of the first row by order. One aggregate, no sort of the group."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("__v")).select(*keys, *(F.col(f"__v.{v}").alias(v) for v in values))


def top_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each group; the filter on row_number cuts groups before they are shuffled."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def running_counts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], **conditions: Column) -> DataFrame:
    """How many rows up to each one meet each condition."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.count(F.when(c, 1)).over(w) for name, c in conditions.items()})
