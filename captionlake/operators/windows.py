"""Sequence operators: latest rows, islands, gaps, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in ``order``."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def islands(df: DataFrame, keys: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number the runs of each key; ``breaks`` is true where a new run begins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int, after: bool = True) -> DataFrame:
    """Rows of each key, in order, while the sizes so far stay within a budget. ``before`` is the size of the rows ahead."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = df.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return ahead.filter(F.col("before") + (size if after else F.lit(1)) <= budget)


def missing_numbers(df: DataFrame, keys: list[str], number: str, start: Column | None = None) -> DataFrame:
    """keys and number of each number without a row between the first (or ``start``) and the last of its key, by gaps between neighbours."""
    seen = df.select(*keys, number).distinct()
    w = Window.partitionBy(*keys).orderBy(number)
    before = F.lag(number).over(w) if start is None else F.coalesce(F.lag(number).over(w), start - 1)
    gaps = seen.withColumn("_b", before).filter(F.col(number) - F.col("_b") > 1)
    return gaps.select(*keys, F.explode(F.sequence(F.col("_b") + 1, F.col(number) - 1)).alias(number))
