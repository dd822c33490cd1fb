"""Exact percentiles of groups of any size.

Distinct values are counted, so a group shuffles no more rows than it has values. A group is never ranked in one task:
fences that cut the whole table's values into RANGES ranges of about equal size (from a mergeable sketch) cut it into
pieces, the pieces' sizes tell in which piece a rank falls, and only that piece's values are ranked. So however the fences
fall the values are exact, and a task ranks about one RANGES-th of the table at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.run import kept

#: Ranges of values, in steps of STEP; how exact the fences between them are.
RANGES, STEP, ACCURACY = 256, 16, 4_000


def range_of(df: DataFrame, value: str) -> Column:
    """The number of the range, from 0, in which a value lies."""
    at = [i / RANGES for i in range(1, RANGES)]
    fences = df.agg(F.percentile_approx(value, at, ACCURACY).alias("f")).first()["f"]  # one row
    kind = df.schema[value].dataType
    fences = sorted(fences) if fences else []
    every = F.array(*[F.lit(x).cast(kind) for x in fences]) if fences else F.array().cast(f"array<{kind.simpleString()}>")
    coarse = F.array(*[F.lit(x).cast(kind) for x in fences[STEP - 1 :: STEP]]) if len(fences) >= STEP else F.array().cast(f"array<{kind.simpleString()}>")
    first = F.size(F.filter(coarse, lambda x: x <= F.col(value))) * STEP
    return first + F.size(F.filter(F.slice(every, first + 1, F.lit(STEP - 1)), lambda x: x <= F.col(value)))


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, n, max and for each name the value at its rank: a function of n to a place from 0 on in the sorted group. Null values don't count; null keys are a group."""
    counts = kept(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")).withColumn("_b", range_of(df, value)))
    pieces = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_p"), F.max(value).alias("_max"))
    w = Window.partitionBy(*keys)  # RANGES rows of a group at most
    pieces = pieces.withColumns({"_upto": F.sum("_p").over(w.orderBy("_b")), "n": F.sum("_p").over(w), "max": F.max("_max").over(w)})
    for i, rank in enumerate(ranks.values()):
        place = rank(F.col("n")).cast("long") - (F.col("_upto") - F.col("_p"))
        pieces = pieces.withColumn(f"_r{i}", F.when((place >= 0) & (place < F.col("_p")), place))
    wanted = pieces.filter(" OR ".join(f"_r{i} IS NOT NULL" for i in range(len(ranks)))).select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_b").alias("_piece"), "n", "max", *[f"_r{i}" for i in range(len(ranks))])
    same = F.col("_b") == F.col("_piece")
    for j, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{j}"))
    run = counts.join(wanted, same).withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy(value)))
    found = [F.min(F.when(F.col("_upto") > F.col(f"_r{i}"), F.col(value))).alias(name) for i, name in enumerate(ranks)]
    return run.groupBy(*keys).agg(F.max("n").alias("n"), *found, F.max("max").alias("max"))


def rounded_rank(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys, n, max and a column for each quantile: the value at index round_half_even(q * (n - 1)) of the sorted group."""
    return at_ranks(df, keys, value, {name: lambda n, q=q: F.bround(q * (n - 1), 0) for name, q in quantiles.items()})


def summary(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """n, linear-rank percentiles (to four decimals, so that they do not hang on the order of floating-point steps) and max of each group; nulls where a group has no value."""
    low = {f"_low{i}": lambda n, q=q: F.floor(q * (n - 1)) for i, q in enumerate(quantiles.values())}
    high = {f"_high{i}": lambda n, q=q: F.ceil(q * (n - 1)) for i, q in enumerate(quantiles.values())}
    x = at_ranks(df, keys, value, low | high)

    def between(i: int, q: float) -> Column:
        at = q * (F.col("n") - 1)
        return F.round(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (at - F.floor(at)), 4)

    out = x.select(*keys, "n", *[between(i, q).alias(name) for i, (name, q) in enumerate(quantiles.items())], "max")
    empty = df.groupBy(*keys).agg(F.count(value).alias("n")).filter("n = 0")  # groups of nulls only
    return out.unionByName(empty, allowMissingColumns=True)


def mean_of_cents(cents: str = "cents"):
    """The mean of values with two decimals, from exact integers."""
    return F.sum(cents).cast("double") / 100 / F.count(cents)
