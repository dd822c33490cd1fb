"""Connected components by contraction: each round maps every node to its smallest neighbour, twice over, and keeps the edges between what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of the component) for every node of ``edges`` (a, b); null ends and loops are left out.

    Groups are never gathered: a hub of any degree is an aggregate of its edges.
    """
    live = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")).select(F.col("a").alias("u"), "p"))
        for _ in range(2):  # the parent's parent
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            before, parent = parent, written(parent.join(up, "p").select("u", F.col("pp").alias("p")))
            drop_written(before)
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            before = labels
            labels = written(labels.join(parent, F.col("component") == F.col("u"), "left").select("node", F.coalesce("p", "component").alias("component")))
            drop_written(before)
        # (a, b) become their parents; what falls together is gone
        x = live.join(parent.select(F.col("u").alias("a"), F.col("p").alias("pa")), "a")
        x = x.join(parent.select(F.col("u").alias("b"), F.col("p").alias("pb")), "b")
        before, live = live, written(x.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a < b").distinct())
        drop_written(before)
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("component"))
