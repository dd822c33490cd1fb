"""Pairs of texts within some edits: equal to brute force however a group is cut, and dealt out to tasks."""

import random

import pytest
from pyspark.sql import functions as F

from captionlake.operators.joins import edit_pairs
from captionlake.plans import corpus

SF = "/root/testdata/sf0.001"


def distance(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


@pytest.mark.parametrize("stripe", [1, 3, 8192])
def test_equal_to_brute_force(spark, stripe):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), i, "".join(rng.choices("xyzé", k=rng.randrange(5)))) for i in range(60)]
    rows += [("a", 3, "xyz"), ("b", 3, "xyz"), ("b", 3, "xyz"), (None, 70, "x"), ("a", None, "x"), ("a", 71, None), ("c", 72, "x")]  # a key that comes again, and nulls
    df = spark.createDataFrame(rows, "g string, i long, t string")
    got = sorted(map(tuple, edit_pairs(df, ["g"], "i", "t", 2, stripe).collect()))
    whole = [r for r in rows if None not in r]
    want = [(i, j, d) for g, i, t in whole for h, j, u in whole if g == h and i < j and (d := distance(t, u)) <= 2]
    assert got == sorted(want) and len(got) > 300


def test_one_file_and_one_group_are_dealt_out(spark, tmp_path):
    """A table of a few MB is one task of a scan, and its groups may be few: the pairs must not all be one task's."""
    p = spark.read.parquet(f"{SF}/part.parquet").withColumns({"p_brand": F.lit("one"), "p_size": F.lit(1)})
    p.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pairs = edit_pairs(spark.read.parquet(str(tmp_path / "part.parquet")), ["p_brand", "p_size"], "p_partkey", "p_name", 12, 20)
    by_task = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(by_task) > 1 and sum(r["count"] for r in by_task) == 200 * 199 // 2
    assert corpus.edit_distance_pairs(spark, SF).select(F.spark_partition_id()).distinct().count() > 1
