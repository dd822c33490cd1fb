"""Operators on hand-made rows, their plans, and streams against batches."""

import random

from pyspark.sql import functions as F

from captionlake.operators import joins as J
from captionlake.operators.percentiles import rounded_rank
from captionlake.operators.windows import islands, latest_per_key, missing_numbers, within_budget
from captionlake.plans import captions, corpus, ledger, search
from captionlake.plans import joins as joined
from captionlake.streaming.run import run_now
from captionlake.streaming.state import gated, resequenced

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounded_rank_is_half_even(spark):
    rows = [("a", float(v)) for v in (1, 2, 4, 10)] + [("b", 7.0), ("c", None)]
    got = {r.k: (r.n, r.p50, r.p95, r.max) for r in rounded_rank(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (4, 4.0, 10.0, 10.0), "b": (1, 7.0, 7.0, 7.0)}  # 0.5 * 3 = 1.5 rounds to 2


def test_sequences(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 2, 5, 9)], "k string, n int")
    assert sorted(r.n for r in missing_numbers(df, ["k"], "n").collect()) == [3, 4, 6, 7, 8]
    assert sorted(r.n for r in missing_numbers(df, ["k"], "n", F.lit(0)).collect()) == [0, 3, 4, 6, 7, 8]
    assert [r.n for r in latest_per_key(df, ["k"], [F.desc("n")]).collect()] == [9]
    assert [r.n for r in within_budget(df, ["k"], [F.col("n")], F.col("n"), 5).collect()] == [1, 2, 2]
    runs = islands(df.distinct(), ["k"], ["n"], F.col("n") > 4)
    assert [r.island for r in runs.orderBy("n").collect()] == [0, 0, 1, 2]


def test_as_of_and_overlap_against_brute_force(spark):
    rng = random.Random(4)
    left = [(rng.randrange(3), rng.randrange(100), i) for i in range(80)]
    right = [(k, t, 10 * t + k) for k in range(3) for t in rng.sample(range(100), 20)]
    got = J.as_of(spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, v int"), ["k"], "t", ["v"]).collect()
    want = {i: max(((u, v) for q, u, v in right if q == k and u <= t), default=(0, None))[1] for k, t, i in left}
    assert {r.i: r.v for r in got} == want
    a = [(i, rng.randrange(3), s, s + rng.randrange(40)) for i, s in enumerate(rng.choices(range(100), k=60))]
    b = [(i, rng.randrange(3), s, s + rng.randrange(40)) for i, s in enumerate(rng.choices(range(100), k=60))]
    x, y = spark.createDataFrame(a, "a int, k int, a0 int, a1 int"), spark.createDataFrame(b, "b int, k int, b0 int, b1 int")
    pairs = [(r.a, r.b) for r in J.interval_overlap(x, y, ["k"], ("a0", "a1"), ("b0", "b1"), 7).collect()]
    assert sorted(pairs) == sorted((i, j) for i, k, s, e in a for j, q, u, v in b if k == q and s < v and u < e and s < e and u < v)


def test_containment_and_diff(spark):
    texts = spark.createDataFrame([(1, "the cat sat"), (2, "a dog")], "id int, text string")
    terms = spark.createDataFrame([("cat",), ("sat",), ("dog ",), ("zzz",)], "term string")
    assert sorted((r.id, r.term) for r in J.containment(texts, terms, "text", "term").collect()) == [(1, "cat"), (1, "sat")]
    old, new = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, v int"), spark.createDataFrame([(2, 6), (3, 8), (4, 1)], "k int, v int")
    assert {r.k: r.change for r in J.keyed_diff(old, new, ["k"], ["v"]).collect()} == {1: "removed", 2: "same", 3: "changed", 4: "added"}


def test_rewritten_joins_plan_no_nested_loop(spark):
    for fn in (joined.containment_term_hits, joined.scope_join, joined.interval_overlap_join, joined.asof_last_state, joined.full_outer_diff, joined.interval_exclusion, search.subgram_suppression, corpus.edit_distance_pairs, ledger.missing_sequence):
        p = plan(fn(spark, SF))
        assert "NestedLoop" not in p and "Cartesian" not in p, fn.__name__


def test_filters_reach_the_scan(spark):
    from captionlake.plans import relational

    p = plan(relational.prefix_match(spark, SF))
    assert "PushedFilters" in p and "StringStartsWith(o_orderpriority,1-)" in p and "ReadSchema: struct<o_orderpriority:string>" in p


def test_results_do_not_depend_on_partitions(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    for fn in (ledger.caption_apply, captions.islands_of_activity, ledger.materialised_view):
        assert sorted(map(tuple, fn(spark, SF).collect())) == sorted(map(tuple, fn(spark, str(tmp_path)).collect()))


def test_resequencer_gives_up_holes_beyond_the_cap(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 1, k) for i, k in enumerate([0, 2, 1, 1, 5, 6, 7])]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, k long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, k long").parquet(str(tmp_path / "e"))
    got = run_now(resequenced(stream, wait_ms=None, cap=2)).collect()
    assert sorted((r.k, r.status) for r in got) == [(0, "released"), (1, "released"), (1, "retry"), (2, "released"), (3, "missing"), (4, "missing"), (5, "released"), (6, "released"), (7, "released")]


def test_gate_over_several_batches(spark, tmp_path):
    for n, rows in enumerate([[(1, 3, "view"), (2, 2, "view")], [(3, 3, "view"), (4, 4, "error")], [(5, 9, "view")]]):
        df = spark.createDataFrame([(i, k, t) for i, k, t in rows], "event_id long, k long, event_type string").withColumns({"user_id": F.lit(1).cast("long"), "ts": F.timestamp_seconds("event_id")})
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, k long, event_type string, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = run_now(gated(stream)).orderBy("cursor").collect()
    assert [(r.event_id, r.version, r.cursor) for r in got] == [(1, 3, 1), (4, 4, 2)]


def test_documents_with_one_opening_stay_apart(spark, tmp_path):
    opening = "the same licence header " * 20
    rows = [(1, opening + "one"), (2, opening + "two"), (3, opening.upper() + "One!"), (4, "первый текст"), (5, "второй текст"), (6, None), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(map(tuple, corpus.near_dedup_keep_best(spark, str(tmp_path)).collect())) == [(2, 1), (3, 2), (4, 1), (5, 1), (6, 1), (7, 1)]


def test_near_dedup_equals_its_sql_without_the_cut(spark):
    import duckdb

    from captionlake import registry

    con, sf = duckdb.connect(), SF.replace("0.001", "0.01")
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.ORACLES["near_dedup_keep_best"].replace("[:200]", "")).fetchall()
    assert sorted(map(tuple, corpus.near_dedup_keep_best(spark, sf).collect())) == sorted(want)


def test_only_wanted_leaves_are_read(spark):
    import re

    from captionlake.plans.metrics import nested_metrics, nested_pruning

    q = nested_pruning(spark, "/root/testdata/sf0.001")
    read = re.search(r"ReadSchema: (.*)", q._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "latency:struct<A2:struct<p50:double>,n:bigint>" in read and "hidden" not in read and "payload" not in read
    assert "payload" in nested_metrics(spark, "/root/testdata/sf0.001").columns


def test_a_hot_group_is_ranked_in_pieces(spark):
    """One group of a million distinct values and ten of a few: exact, and no piece has more than a 128th of the table."""
    from pyspark.sql import functions as F

    from captionlake.operators.percentiles import RANGES, range_of, rounded_rank, summary

    n = 1_000_000
    hot = spark.range(n).select(F.lit("hot").alias("k"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    few = spark.range(50).select(F.concat(F.lit("k"), (F.col("id") % 10).cast("string")).alias("k"), (F.col("id") * 1000.5).alias("v"))
    df = hot.unionByName(few)
    largest = df.withColumn("b", range_of(df, "v")).groupBy("k", "b").agg(F.count_distinct("v").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    assert largest <= n / (RANGES // 2)
    got = {r.k: r for r in rounded_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert (got["hot"].n, got["hot"].p50, got["hot"].p95, got["hot"].max) == (n, round(0.5 * (n - 1)), round(0.95 * (n - 1)), n - 1)
    assert (got["k3"].n, got["k3"].p50, got["k3"].max) == (5, 23 * 1000.5, 43 * 1000.5) and len(got) == 11
    assert {r.k: r.p25 for r in summary(df, ["k"], "v", {"p25": 0.25}).collect()}["hot"] == 249999.75


def test_percentiles_of_odd_groups(spark):
    import random
    from statistics import quantiles

    from captionlake.operators.percentiles import summary

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.5, -2.0, 1e300, 5e-324, 0.0, rng.random()])) for _ in range(500)] + [("only nulls", None), ("one", 7.0), ("ties", 1.0), ("ties", 1.0)]
    got = {r.k: r for r in summary(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q": 0.25}).collect()}
    for k in ("a", "b", None):
        values = [v for x, v in rows if x == k]
        assert got[k].n == len(values) and abs(got[k].q - quantiles(values, n=4, method="inclusive")[0]) <= 1e-4
    assert (got["only nulls"].n, got["only nulls"].q, got["one"].q, got["ties"].q) == (0, None, 7.0, 1.0)
    assert summary(spark.createDataFrame([], "k string, v double"), ["k"], "v", {"q": 0.25}).count() == 0


def test_sign_test_is_exact_for_any_counts(spark):
    import math
    from fractions import Fraction

    from captionlake.functions.numbers import sign_test

    rows = [(0, 0), (0, 1), (1, 1), (0, 70), (3, 9), (14, 17), (15, 16), (500, 560), (1000, 1000), (2, 900), (4000, 4300), (5 * 10**9, 5 * 10**9 + 200_000), (None, 3)]
    got = {(r.w, r.l): r.p for r in spark.createDataFrame(rows, "w long, l long").select("w", "l", sign_test(F.col("w"), F.col("l")).alias("p")).collect()}
    for w, l in rows[:-2]:
        want = min(1.0, float(Fraction(2 * sum(math.comb(w + l, i) for i in range(min(w, l) + 1)), 2 ** (w + l))))
        assert math.isclose(got[w, l], want, rel_tol=1e-12)
    w, l = rows[-2]  # the normal law with its correction
    assert math.isclose(got[w, l], math.erfc((l - w - 1) / math.sqrt(w + l) / math.sqrt(2)), rel_tol=1e-6)
    assert got[None, 3] is None
