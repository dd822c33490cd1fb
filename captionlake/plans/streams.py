"""Structured Streaming twins of batch queries: each runs over what is there and returns its final state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import folds
from ..registry import query
from . import recursions
from ..streaming.run import event_stream, last_of, run_now
from ..streaming.state import folded, gated, resequenced

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


@query("T18", "SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir) -> DataFrame:
    agg = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy("user_id", F.window("ts", "1 hour")).agg(F.count("*").alias("n"))
    flat = agg.select("user_id", F.floor(F.unix_timestamp("window.start") / 3600).alias("slot"), "n")
    return last_of(run_now(flat, "update"), ["user_id", "slot"])


@query("T19", "SELECT CAST(s AS BIGINT) AS slot, count(*) AS n FROM events, unnest([floor(epoch(ts) / 1800), floor(epoch(ts) / 1800) - 1]) AS u(s) GROUP BY 1")
def stream_sliding(spark, sf_dir) -> DataFrame:
    agg = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return last_of(run_now(agg.select(F.floor(F.unix_timestamp("window.start") / 1800).alias("slot"), "n"), "update"), ["slot"])


@query("T16", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(event_id) AS first, count(*) AS n FROM i GROUP BY user_id, s")
def stream_session(spark, sf_dir) -> DataFrame:
    agg = event_stream(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("event_id").alias("first"), F.count("*").alias("n"))
    out = run_now(agg.select("user_id", "first", "n"), "complete")
    return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # the last batch is the whole state; one row


@query("T01 T02 T05", """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
m AS (SELECT *, max(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e), r AS (SELECT * FROM m WHERE best IS NULL OR k > best),
d AS (SELECT *, coalesce(max(CAST(event_type = 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dead FROM r)
SELECT user_id, event_id, k AS version, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cursor FROM d WHERE dead = 0""")
def stream_version_dedup(spark, sf_dir) -> DataFrame:
    stateful(spark)
    return run_now(gated(event_stream(spark, sf_dir))).drop("batch")


@query("T10", "SELECT user_id, event_type, k, count(*) AS passed FROM (SELECT DISTINCT user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2, 3")
def stream_resubmission(spark, sf_dir) -> DataFrame:
    """The same key and digest within a watermark passes once."""
    once = event_stream(spark, sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "k"])
    return run_now(once.select("user_id", "event_type", "k")).groupBy("user_id", "event_type", "k").agg(F.count("*").alias("passed"))


@query("T06 T09", """WITH e AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS i FROM e)
SELECT user_id, k FROM r WHERE k = i""")
def stream_resequence(spark, sf_dir) -> DataFrame:
    """What a session releases in order before its first hole (no hole is given up here)."""
    stateful(spark)
    out = run_now(resequenced(event_stream(spark, sf_dir), wait_ms=None, cap=10**6))
    return out.filter("status = 'released'").select("user_id", "k")


@query("T23 J16", """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT s.event_id AS start_id, f.event_id AS stop_id FROM e s JOIN e f ON s.user_id = f.user_id AND s.k = f.k AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 2 HOUR WHERE s.event_type = 'view' AND f.event_type = 'click'""")
def stream_start_stop(spark, sf_dir) -> DataFrame:
    """A stream-stream join: a start waits for its stop for two hours."""
    side = lambda kind, p: event_stream(spark, sf_dir).filter(F.col("event_type") == kind).select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("k").alias(f"{p}_k"), F.col("ts").alias(f"{p}_ts")).withWatermark(f"{p}_ts", "1 day")
    pairs = side("view", "start").join(side("click", "stop"), F.expr("start_user = stop_user AND start_k = stop_k AND stop_ts >= start_ts AND stop_ts <= start_ts + INTERVAL 2 HOURS"))
    return run_now(pairs.select("start_id", "stop_id")).drop("batch")


def lines(spark, sf_dir) -> DataFrame:
    """The event log as a stream of lines: key, at (seconds), id, text."""
    stateful(spark)
    return event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_seconds("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("text"), "value")


@query("T20", recursions.throttling(3600, recursions.SECONDS))
def stream_throttle(spark, sf_dir) -> DataFrame:
    return run_now(folded(lines(spark, sf_dir), folds.throttling(3600))).drop("batch")


@query("T33", recursions.muting(3600))
def stream_mute_repeats(spark, sf_dir) -> DataFrame:
    return run_now(folded(lines(spark, sf_dir), folds.muting(3600))).drop("batch")


@query("T28", recursions.admitting(3600, 3, "user_id"))
def stream_admission(spark, sf_dir) -> DataFrame:
    return run_now(folded(lines(spark, sf_dir), folds.admitting(3600, 3))).drop("batch")


@query("T13", recursions.carrying("CAST(floor(floor(epoch(ts)) / 7200) AS BIGINT)", "value > 60"))
def stream_carry(spark, sf_dir) -> DataFrame:
    """Stale lines ride along with a line of the next two slots of two hours."""
    rows = lines(spark, sf_dir).select("key", F.floor(F.col("at") / 7200).alias("seq"), "at", "id", "text", (F.col("value") > 60).alias("stale"))
    _, schema, start, step = folds.carrying()
    return run_now(folded(rows, (["at", "id"], schema, start, step))).drop("batch")


@query("T07 T08")
def stream_holes(spark, sf_dir) -> DataFrame:
    """Numbers released in order where holes are given up after an hour of event time, or when more than eight are held."""
    stateful(spark)
    e = event_stream(spark, sf_dir).withWatermark("ts", "1 minute")
    return run_now(resequenced(e, wait_ms=3_600_000, cap=8)).drop("batch")
