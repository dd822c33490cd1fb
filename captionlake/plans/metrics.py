"""Latency and event metrics: percentiles, rollups, windows, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import folds
from ..operators.percentiles import mean_of_cents, rounded_rank, summary
from ..operators.windows import latest_per_key
from ..registry import query
from ..streaming.run import kept
from ..sources.tables import events, table



def local_day():
    """The calendar day eight hours east."""
    return F.date_format(F.from_utc_timestamp("ts", "Asia/Taipei"), "yyyy-MM-dd")


MEAN = "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*)"
RANK = "list_sort(list(value))[CAST(round_even({q} * (count(*) - 1), 0) AS BIGINT) + 1]"
P50, P95 = RANK.format(q="0.5"), RANK.format(q="0.95")


@query("A05 F41", f"SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_type AS name, count(*) AS n, {P50} AS p50, {P95} AS p95, max(value) AS max, {MEAN} AS avg FROM events GROUP BY 1, 2")
def daily_metric_rollup(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).select(local_day().alias("day"), F.col("event_type").alias("name"), "value", "cents")
    ranks = rounded_rank(e, ["day", "name"], "value", {"p50": 0.5, "p95": 0.95})
    return ranks.join(e.groupBy("day", "name").agg(mean_of_cents().alias("avg")), ["day", "name"])


@query("A04", "SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1")
def pct_linear_by_type(spark, sf_dir) -> DataFrame:
    return summary(events(spark, sf_dir), ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).drop("n", "max")


@query("A05", f"SELECT event_type, count(*) AS n, {P50} AS p50, {P95} AS p95, max(value) AS max FROM events GROUP BY 1")
def pct_rounded_by_type(spark, sf_dir) -> DataFrame:
    return rounded_rank(events(spark, sf_dir), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("A07", "SELECT user_id, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, max(value) AS max FROM events GROUP BY 1")
def distribution_summary(spark, sf_dir) -> DataFrame:
    return summary(events(spark, sf_dir), ["user_id"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


@query("W06", "SELECT user_id, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, max(value) AS max FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 200) GROUP BY 1")
def rolling_last_n_percentile(spark, sf_dir) -> DataFrame:
    last = latest_per_key(events(spark, sf_dir), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 200)
    return summary(last, ["user_id"], "value", {"p50": 0.5, "p95": 0.95})


@query("W06", "SELECT event_id, max(value) OVER w AS peak, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def sliding_peak(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return events(spark, sf_dir).select("event_id", F.max("value").over(w).alias("peak"), F.count("*").over(w).alias("n"))


@query("A23", "SELECT user_id, event_type, min(value) AS low, max(value) AS high, arg_min(value, {'t': ts, 'i': event_id}) AS first, arg_max(value, {'t': ts, 'i': event_id}) AS last, count(*) AS n FROM events GROUP BY 1, 2")
def series_first_last_peak(spark, sf_dir) -> DataFrame:
    at = F.struct("ts", "event_id")
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"), F.count("*").alias("n")
    )


@query("A21", "SELECT event_type, room, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(grouping(event_type) * 2 + grouping(room) AS BIGINT) AS level FROM (SELECT *, user_id % 10 AS room FROM events) GROUP BY GROUPING SETS ((), (event_type), (room), (event_type, room))")
def grouping_sets_summary(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumn("room", F.col("user_id") % 10)
    return e.cube("event_type", "room").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.grouping_id().alias("level"))


@query("A01", """SELECT 'events' AS name, count(*) AS rows, count(*) FILTER (event_type = 'error') AS flagged FROM events UNION ALL
SELECT 'documents', count(*), count(*) FILTER (n_chars > 1000) FROM documents UNION ALL SELECT 'orders', count(*), count(*) FILTER (o_orderstatus = 'F') FROM orders""")
def inventory_counts(spark, sf_dir) -> DataFrame:
    flags = {"events": F.col("event_type") == "error", "documents": F.col("n_chars") > 1000, "orders": F.col("o_orderstatus") == "F"}
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("rows"), F.count_if(c).alias("flagged")) for t, c in flags.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("A02", "SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS mode, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def mode_by_group(spark, sf_dir) -> DataFrame:
    counts = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("mode"), F.max("n").alias("n"))


@query("A03", "SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type IN ('click', 'view')) AS seen, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS spent FROM events GROUP BY 1")
def conditional_sums(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(kind == "error").alias("errors"), F.count_if(kind.isin("click", "view")).alias("seen"), F.coalesce(F.sum(F.when(kind == "purchase", F.col("cents"))), F.lit(0)).alias("spent")
    )


@query("A06", f"SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_type, CAST(user_id % 10 AS BIGINT) AS room, count(*) AS n, {MEAN} AS avg, max(value) AS max FROM events GROUP BY 1, 2, 3")
def local_day_rollup(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy(local_day().alias("day"), "event_type", (F.col("user_id") % 10).alias("room")).agg(F.count("*").alias("n"), mean_of_cents().alias("avg"), F.max("value").alias("max"))


@query("A16", """SELECT user_id, count(*) FILTER (b = 'failed') AS failed, count(*) FILTER (b = 'skipped') AS skipped, count(*) FILTER (b = 'backlog') AS backlog, count(*) FILTER (b = 'other') AS other,
CAST(count(*) FILTER (b = 'failed') AS DOUBLE) / count(*) AS failed_rate FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' AND value > 50 THEN 'backlog' WHEN event_type = 'view' THEN 'skipped' ELSE 'other' END AS b FROM events) GROUP BY 1""")
def failure_buckets(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    b = F.when(kind == "error", "failed").when((kind == "view") & (F.col("value") > 50), "backlog").when(kind == "view", "skipped").otherwise("other")
    names = ["failed", "skipped", "backlog", "other"]
    e = events(spark, sf_dir).withColumn("b", b)
    return e.groupBy("user_id").agg(*[F.count_if(F.col("b") == x).alias(x) for x in names], (F.count_if(F.col("b") == "failed").cast("double") / F.count("*")).alias("failed_rate"))


@query("A09", "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'click') AS DOUBLE) / 100 / count(*) FILTER (event_type = 'click') AS asr, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (event_type = 'view') AS DOUBLE) / 100 / count(*) FILTER (event_type = 'view') AS mt FROM events GROUP BY 1")
def session_timing_averages(spark, sf_dir) -> DataFrame:
    def mean(kind: str):
        is_kind = F.col("event_type") == kind
        return F.try_divide(F.sum(F.when(is_kind, F.col("cents"))).cast("double") / 100, F.count_if(is_kind))

    return events(spark, sf_dir).groupBy("user_id").agg(mean("click").alias("asr"), mean("view").alias("mt"))


@query("A08", "SELECT stage, count(v) AS n, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, max(v) AS max FROM (SELECT 'asr' AS stage, coalesce(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'view' THEN value END) AS v FROM events UNION ALL SELECT 'mt', CASE WHEN event_type = 'purchase' THEN value END FROM events UNION ALL SELECT 'none', NULL FROM events) GROUP BY 1")
def first_present_sampling(spark, sf_dir) -> DataFrame:
    v = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    wide = events(spark, sf_dir).select(F.coalesce(v("click"), v("view")).alias("asr"), v("purchase").alias("mt"), F.lit(None).cast("double").alias("none"))
    return summary(wide.unpivot([], ["asr", "mt", "none"], "stage", "v"), ["stage"], "v", {"p50": 0.5, "p95": 0.95})


@query("A24", "SELECT user_id, event_type, n, high FROM (SELECT user_id, event_type, count(*) AS n, max(value) AS high FROM events GROUP BY 1, 2) WHERE high < 200 ORDER BY n, high, user_id, event_type LIMIT 1")
def argmin_config(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("high"))
    return rows.filter("high < 200").orderBy("n", "high", "user_id", "event_type").limit(1)


@query("A25", """WITH d AS (SELECT max(event_id) AS event_id, dense_rank() OVER (ORDER BY CAST(ts AS DATE) DESC) AS r FROM events GROUP BY CAST(ts AS DATE)),
w AS (SELECT max(event_id) AS event_id, dense_rank() OVER (ORDER BY isoyear(ts) DESC, weekofyear(ts) DESC) AS r FROM events GROUP BY isoyear(ts), weekofyear(ts))
SELECT event_id FROM d WHERE r <= 14 UNION SELECT event_id FROM w WHERE r <= 8""")
def keep_newest_per_period(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    days = e.groupBy(F.to_date("ts").alias("d")).agg(F.max("event_id").alias("event_id")).orderBy(F.desc("d")).limit(14)
    weeks = e.groupBy(F.expr("extract(YEAROFWEEK FROM ts)").alias("y"), F.weekofyear("ts").alias("w")).agg(F.max("event_id").alias("event_id")).orderBy(F.desc("y"), F.desc("w")).limit(8)
    return days.select("event_id").union(weeks.select("event_id")).distinct()


@query("A26", "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, bool_or(event_type = 'error') AS estimated, max(value) AS oldest FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def backlog_by_room(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).filter(F.col("event_type").isin("error", "view"))
    return e.groupBy("user_id").agg(F.sum("cents").alias("total"), F.bool_or(F.col("event_type") == "error").alias("estimated"), F.max("value").alias("oldest"))


@query("A31", "SELECT l_partkey AS part, count(*) AS use_count, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY 1")
def usage_counters(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("use_count"), F.count_distinct("l_suppkey").alias("owners"))


@query("A33", "SELECT l_returnflag, l_linestatus, min(l_quantity) AS low, max(l_quantity) AS peak, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) / count(*) AS mean FROM lineitem GROUP BY 1, 2")
def resource_ranges(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.min(q).alias("low"), F.max(q).alias("peak"), (F.sum(F.round(q).cast("long")).cast("double") / F.count("*")).alias("mean"))


@query("W13 T30", "SELECT * FROM (SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 300) ORDER BY event_id")
def latest_n(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(300)
    return e.orderBy("event_id").select("event_id", "user_id", "event_type")


@query("F35 P11", "SELECT event_id, CASE WHEN k > 0 THEN value / k END AS rtf, CASE WHEN k IS NULL OR k <= 0 THEN NULL WHEN value / k < 0.5 THEN 'green' WHEN value / k < 0.9 THEN 'amber' ELSE 'red' END AS band FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def rtf_bands(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", F.when(F.col("k") > 0, F.col("value") / F.col("k")).alias("rtf"))
    r = F.col("rtf")
    return e.withColumn("band", F.when(r.isNull(), None).when(r < 0.5, "green").when(r < 0.9, "amber").otherwise("red"))


@query("F43", "SELECT event_type, round(quantile_cont(value, 0.95), 4) AS p95, CASE WHEN count(value) = 0 THEN 'none' WHEN quantile_cont(value, 0.95) <= ok THEN 'ok' WHEN quantile_cont(value, 0.95) <= bad THEN 'warn' ELSE 'bad' END AS level FROM events JOIN (VALUES ('click', 10, 20), ('view', 50, 500), ('error', 500, 900), ('purchase', 100, 200), ('signup', 5, 10)) AS t(event_type, ok, bad) USING (event_type) GROUP BY event_type, ok, bad")
def stage_levels(spark, sf_dir) -> DataFrame:
    limits = spark.createDataFrame([("click", 10, 20), ("view", 50, 500), ("error", 500, 900), ("purchase", 100, 200), ("signup", 5, 10)], "event_type string, ok int, bad int")
    s = summary(events(spark, sf_dir), ["event_type"], "value", {"p95": 0.95}).join(F.broadcast(limits), "event_type")
    return s.select("event_type", "p95", F.when(F.col("n") == 0, "none").when(F.col("p95") <= F.col("ok"), "ok").when(F.col("p95") <= F.col("bad"), "warn").otherwise("bad").alias("level"))


@query("F44", "SELECT event_id, CASE WHEN value <= 0 THEN 1.0::DOUBLE ELSE (CASE WHEN value <= p THEN 1 WHEN value <= 2 * p THEN 2 WHEN value <= 5 * p THEN 5 ELSE 10 END) * p END AS top, CASE WHEN value < 1 THEN CAST(round(value * 1000) AS BIGINT) || ' ms' WHEN value < 10 THEN printf('%.2f s', value) ELSE printf('%.1f s', value) END AS shown FROM (SELECT event_id, value, CASE WHEN value >= 1000 THEN 1000.0::DOUBLE WHEN value >= 100 THEN 100.0 WHEN value >= 10 THEN 10.0 WHEN value >= 1 THEN 1.0 WHEN value >= 0.1 THEN 0.1 ELSE 0.01 END AS p FROM (SELECT event_id, floor(value) AS value FROM events))")
def nice_scale(spark, sf_dir) -> DataFrame:
    v = F.col("v")
    p = F.when(v >= 1000, 1000.0).when(v >= 100, 100.0).when(v >= 10, 10.0).when(v >= 1, 1.0).when(v >= 0.1, 0.1).otherwise(0.01)
    e = events(spark, sf_dir).select("event_id", F.floor("value").cast("double").alias("v")).withColumn("p", p)
    step = F.when(v <= F.col("p"), 1).when(v <= 2 * F.col("p"), 2).when(v <= 5 * F.col("p"), 5).otherwise(10)
    shown = F.when(v < 1, F.concat(F.round(v * 1000).cast("long").cast("string"), F.lit(" ms"))).when(v < 10, F.format_string("%.2f s", v)).otherwise(F.format_string("%.1f s", v))
    return e.select("event_id", F.when(v <= 0, 1.0).otherwise(step * F.col("p")).alias("top"), shown.alias("shown"))


@query("S22", "SELECT event_id, ts AS at, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 100000")
def metrics_export(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase' AND ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-20'")
    return e.orderBy("ts", "event_id").limit(100_000).select("event_id", F.col("ts").alias("at"), "value")


@query("T22", """WITH e AS (SELECT user_id // 60 AS key, user_id AS room, CAST(day(ts) // 7 AS BIGINT) AS session, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS amount, row_number() OVER (PARTITION BY user_id // 60 ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT *, lag(session) OVER w AS before, lead(i) OVER w AS after FROM e WINDOW w AS (PARTITION BY room ORDER BY i)),
d AS (SELECT p.room, p.i, count(DISTINCT o.room) AS others FROM p LEFT JOIN e o ON o.key = p.key AND o.i > p.i AND (p.after IS NULL OR o.i < p.after) GROUP BY 1, 2),
b AS (SELECT p.*, others >= 8 AS evicted, lag(others >= 8) OVER (PARTITION BY p.room ORDER BY p.i) AS anew FROM p JOIN d USING (room, i)),
l AS (SELECT *, count(*) FILTER (before IS NULL OR before <> session OR anew) OVER (PARTITION BY room ORDER BY i) AS life FROM b),
s AS (SELECT *, kind IN ('click', 'purchase') AS sample, row_number() OVER (PARTITION BY room, life, kind IN ('click', 'purchase') ORDER BY i DESC) <= 3 AS late FROM l)
SELECT key, room, session, CASE WHEN arg_max(evicted, i) THEN 'evicted' WHEN arg_max(after IS NULL, i) THEN 'live' ELSE 'replaced' END AS ended, count(*) FILTER (sample AND late) AS n, CAST(coalesce(sum(amount) FILTER (sample AND late), 0) AS BIGINT) AS total,
 max(amount) FILTER (sample AND late) AS high, count(*) FILTER (kind = 'signup') AS timeouts, count(*) FILTER (kind = 'view') AS silent, CAST(0 AS BIGINT) AS empty, count(*) FILTER (kind = 'error') AS errors FROM s GROUP BY key, room, session, life""")
def live_sessions(spark, sf_dir) -> DataFrame:
    """Sixty rooms of a host, of which it meters eight at a time; a session is a week, of which three samples are kept."""
    kind = F.when(F.col("event_type") == "signup", "timeout").when(F.col("event_type") == "view", "silent").when(F.col("event_type") == "error", "error").otherwise("sample")
    e = events(spark, sf_dir).select(F.floor(F.col("user_id") / 60).alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("user_id").alias("room"), F.floor(F.dayofmonth("ts") / 7).alias("session"), kind.alias("kind"), F.col("cents").alias("amount"))
    return folds.metered(e, 8, 3)


def nested_metrics(spark, sf_dir) -> DataFrame:
    """The event log as a nested Parquet table in the shared folder: latency (A2 (p50, hidden), n), and a payload that no metric reads."""
    e = events(spark, sf_dir)
    return kept(e.select("event_id", F.struct(F.struct(F.col("value").alias("p50"), F.col("cents").alias("hidden")).alias("A2"), F.col("k").alias("n")).alias("latency"), F.struct("props", "event_type").alias("payload")))


@query("P18", "SELECT event_id, value AS latency_p50, k AS latency_n FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def nested_pruning(spark, sf_dir) -> DataFrame:
    """Two leaves of a nested file: the scan reads only them."""
    return nested_metrics(spark, sf_dir).select("event_id", F.col("latency.A2.p50").alias("latency_p50"), F.col("latency.n").alias("latency_n"))
