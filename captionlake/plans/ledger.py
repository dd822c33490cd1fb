"""The versioned ledger as folds over append-only tables: current rows, merges, queues, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import keyed_diff
from ..operators.windows import latest_per_key, missing_numbers
from ..operators import folds
from ..operators.staging import stage
from ..registry import query
from . import recursions
from ..sources.tables import events, table


def ordered():
    """A user's events in order."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("W01 M13", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1")
def current_version(spark, sf_dir) -> DataFrame:
    """The row of the greatest version, by an aggregate and without a sort."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(row).alias("r")).select("l_orderkey", "r.l_linenumber", "r.l_partkey", "r.l_quantity")


@query("W08", "SELECT user_id, event_type, arg_min(value, {'t': ts, 'i': event_id}) AS first_value, arg_max(value, {'t': ts, 'i': event_id}) AS current_value, CAST(greatest(0, floor(epoch(max(ts))) - floor(epoch(min(ts)))) AS BIGINT) AS elapsed_s FROM events GROUP BY 1, 2")
def first_vs_current(spark, sf_dir) -> DataFrame:
    at = F.struct("ts", "event_id")
    elapsed = F.greatest(F.lit(0), F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts")))
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("current_value"), elapsed.alias("elapsed_s"))


@query("W11", "WITH k AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT user_id, unnest(range(min(k), max(k) + 1)) AS k FROM k GROUP BY user_id) SELECT user_id, k FROM r EXCEPT SELECT user_id, k FROM k")
def missing_sequence(spark, sf_dir) -> DataFrame:
    return missing_numbers(events(spark, sf_dir).filter("k IS NOT NULL"), ["user_id"], "k")


@query("A17", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, count(*) OVER (PARTITION BY user_id) + 1 AS next_version FROM events")
def next_version(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id")
    return events(spark, sf_dir).select("user_id", "event_id", F.row_number().over(ordered()).cast("long").alias("version"), (F.count("*").over(w) + 1).alias("next_version"))


@query("M01 S17", """WITH d AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 300),
e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS human, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS text FROM events WHERE user_id NOT IN (SELECT user_id FROM d)),
g AS (SELECT *, coalesce(max(human) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM e),
a AS (SELECT *, lag(text) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM g WHERE human >= had),
v AS (SELECT * FROM a WHERE before IS NULL OR before <> text)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, text, human = 1 AS human, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS is_current FROM v""")
def caption_apply(spark, sf_dir) -> DataFrame:
    """A version for each change of text; a machine never replaces a human, and a deleted caption gets none."""
    e = events(spark, sf_dir)
    dead = e.filter("event_type = 'error' AND value > 300").select("user_id")
    e = e.join(dead, "user_id", "left_anti").withColumns({"human": (F.col("event_type") == "purchase").cast("int"), "text": F.col("k").cast("string")})
    had = F.coalesce(F.max("human").over(ordered().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    allowed = e.withColumn("had", had).filter("human >= had").withColumn("before", F.lag("text").over(ordered())).filter("before IS NULL OR before <> text")
    return allowed.select("user_id", "event_id", F.row_number().over(ordered()).cast("long").alias("version"), "text", (F.col("human") == 1).alias("human"), F.lead("event_id").over(ordered()).isNull().alias("is_current"))


@query("M02", "SELECT event_id, CASE event_type WHEN 'view' THEN 'received' WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'published' WHEN 'error' THEN 'failed' ELSE 'other' END AS status FROM events")
def status_mapping(spark, sf_dir) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in (("view", "received"), ("click", "ready"), ("purchase", "published"), ("error", "failed")) for x in p])
    return events(spark, sf_dir).select("event_id", F.coalesce(F.element_at(names, F.col("event_type")), F.lit("other")).alias("status"))


@query("M03", "SELECT user_id, event_id, before_value, after_value FROM (SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_value, value AS after_value, event_type FROM events) WHERE event_type = 'purchase' AND before_value <> after_value")
def correction_before_after(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).withColumn("before_value", F.lag("value").over(ordered()))
    return e.filter("event_type = 'purchase' AND before_value <> value").select("user_id", "event_id", "before_value", F.col("value").alias("after_value"))


@query("M04 M06", "SELECT user_id, q AS quality, CASE WHEN q >= 3 THEN 'live' WHEN q = 2 THEN 'pending' ELSE 'disabled' END AS state FROM (SELECT user_id, greatest(0, least(5, count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error'))) AS q FROM events GROUP BY 1)")
def tm_quality_state(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    q = F.greatest(F.lit(0), F.least(F.lit(5), F.count_if(kind == "purchase") - F.count_if(kind == "error")))
    return events(spark, sf_dir).groupBy("user_id").agg(q.alias("quality")).withColumn("state", F.when(F.col("quality") >= 3, "live").when(F.col("quality") == 2, "pending").otherwise("disabled"))


@query("M05", recursions.REINFORCED)
def tm_reinforce(spark, sf_dir) -> DataFrame:
    """Fold each unit's events in order: a repeat adds 1 up to 5 from 3 on, an error disables, and a disabled unit stays so."""
    def step(s: dict, r) -> list:
        q = s["quality"]
        if q > 1:
            s["quality"] = 1 if r.event_type == "error" else min(q + 1, 5) if q >= 3 else q
        s["uses"] += 1
        return []

    rows = events(spark, sf_dir).select("user_id", F.pmod("k", F.lit(10)).alias("unit"), F.unix_micros("ts").alias("at"), "event_id", "event_type")
    return folds.ordered_fold(rows, ["user_id", "unit"], ["at", "event_id"], "user_id long, unit long, quality int, uses int", lambda: {"quality": 3, "uses": 0}, step, lambda s, key: [(*key, s["quality"], s["uses"])])


@query("W01", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem WHERE l_returnflag = 'N'),
b AS (SELECT l_partkey, max(l_shipdate) AS base FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT p.l_partkey, p.l_orderkey, p.l_linenumber, CASE WHEN r > 1 THEN 'superseded' WHEN base > l_shipdate THEN 'conflict' ELSE 'approved' END AS state FROM p LEFT JOIN b USING (l_partkey)""")
def staging_conflicts(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    proposed = lines.filter("l_returnflag = 'N'").withColumn("r", F.row_number().over(w))
    base = lines.filter("l_returnflag <> 'N'").groupBy("l_partkey").agg(F.max("l_shipdate").alias("base"))
    state = F.when(F.col("r") > 1, "superseded").when(F.col("base") > F.col("l_shipdate"), "conflict").otherwise("approved")
    return proposed.join(base, "l_partkey", "left").select("l_partkey", "l_orderkey", "l_linenumber", state.alias("state"))


@query("M09", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'held' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'delete' ELSE 'keep' END AS action FROM orders WHERE o_orderstatus <> 'P'")
def retention_due(spark, sf_dir) -> DataFrame:
    action = F.when(F.col("o_orderpriority") == "1-URGENT", "held").when(F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-01-01'"), "delete").otherwise("keep")
    return table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", action.alias("action"))


@query("M10 M16", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def purge_antijoin(spark, sf_dir) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("M16", "SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN md5(d.text) END AS text_md5, t.doc_id IS NOT NULL AS tombstone FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t USING (doc_id)")
def erasure_antijoin(spark, sf_dir) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("gone"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")).join(toxic, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("gone").isNull(), F.col("h")).alias("text_md5"), F.col("gone").isNotNull().alias("tombstone"))


@query("", """WITH j AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS params, max(event_id) AS last, count(*) FILTER (event_type = 'error') AS failed, count(*) AS attempts, arg_max(event_type, event_id) AS state FROM events GROUP BY 1, 2)
SELECT user_id, params, attempts, CASE WHEN state = 'purchase' THEN 'done' WHEN state = 'error' AND failed >= 3 THEN 'failed' WHEN state = 'error' THEN 'retry' WHEN state = 'click' THEN 'running' ELSE 'queued' END AS state FROM j""")
def job_queue_state(spark, sf_dir) -> DataFrame:
    """Jobs of equal parameters are one; its state follows from its last event and its failures."""
    kind = F.col("event_type")
    jobs = events(spark, sf_dir).groupBy("user_id", F.col("k").alias("params")).agg(F.count("*").alias("attempts"), F.count_if(kind == "error").alias("failed"), F.max_by("event_type", "event_id").alias("last"))
    last = F.col("last")
    state = F.when(last == "purchase", "done").when((last == "error") & (F.col("failed") >= 3), "failed").when(last == "error", "retry").when(last == "click", "running").otherwise("queued")
    return jobs.select("user_id", "params", "attempts", state.alias("state"))


@query("M12 J12", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change, a.n AS old_n, b.n AS new_n
FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE user_id % 2 = 0 AND event_type = 'error' GROUP BY 1) a FULL JOIN (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE user_id % 2 = 1 AND event_type = 'signup' GROUP BY 1) b ON a.k = b.k""")
def dry_run_diff(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    count = lambda parity, kind: e.filter((F.col("user_id") % 2 == parity) & (F.col("event_type") == kind)).groupBy("k").agg(F.count("*").alias("n"))
    return keyed_diff(count(0, "error"), count(1, "signup"), ["k"], ["n"])


@query("M14", """SELECT o_orderkey, CAST(to_json({'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority, 'o_custkey': o_custkey}) AS VARCHAR) AS payload FROM orders""")
def revision_snapshots(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct("o_orderstatus", "o_orderpriority", "o_custkey")).alias("payload"))


@query("M15", "SELECT o_orderkey, count(l_orderkey) AS n, count(l_orderkey) = 1 AS ok FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 GROUP BY 1")
def score_writeback_cardinality(spark, sf_dir) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"))
    n = F.coalesce("c", F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(first, "o_orderkey", "left").select("o_orderkey", n.alias("n"), (n == 1).alias("ok"))


@query("S17 T01", "SELECT user_id, arg_max(event_id, {'k': k, 'i': event_id}) AS event_id, max(k) AS version FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def version_guarded_upsert(spark, sf_dir) -> DataFrame:
    """An update applies if its version isn't lower; so the greatest version stays, and of equal ones the last."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", F.struct("k", "event_id")).alias("event_id"), F.max("k").alias("version"))


@query("F34", "SELECT p_partkey, length(p_name) > 25 AS long_name, regexp_matches(p_name, '[\\x00-\\x1f]') AS control, p_brand = '' AS empty_brand FROM part")
def entry_validation(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.length("p_name") > 25).alias("long_name"), F.col("p_name").rlike(r"[\x00-\x1f]").alias("control"), (F.col("p_brand") == "").alias("empty_brand"))


@query("T02", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cursor FROM events")
def monotone_cursor(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", F.row_number().over(ordered()).cast("long").alias("cursor"))


@query("T03", """WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cursor FROM events), kept AS (SELECT * FROM c WHERE event_type <> 'signup'), r AS (SELECT user_id, user_id % 50 AS after FROM events GROUP BY user_id)
SELECT r.user_id, after, count(cursor) FILTER (cursor > after) AS pending, coalesce(min(cursor) FILTER (cursor > after) > after + 1, false) OR after > max(cursor) AS gap FROM r JOIN kept USING (user_id) GROUP BY 1, 2""")
def resume_with_gap(spark, sf_dir) -> DataFrame:
    """What a reader at a cursor still gets, and whether it must take the full state since events are missing."""
    log = events(spark, sf_dir).withColumn("cursor", F.row_number().over(ordered())).filter("event_type <> 'signup'").withColumn("after", F.col("user_id") % 50)
    ahead = F.when(F.col("cursor") > F.col("after"), F.col("cursor"))
    gap = F.coalesce(F.min(ahead) > F.col("after") + 1, F.lit(False)) | (F.col("after") > F.max("cursor"))
    return log.groupBy("user_id", "after").agg(F.count(ahead).alias("pending"), gap.alias("gap"))


@query("T04", "SELECT user_id, max(event_id) AS last, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS expired FROM events GROUP BY 1")
def ttl_expiry(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))  # one row
    per = e.groupBy("user_id").agg(F.max("event_id").alias("last"), F.max("ts").alias("t")).join(F.broadcast(now))
    return per.select("user_id", "last", (F.col("t") < F.col("now") - F.expr("INTERVAL 1 DAY")).alias("expired"))


@query("T05 T34", """WITH c AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events),
l AS (SELECT *, max(epoch) OVER (PARTITION BY user_id) AS latest FROM c), v AS (SELECT * FROM l WHERE epoch = latest AND event_type <> 'signup'),
dead AS (SELECT DISTINCT user_id, k FROM v WHERE event_type = 'error')
SELECT v.user_id, v.k, CAST(max(v.epoch) AS BIGINT) AS epoch, max(event_id) AS event_id FROM v WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.user_id = v.user_id AND dead.k IS NOT DISTINCT FROM v.k) GROUP BY 1, 2""")
def materialised_view(spark, sf_dir) -> DataFrame:
    """Rows of the last epoch (a clear begins one), without deleted ids, which late updates don't bring back."""
    e = events(spark, sf_dir).withColumn("epoch", F.count_if(F.col("event_type") == "signup").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("latest", F.max("epoch").over(Window.partitionBy("user_id"))).filter("epoch = latest AND event_type <> 'signup'")
    rows = e.groupBy("user_id", "k").agg(F.max("epoch").alias("epoch"), F.max("event_id").alias("event_id"), F.bool_or(F.col("event_type") == "error").alias("dead"))
    return rows.filter("NOT dead").drop("dead")


@query("T06", "WITH d AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), n AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS lag FROM d) SELECT user_id, count(*) FILTER (lag = first_lag) AS released, count(*) FILTER (lag <> first_lag) AS held FROM (SELECT *, min(lag) OVER (PARTITION BY user_id) AS first_lag FROM n) GROUP BY 1")
def in_order_release(spark, sf_dir) -> DataFrame:
    """The contiguous prefix of each session's numbers is released, the rest is held."""
    d = events(spark, sf_dir).filter("k IS NOT NULL").select("user_id", "k").distinct()
    d = d.withColumn("lag", F.col("k") - F.row_number().over(Window.partitionBy("user_id").orderBy("k")))
    d = d.withColumn("first_lag", F.min("lag").over(Window.partitionBy("user_id")))
    return d.groupBy("user_id").agg(F.count_if(F.col("lag") == F.col("first_lag")).alias("released"), F.count_if(F.col("lag") != F.col("first_lag")).alias("held"))


@query("T09", "WITH d AS (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), m AS (SELECT user_id, max(k) AS last FROM d GROUP BY 1) SELECT m.user_id, r.k AS hole FROM m, unnest(range(0, last + 1)) AS r(k) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = m.user_id AND d.k = r.k)")
def session_end_holes(spark, sf_dir) -> DataFrame:
    holes = missing_numbers(events(spark, sf_dir).filter("k IS NOT NULL"), ["user_id"], "k", F.lit(0))
    return holes.withColumnRenamed("k", "hole")


@query("T10", "SELECT user_id, k, count(*) AS n, count(DISTINCT event_type) > 1 AS conflict, min(event_id) AS first FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2")
def resubmission(spark, sf_dir) -> DataFrame:
    """The same key and digest is one submission; the same key with another digest is a conflict."""
    digests = F.min("event_type") != F.max("event_type")
    return events(spark, sf_dir).groupBy("user_id", "k").agg(F.count("*").alias("n"), digests.alias("conflict"), F.min("event_id").alias("first"))


@query("", "SELECT event_id, CASE WHEN value > 300 THEN 'timeout' WHEN value > 60 AND lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL THEN 'stale' ELSE 'shown' END AS outcome FROM events")
def late_data_policy(spark, sf_dir) -> DataFrame:
    newer = F.lead("event_id").over(ordered()).isNotNull()
    return events(spark, sf_dir).select("event_id", F.when(F.col("value") > 300, "timeout").when((F.col("value") > 60) & newer, "stale").otherwise("shown").alias("outcome"))


@query("T14", "SELECT user_id, event_type, max(k) AS attempt, count(*) FILTER (k < m) AS discarded FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id, event_type) AS m FROM events) GROUP BY 1, 2")
def attempt_epochs(spark, sf_dir) -> DataFrame:
    per = events(spark, sf_dir).groupBy("user_id", "event_type", "k").agg(F.count("*").alias("n"))
    return per.groupBy("user_id", "event_type").agg(F.max("k").alias("attempt"), (F.sum("n") - F.max_by("n", "k")).alias("discarded"))


@query("", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS demand FROM events")
def rate_demand(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return events(spark, sf_dir).select("event_id", F.count("*").over(w).alias("demand"))


@query("T29", "SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 400)")
def idle_room_sweep(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    busy = e.filter("event_type = 'purchase' AND value > 400").select("user_id")
    now = e.agg(F.max("ts").alias("now"))  # one row
    idle = e.groupBy("user_id").agg(F.max("ts").alias("t")).join(F.broadcast(now)).filter("t < now - INTERVAL 6 HOURS")
    return idle.join(busy, "user_id", "left_anti").select("user_id")


@query("M07", recursions.STAGED)
def staging_audit(spark, sf_dir) -> DataFrame:
    """Proposals of each user's target under both locks, with their audit rows and states."""
    k, kind = F.col("k"), F.col("event_type")
    kinds = F.when(kind == "view", "propose").when(kind == "click", "amend").when(kind == "purchase", "approve").when(kind == "signup", "edit").when(k % 2 == 0, "reject").otherwise("withdraw")
    actor = F.when(kind == "error", F.floor(k / 2) % 2).otherwise(k % 2)
    steps = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), kinds.alias("kind"), (k % 3).alias("text"), actor.alias("actor"), (1 + k % 2).alias("seen"), (k % 5 == 0).alias("override"))
    return stage(steps)
