"""Folds over ordered events, bounded queues and text scrubbing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import loose_key
from ..operators import folds
from ..operators.windows import missing_numbers
from ..registry import query
from . import recursions
from ..sources.tables import events, table


def ordered():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def lines(spark, sf_dir) -> DataFrame:
    """Events as lines of their user: key, at (seconds), id, text."""
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_seconds("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("text"), "value")


@query("F04", "SELECT item_id, translate(lower(text), 'áàâäéèêëíîïóôöúùûüñç', 'aaaaeeeeiiiooouuuunc') AS folded FROM benchmark")
def char_fold(spark, sf_dir) -> DataFrame:
    """Each character becomes one character, so places in the folded text are places in the text."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.translate(F.lower("text"), "áàâäéèêëíîïóôöúùûüñç", "aaaaeeeeiiiooouuuunc").alias("folded"))


@query("F19", """SELECT doc_id, md5(text) AS scrubbed, CASE WHEN doc_id % 5 IN (1, 3) THEN 'degraded' ELSE 'final' END AS status FROM documents""")
def utf8_scrub(spark, sf_dir) -> DataFrame:
    """Bytes that aren't UTF-8 go (half of a surrogate pair too), and a row that loses some is downgraded. Every text gets odd bytes before it or behind it by its number; without them it must be what it was."""
    odd = F.when(F.col("doc_id") % 5 == 1, F.lit(bytes.fromhex("ff"))).when(F.col("doc_id") % 5 == 3, F.lit(bytes.fromhex("eda0bd"))).otherwise(F.lit(b""))
    data = F.when(F.col("doc_id") % 2 == 0, F.concat(odd, F.col("text").cast("binary"))).otherwise(F.concat(F.col("text").cast("binary"), odd))
    rows = table(spark, sf_dir, "documents").select("doc_id", data.cast("string").alias("text"))
    clean, status = X.scrub(F.col("text"), F.lit("final"))
    return rows.select("doc_id", F.md5(clean.cast("binary")).alias("scrubbed"), status.alias("status"))


@query("J06", "SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])nicht([^a-z0-9]|$)') AND lang = 'de'")
def index_hit_join(spark, sf_dir) -> DataFrame:
    """Hits of a word index joined back to their rows, of which only current ones stay."""
    d = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    hits = d.filter(F.contains(F.lower("text"), F.lit("nicht"))).filter(F.array_contains(words, "nicht")).select("doc_id").distinct()
    return d.filter("lang = 'de'").select("doc_id", "source").join(hits, "doc_id", "left_semi")


@query("T11 T37", recursions.queued(8))
def bounded_queue(spark, sf_dir) -> DataFrame:
    """A subscriber's queue of eight: views are put, clicks take, and the oldest goes when it is full."""
    rows = lines(spark, sf_dir).filter("text IN ('view', 'click')")
    return folds.bounded_queue(rows.select("key", "at", "id", (F.col("text") == "view").alias("put")), 8)


@query("T34")
def client_view(spark, sf_dir) -> DataFrame:
    """What each user's client shows: views are captions, clicks drafts, errors delete, signups clear, and the rest expire."""
    k, kind = F.col("k"), F.col("event_type")
    kinds = F.when(kind == "view", "caption").when(kind == "click", "draft").when(kind == "error", "deleted").when(kind == "signup", "cleared").otherwise("expired")
    epoch = F.count_if(kind == "signup").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    e = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), kinds.alias("kind"), k.alias("caption"), (k * 7 % 50).alias("seq"), F.col("cents").alias("version"), epoch.alias("epoch"), (k % 3).alias("ord"), kind.alias("text"))
    return folds.client_view(e, 20)


@query("T13", recursions.carrying("row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id)", "value > 60"))
def merge_carry(spark, sf_dir) -> DataFrame:
    """Lines over 60 are stale and ride along with the next one: two at most, 80 characters, two numbers ahead; a user's lines are one sequence, over any midnight."""
    seq = F.row_number().over(Window.partitionBy("key").orderBy("at", "id"))
    return folds.carry_lines(lines(spark, sf_dir).select("key", seq.alias("seq"), "id", "text", (F.col("value") > 60).alias("stale")))


@query("T21")
def cooled_trigger(spark, sf_dir) -> DataFrame:
    """A user's lines fire once they span an hour; they reach back six hours, cool down for two, and don't repeat ids or texts within a day."""
    return folds.windowed_trigger(lines(spark, sf_dir).select("key", "at", "id", "text"), 3600, 6 * 3600, 2 * 3600, 24 * 3600)


@query("T33", recursions.muting(3600))
def repeat_suppression(spark, sf_dir) -> DataFrame:
    """A line is muted if the last one said had its text, less than an hour ago."""
    return folds.mute_repeats(lines(spark, sf_dir).select("key", "at", "id", "text"), 3600)


@query("T25", "SELECT user_id, CAST(floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(max(ts))) AS BIGINT) AS quiet_s, floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(max(ts))) >= 21600 AS idle FROM events GROUP BY 1")
def idle_gate(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    now = e.agg(F.unix_timestamp(F.max("ts")).alias("now"))  # one row
    per = e.groupBy("user_id").agg(F.unix_timestamp(F.max("ts")).alias("t")).join(F.broadcast(now)).withColumn("quiet_s", F.col("now") - F.col("t"))
    return per.select("user_id", "quiet_s", (F.col("quiet_s") >= 21600).alias("idle"))


NORM = "regexp_replace(lower({}), '[^a-z0-9\\x{{c0}}-\\x{{24f}}]', '', 'g')"


@query("T36", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, {NORM.format('text')} AS a, lag({NORM.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 AND b IS NOT NULL AND a <> b")
def correction_queue(spark, sf_dir) -> DataFrame:
    """The three newest second passes of a session, without those that change no letter or digit."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = loose_key(F.col("text"))
    c = table(spark, sf_dir, "conversations").withColumns({"a": a, "b": F.lag(a).over(w), "r": F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))})
    return c.filter("r <= 3 AND b IS NOT NULL AND a <> b").select("conv_id", "turn")


@query("M08 M17", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'failed: too large' WHEN o_orderstatus = 'P' THEN 'failed: pending' ELSE 'done' END AS result FROM orders ORDER BY o_orderkey LIMIT 40")
def capped_batch_job(spark, sf_dir) -> DataFrame:
    """A job over 40 items at most, with a result for each instead of one for all."""
    result = F.when(F.col("o_totalprice") > 300000, "failed: too large").when(F.col("o_orderstatus") == "P", "failed: pending").otherwise("done")
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(40).select("o_orderkey", result.alias("result"))


@query("T28", recursions.admitting(3600, 3, "CASE WHEN user_id < 100 THEN user_id ELSE -1 END"))
def rate_admission(spark, sf_dir) -> DataFrame:
    """Three admitted hits an hour for each of 100 clients; all others share one allowance."""
    client = F.when(F.col("key") < 100, F.col("key")).otherwise(-1)
    return folds.admit(lines(spark, sf_dir).select(client.alias("key"), "at", "id"), 3600, 3)


@query("A30", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value < 20 ORDER BY ts, event_id) AS g FROM events),
l AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM r WHERE value < 20 GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT user_id, sum(CAST(round(value * 100) AS BIGINT)) AS cents, count(*) AS n, count(*) FILTER (value > 100) AS spikes FROM events GROUP BY 1)
SELECT user_id, coalesce(longest, 0) AS longest, CASE WHEN cents > 6000 * n OR 10 * spikes > n THEN 'background_load' WHEN longest >= 4 THEN 'throttled' ELSE 'ok' END AS status FROM m LEFT JOIN l USING (user_id)""")
def run_stability(spark, sf_dir) -> DataFrame:
    """A run's class: loaded if its mean is over 60 or a tenth of its readings over 100, throttled if four or more in a row are under 20."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    low = F.col("value") < 20
    e = events(spark, sf_dir).withColumn("low", low).withColumn("turned", F.when(low & ~F.coalesce(F.lag(low).over(w), F.lit(False)), 1).otherwise(0))
    e = e.withColumn("run", F.sum("turned").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    longest = e.filter("low").groupBy("user_id", "run").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))
    m = e.groupBy("user_id").agg(F.sum("cents").alias("c"), F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("spikes"))
    status = F.when((F.col("c") > 6000 * F.col("n")) | (10 * F.col("spikes") > F.col("n")), "background_load").when(F.col("longest") >= 4, "throttled").otherwise("ok")
    return m.join(longest, "user_id", "left").select("user_id", F.coalesce("longest", F.lit(0)).alias("longest"), status.alias("status"))


@query("A24", """SELECT p_brand, arg_min(p_partkey, (p_retailprice < 1200 OR p_retailprice > 1600, abs(p_retailprice - 1400), p_partkey)) AS p_partkey, NOT bool_or(p_retailprice BETWEEN 1200 AND 1600) AS outside FROM part GROUP BY 1""")
def closest_to_target(spark, sf_dir) -> DataFrame:
    """The row in the target range that is closest to its middle, else the closest of all, with a note."""
    x = F.col("p_retailprice")
    inside = (x >= 1200) & (x <= 1600)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(~inside, F.abs(x - 1400), "p_partkey")).alias("p_partkey"), (~F.max(inside)).alias("outside"))


@query("M14", """SELECT conv_id, turn, md5('{"turn":' || p || ',"role":' || to_json(r) || ',"text":' || to_json(t) || '}') AS before FROM (SELECT conv_id, turn, text, lag(turn) OVER w AS p, lag(role) OVER w AS r, lag(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE p IS NOT NULL AND t <> text""")
def revisions_before_change(spark, sf_dir) -> DataFrame:
    """The whole payload that a change replaces, as JSON, for each change: lines of a session stand for its versions."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations")
    before = F.to_json(F.struct(F.lag("turn").over(w).alias("turn"), F.lag("role").over(w).alias("role"), F.lag("text").over(w).alias("text")))
    changed = c.select("conv_id", "turn", "text", before.alias("b"), F.lag("text").over(w).alias("t")).filter("t IS NOT NULL AND t <> text")
    return changed.select("conv_id", "turn", F.md5(F.col("b").cast("binary")).alias("before"))


@query("T35", """WITH s AS (SELECT l_orderkey, l_linenumber AS seq, l_partkey AS version FROM lineitem WHERE l_quantity > 15),
g AS (SELECT l_orderkey, max(version) AS version_floor, min(seq) AS oldest, max(seq) AS newest, list(DISTINCT seq) AS seen FROM s GROUP BY 1)
SELECT l_orderkey, version_floor, CAST(newest + 1 AS BIGINT) AS next, list_sort(list_filter(range(oldest, newest), lambda x: NOT list_contains(seen, x))) AS holes FROM g""")
def state_recovery(spark, sf_dir) -> DataFrame:
    """What a restarted session must know: the floor of versions, the next number, and holes from the oldest kept number on, told by gaps between neighbours."""
    s = table(spark, sf_dir, "lineitem").filter("l_quantity > 15").select("l_orderkey", F.col("l_linenumber").cast("long").alias("seq"), F.col("l_partkey").alias("version"))
    g = s.groupBy("l_orderkey").agg(F.max("version").alias("version_floor"), (F.max("seq") + 1).alias("next"))
    holes = missing_numbers(s, ["l_orderkey"], "seq").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("seq")).alias("holes"))
    return g.join(holes, "l_orderkey", "left").select("l_orderkey", "version_floor", "next", F.coalesce("holes", F.array().cast("array<bigint>")).alias("holes"))


@query("T16")
def endpoint_cuts(spark, sf_dir) -> DataFrame:
    """A user's events as frames whose levels are their values: utterances by pauses, soft and hard cuts, and the flush."""
    frames = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), (F.col("value") / 2000).alias("level"))
    return folds.utterances(frames, folds.ENDPOINTS | {"soft": 20, "hard": 30, "back": 8})
