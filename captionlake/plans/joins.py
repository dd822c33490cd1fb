"""Theta joins as equi-joins, as-of lookups, diffs and pairings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import any_of, as_of, containment, interval_overlap, keyed_diff
from ..operators.terms import matched, missing_locked, prompt_terms
from ..registry import query
from ..sources.tables import events, table

#: Terms: words of the phrases in benchmark with five letters or more.
TERMS_SQL = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark"


def terms(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]{6,}', 0)")).alias("term")).distinct()


@query("J09", f"WITH t AS ({TERMS_SQL}) SELECT term, count(*) AS docs FROM documents JOIN t ON contains(lower(text), term) GROUP BY 1")
def containment_term_hits(spark, sf_dir) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    return containment(texts, terms(spark, sf_dir), "text", "term").groupBy("term").agg(F.count("*").alias("docs"))


@query("A10", f"""WITH t AS ({TERMS_SQL}), p AS (SELECT a.conv_id, a.turn, lower(a.text) AS src, lower(b.text) AS tgt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
h AS (SELECT term, contains(tgt, term) AS hit FROM p JOIN t ON contains(src, term))
SELECT term, count(*) AS segments, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS omissions, CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS rate FROM h GROUP BY 1""")
def term_hit_rate(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    src = c.filter("role = 'user'").select("conv_id", "turn", F.lower("text").alias("src"))
    tgt = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("tgt"))
    hits = containment(src.join(tgt, ["conv_id", "turn"]), terms(spark, sf_dir), "src", "term").withColumn("hit", F.contains("tgt", "term"))
    n = F.count_if("hit")
    return hits.groupBy("term").agg(F.count("*").alias("segments"), n.alias("hits"), F.count_if(~F.col("hit")).alias("omissions"), (n.cast("double") / F.count("*")).alias("rate"))


@query("J10", "SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey OR s.s_suppkey = n.n_nationkey OR s.s_suppkey % 7 = n.n_regionkey")
def scope_join(spark, sf_dir) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation")
    conditions = [F.col("s_suppkey") % 7 == F.col("n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"), F.col("s_suppkey") == F.col("n_nationkey")]
    return any_of(s, n, conditions, ["s_suppkey"], ["n_nationkey"]).select("s_suppkey", "n_nationkey")


SPANS = "SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t0, floor(epoch(ts))::BIGINT + 600 + (event_id % 7) * 300 AS t1 FROM events WHERE event_type = '{}'"


def spans(spark, sf_dir, kind: str, prefix: str) -> DataFrame:
    t0 = F.unix_timestamp("ts")
    return events(spark, sf_dir).filter(F.col("event_type") == kind).select(F.col("event_id").alias(f"{prefix}_id"), "user_id", t0.alias(f"{prefix}0"), (t0 + 600 + F.col("event_id") % 7 * 300).alias(f"{prefix}1"))


@query("J11", f"SELECT a.event_id AS a_id, max(b.t1) AS done, count(*) AS n FROM ({SPANS.format('click')}) a JOIN ({SPANS.format('view')}) b ON a.user_id = b.user_id AND b.t0 < a.t1 AND b.t1 > a.t0 GROUP BY 1")
def interval_overlap_join(spark, sf_dir) -> DataFrame:
    pairs = interval_overlap(spans(spark, sf_dir, "click", "a"), spans(spark, sf_dir, "view", "b"), ["user_id"], ("a0", "a1"), ("b0", "b1"), 3600)
    return pairs.groupBy("a_id").agg(F.max("b1").alias("done"), F.count("*").alias("n"))


@query("T26", f"SELECT a.event_id AS a_id FROM ({SPANS.format('click')}) a WHERE NOT EXISTS (SELECT 1 FROM ({SPANS.format('error')}) b WHERE a.user_id = b.user_id AND b.t0 < a.t1 AND b.t1 > a.t0)")
def interval_exclusion(spark, sf_dir) -> DataFrame:
    a = spans(spark, sf_dir, "click", "a")
    hit = interval_overlap(a, spans(spark, sf_dir, "error", "b"), ["user_id"], ("a0", "a1"), ("b0", "b1"), 3600).select("a_id")
    return a.join(hit, "a_id", "left_anti").select("a_id")


@query("J12", "SELECT coalesce(c_custkey, s_suppkey) AS id, CASE WHEN c_custkey IS NULL THEN 'added' WHEN s_suppkey IS NULL THEN 'removed' WHEN c_nationkey = s_nationkey THEN 'same' ELSE 'changed' END AS change, c_nationkey AS old_nation, s_nationkey AS new_nation FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def full_outer_diff(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return keyed_diff(c, s, ["id"], ["nation"])


@query("J13", "SELECT c.event_id, v.event_id AS state_id, v.value AS state FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON c.user_id = v.user_id AND c.ts >= v.ts")
def asof_last_state(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    v = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("state_id"), F.max_by("value", "event_id").alias("state"))
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    return as_of(clicks, v, ["user_id"], "ts", ["state_id", "state"]).select("event_id", "state_id", "state")


@query("J15 A20", """WITH r AS (SELECT l_partkey AS item, l_suppkey AS rater, min(l_returnflag) AS vote FROM lineitem GROUP BY 1, 2)
SELECT a.rater AS r1, b.rater AS r2, count(*) AS comparable, count(*) FILTER (a.vote = b.vote) AS matched, CAST(count(*) FILTER (a.vote = b.vote) AS DOUBLE) / count(*) AS agreement FROM r a JOIN r b ON a.item = b.item AND a.rater < b.rater GROUP BY 1, 2""")
def pair_agreement(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("rater")).agg(F.min("l_returnflag").alias("vote"))
    a, b = (r.withColumnsRenamed({"rater": f"r{i}", "vote": f"v{i}"}) for i in (1, 2))
    pairs = a.join(b, "item").filter("r1 < r2")
    m = F.count_if(F.col("v1") == F.col("v2"))
    return pairs.groupBy("r1", "r2").agg(F.count("*").alias("comparable"), m.alias("matched"), (m.cast("double") / F.count("*")).alias("agreement"))


@query("J16 T23", """WITH s AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1, 2), f AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS t FROM events WHERE event_type = 'click')
SELECT s.user_id, s.k, CAST(floor(epoch(min(f.t))) - floor(epoch(any_value(s.t))) AS BIGINT) AS latency_s FROM s JOIN f ON s.user_id = f.user_id AND s.k = f.k AND f.t >= s.t GROUP BY 1, 2""")
def start_stop_latency(spark, sf_dir) -> DataFrame:
    """The first start of a key counts, and the first stop after it closes it."""
    e = events(spark, sf_dir)
    start = e.filter("event_type = 'view'").groupBy("user_id", "k").agg(F.min("ts").alias("t0"))
    stop = e.filter("event_type = 'click'").select("user_id", "k", F.col("ts").alias("t1"))
    return start.join(stop, ["user_id", "k"]).filter("t1 >= t0").groupBy("user_id", "k").agg((F.unix_timestamp(F.min("t1")) - F.unix_timestamp(F.min("t0"))).alias("latency_s"))


@query("J17 A18", """SELECT model, dim, count(*) AS n, CAST(sum(score) AS DOUBLE) / count(*) AS mean FROM (
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS model, 'quantity' AS dim, CAST(l_quantity AS BIGINT) AS score FROM lineitem UNION ALL SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'b' ELSE 'a' END, 'size', l_suppkey % 5 FROM lineitem) GROUP BY 1, 2""")
def unblinding(spark, sf_dir) -> DataFrame:
    """Scores by position of the sheet, moved to models by the key of positions."""
    sheet = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_suppkey") % 5).alias("size"))
    long = sheet.unpivot(["l_linenumber"], ["quantity", "size"], "dim", "score").withColumn("parity", F.col("l_linenumber") % 2)
    key = spark.createDataFrame([(0, "quantity", "a"), (1, "quantity", "b"), (0, "size", "b"), (1, "size", "a")], "parity int, dim string, model string")
    return long.join(F.broadcast(key), ["parity", "dim"]).groupBy("model", "dim").agg(F.count("*").alias("n"), (F.sum("score").cast("double") / F.count("*")).alias("mean"))


@query("J18", "SELECT p_size, s_nationkey, CAST(z AS INTEGER) AS z, CAST(row_number() OVER (PARTITION BY p_size ORDER BY s_nationkey, z) AS BIGINT) AS run FROM (SELECT DISTINCT p_size FROM part) a, (SELECT DISTINCT s_nationkey FROM supplier) b, (VALUES (5), (6), (7)) c(z) QUALIFY run <= 12")
def parameter_grid(spark, sf_dir) -> DataFrame:
    """The product of short lists of parameters, twelve runs at most for each size: the lists are arrays of distinct values, so no join makes pairs."""
    lists = table(spark, sf_dir, "supplier").agg(F.array_sort(F.collect_set("s_nationkey")).alias("b"))  # nations: 25 at most
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    grid = sizes.join(F.broadcast(lists)).select("p_size", F.explode("b").alias("s_nationkey")).select("p_size", "s_nationkey", F.explode(F.array(F.lit(5), F.lit(6), F.lit(7))).alias("z"))
    w = Window.partitionBy("p_size").orderBy("s_nationkey", "z")
    return grid.withColumn("run", F.row_number().over(w).cast("long")).filter("run <= 12")


@query("A27", """WITH m AS (SELECT event_type, user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (ts < TIMESTAMP '2024-01-15') AS BIGINT) AS old, CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (ts >= TIMESTAMP '2024-01-15') AS BIGINT) AS new FROM events GROUP BY 1, 2)
SELECT event_type, user_id, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN 10 * (new - old) > old THEN CASE WHEN event_type = 'purchase' THEN 'improvement' ELSE 'regression' END WHEN 10 * (old - new) > old THEN CASE WHEN event_type = 'purchase' THEN 'regression' ELSE 'improvement' END ELSE 'unchanged' END AS verdict FROM m""")
def regression_diff(spark, sf_dir) -> DataFrame:
    """A change beyond ten percent is better or worse by the direction of its metric."""
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    m = events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.sum(F.when(early, F.col("cents"))).alias("old"), F.sum(F.when(~early, F.col("cents"))).alias("new"))
    up = F.col("event_type") == "purchase"
    old, new = F.col("old"), F.col("new")
    verdict = (
        F.when(old.isNull(), "added").when(new.isNull(), "removed").when(10 * (new - old) > old, F.when(up, "improvement").otherwise("regression"))
        .when(10 * (old - new) > old, F.when(up, "regression").otherwise("improvement")).otherwise("unchanged")
    )
    return m.select("event_type", "user_id", verdict.alias("verdict"))


@query("A28", "SELECT name, t.actual, CAST(e.expected AS BIGINT) AS expected, t.actual = e.expected AS ok FROM (SELECT 'nation' AS name, count(*) AS actual FROM nation UNION ALL SELECT 'region', count(*) FROM region) t FULL JOIN (VALUES ('nation', 25), ('region', 6)) e(name, expected) USING (name)")
def row_count_reconciliation(spark, sf_dir) -> DataFrame:
    actual = reduce(DataFrame.union, [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("actual")) for t in ("nation", "region")])
    expected = spark.createDataFrame([("nation", 25), ("region", 6)], "name string, expected long")
    return actual.join(expected, "name", "full").select("name", "actual", "expected", (F.col("actual") == F.col("expected")).alias("ok"))


@query("A32", "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS required, list_filter([CASE WHEN sum(CAST(round(value * 100) AS BIGINT)) > 300000 THEN 'over' END, CASE WHEN bool_or(event_type = 'error') AND NOT bool_or(event_type = 'signup') THEN 'pair' END], lambda x: x IS NOT NULL) AS errors FROM events GROUP BY 1")
def budget_check(spark, sf_dir) -> DataFrame:
    kind, total = F.col("event_type"), F.sum("cents")
    rules = F.array(F.when(total > 300000, "over"), F.when(F.bool_or(kind == "error") & ~F.bool_or(kind == "signup"), "pair"))
    return events(spark, sf_dir).groupBy("user_id").agg(total.alias("required"), rules.alias("e")).select("user_id", "required", F.array_compact("e").alias("errors"))


@query("A34", """WITH c AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (n > 1) AS duplicated, CAST(max(k) - min(k) + 1 - count(*) AS BIGINT) AS missing, min(k) AS low, max(k) AS high FROM c GROUP BY 1""")
def integrity_checks(spark, sf_dir) -> DataFrame:
    per = events(spark, sf_dir).groupBy("user_id", "k").agg(F.count("*").alias("n"))
    return per.groupBy("user_id").agg(F.count_if(F.col("n") > 1).alias("duplicated"), (F.max("k") - F.min("k") + 1 - F.count("*")).alias("missing"), F.min("k").alias("low"), F.max("k").alias("high"))


@query("A29", """SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN text = '' THEN 'empty' END, CASE WHEN length(text) > 5000 THEN 'long' END, CASE WHEN contains(text, '  ') THEN 'spaces' END, CASE WHEN regexp_matches(text, '[#*$%&|]') THEN 'symbols' END], lambda x: x IS NOT NULL)) AS rule FROM documents) GROUP BY 1""")
def rule_violations(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    rules = F.array(F.when(t == "", "empty"), F.when(F.length(t) > 5000, "long"), F.when(t.contains("  "), "spaces"), F.when(t.rlike("[#*$%&|]"), "symbols"))
    return table(spark, sf_dir, "documents").select(F.explode(F.array_compact(rules)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("", """WITH g AS (SELECT p_partkey AS id, lower(p_name) AS canon, lower(p_brand) AS alias FROM part)
SELECT id, 'alias_owners' AS rule FROM g WHERE alias IN (SELECT alias FROM g GROUP BY 1 HAVING count(DISTINCT canon) > 1) UNION ALL SELECT id, 'duplicate' FROM g WHERE canon IN (SELECT canon FROM g GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT id, 'alias_is_canon' FROM g WHERE alias = canon""")
def glossary_violations(spark, sf_dir) -> DataFrame:
    g = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("canon"), F.lower("p_brand").alias("alias"))
    owners = g.groupBy("alias").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).filter("a <> b").select("alias")
    twice = g.groupBy("canon").agg(F.count("*").alias("n")).filter("n > 1").select("canon")
    name = lambda df, rule: df.select("id", F.lit(rule).alias("rule"))
    return name(g.join(owners, "alias", "left_semi"), "alias_owners").union(name(g.join(twice, "canon", "left_semi"), "duplicate")).union(name(g.filter("alias = canon"), "alias_is_canon"))


GLOSSARY = "SELECT DISTINCT w AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}'))[:4] FROM benchmark)"


@query("F23", f"""WITH t AS ({GLOSSARY}), p AS (SELECT string_agg(term, '|' ORDER BY length(term) DESC, term) AS p FROM t),
f AS (SELECT conv_id, turn, lead(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS next, regexp_extract_all(lower(text), p) AS found FROM conversations, p),
c AS (SELECT *, list_concat(found, flatten(coalesce(list(found) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []))) AS l FROM f)
SELECT conv_id, turn, array_to_string(found, ' ') AS found, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[:40], ' ') AS prompt,
  array_to_string(list_sort(list_filter(list_distinct(found), lambda x: length(x) % 2 = 0 AND NOT coalesce(regexp_matches(next, '\\b' || x || '\\b'), false))), ' ') AS missing FROM c""")
def glossary_matches(spark, sf_dir) -> DataFrame:
    """Terms of each turn, leftmost and longest, its prompt's terms from four turns back, and locked terms (of an even length) that the next turn lacks as a word."""
    words = F.expr("regexp_extract_all(lower(text), '[a-z]{4,}', 0)")
    long = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("term"))
    g = long.unionByName(long.select(F.left("term", F.lit(4)).alias("term"))).distinct().select("term", F.col("term").alias("target"), (F.length("term") % 2 == 0).alias("locked"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("t"), F.lead(F.lower("text")).over(w).alias("next"))
    found = prompt_terms(matched(lines, g, ["conv_id", "turn"], "t", "term"), ["conv_id"], "turn")
    lost = missing_locked(found, g, ["conv_id", "turn"], "next").groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("missing"))
    return found.join(lost, ["conv_id", "turn"], "left").select("conv_id", "turn", F.array_join("found", " ").alias("found"), F.array_join("prompt", " ").alias("prompt"), F.coalesce("missing", F.lit("")).alias("missing"))
