"""Filters, joins, set operations, pagination and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import latest_per_key, within_budget
from ..registry import query
from ..sources.tables import events, select_or_null, table


def where_all(df: DataFrame, **filters) -> DataFrame:
    """Each argument that isn't None adds a condition."""
    for column, value in filters.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


@query("P01", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def optional_filters(spark, sf_dir) -> DataFrame:
    return where_all(table(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_totalprice")


@query("P02", "SELECT p_partkey FROM part WHERE p_name ILIKE '%re%' OR p_type ILIKE '%brass%'")
def substring_match(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("%re%") | F.col("p_type").ilike("%brass%")).select("p_partkey")


@query("P03", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1-%' GROUP BY 1")
def prefix_match(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1-")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("P04", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT DISTINCT FROM NULL")
def null_safe_match(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.filter(F.col("quality").eqNullSafe(F.lit(None))).select("doc_id")


@query("P05", "SELECT doc_id, source FROM documents WHERE lang = 'en' OR source = 'src1'")
def row_visibility(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter((F.col("lang") == "en") | (F.col("source") == "src1")).select("doc_id", "source")


@query("P06 J03 P08 X08", """SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'b' THEN 0 WHEN p_brand = 'b' THEN 1 ELSE 2 END AS rank FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey
WHERE lower(p_name) >= 'b' AND lower(p_name) < 'b' || chr(65535) ORDER BY rank, p_name, p_partkey LIMIT 20""")
def prefix_range_lookup(spark, sf_dir) -> DataFrame:
    word = F.lower("p_name")
    hits = table(spark, sf_dir, "part").filter((word >= "b") & (word < "b￿")).join(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    rank = F.when(word == "b", 0).when(F.col("p_brand") == "b", 1).otherwise(2)
    return hits.select("p_partkey", "p_name", rank.alias("rank")).orderBy("rank", "p_name", "p_partkey").limit(20)


@query("P07", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src1', 'src2', 'src3')")
def in_list(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("lang").isin("de", "fr") & F.col("source").isin("src1", "src2", "src3")).select("doc_id")


@query("P09", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error' AND value <= 200")
def audience_view(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).filter((F.col("event_type") != "error") & (F.col("value") <= 200)).select("event_id", "user_id", "event_type")


@query("P10", r"SELECT page_id, regexp_replace(url, '([?&](?:token|key|id|p)=)[^&]*', '\1***', 'g') AS url FROM pages")
def secret_masking(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"([?&](?:token|key|id|p)=)[^&]*", "$1***").alias("url"))


@query("P13", "SELECT conv_id, turn FROM conversations WHERE role <> 'system' OR text <> ''")
def status_override(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter((F.col("role") != "system") | (F.col("text") != "")).select("conv_id", "turn")


@query("P14", "SELECT json_extract_string(props, '$.k') AS k, json_valid(props) AS ok, count(*) AS n FROM events GROUP BY 1, 2")
def json_validity(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("ok"))
    return e.groupBy("k", "ok").agg(F.count("*").alias("n"))


@query("P15 M10", "SELECT event_id, user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'error' AND t.user_id = e.user_id AND t.value > 90)")
def tombstone_suppression(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    dead = e.filter("event_type = 'error' AND value > 90").select("user_id")
    return e.join(dead, "user_id", "left_anti").select("event_id", "user_id")


@query("P16 P17", "SELECT event_id, CASE WHEN isfinite(value) AND value BETWEEN 0 AND 60 THEN value END AS sample FROM events")
def numeric_cleaning(spark, sf_dir) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", F.when(~F.isnan(v) & v.between(0, 60), v).alias("sample"))


@query("J01 W01 P12", """SELECT o.o_orderkey, c.c_name, n.n_name, l.l_linenumber, l.l_quantity FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_quantity) = 1) l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'O'""")
def inner_join_chain(spark, sf_dir) -> DataFrame:
    line = latest_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")])
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "c_name", "n_name", "l_linenumber", "l_quantity")


@query("J02", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'")
def left_join_current_view(spark, sf_dir) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "P"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("J04 X10", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 16 AS BIGINT) AS batch FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_batches(spark, sf_dir) -> DataFrame:
    """Batches of 16 in key order. Ranges of keys are counted first, so no task sorts the whole table."""
    todo = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    ranged = todo.withColumn("part", F.floor(F.col("doc_id") / 4096))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) - 1
    return ranged.join(starts, "part").select("doc_id", F.floor(place / 16).alias("batch"))


@query("J04", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)")
def anti_pending(spark, sf_dir) -> DataFrame:
    bad = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(bad, "s_suppkey", "left_anti").select("s_suppkey")


@query("J05", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) AND o_orderdate >= TIMESTAMP '1995-01-01'")
def semi_in_subquery(spark, sf_dir) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'").join(hits, "o_orderkey", "left_semi").select("o_orderkey")


@query("J07 W05", "SELECT user_id, coalesce(min(nullif(k, 0)), min(event_id)) AS ord, count(*) AS n FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def session_ordinal(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.coalesce(F.min(F.nullif("k", F.lit(0))), F.min("event_id")).alias("ord"), F.count("*").alias("n"))


@query("J08", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer")
def correlated_count(spark, sf_dir) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.min("o_orderdate").alias("first_order"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "first_order")


@query("J14", "SELECT DISTINCT l_orderkey AS orphan FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphan_sweep(spark, sf_dir) -> DataFrame:
    known = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("orphan"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orphan")).join(known, "orphan", "left_anti").distinct()


@query("J19", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') ORDER BY length(n_name) DESC, n_nationkey")
def per_language_terms(spark, sf_dir) -> DataFrame:
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter(F.col("r_name").isin("ASIA", "EUROPE"))
    return j.orderBy(F.desc(F.length("n_name")), "n_nationkey").select("n_nationkey", "n_name", "r_name")


@query("U01", "SELECT doc_id, 'index' AS via FROM documents WHERE text LIKE '%with%' AND lang = 'en' UNION ALL SELECT doc_id, 'scan' FROM documents WHERE lang <> 'en' AND contains(text, 'und')")
def union_all_fallback(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = d.filter((F.col("lang") == "en") & F.col("text").contains("with")).select("doc_id", F.lit("index").alias("via"))
    return a.unionByName(d.filter((F.col("lang") != "en") & F.col("text").contains("und")).select("doc_id", F.lit("scan").alias("via")))


@query("U02", "SELECT DISTINCT source, lang FROM documents")
def distinct_rooms(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@query("U03", "SELECT 'doc' AS origin, doc_id AS id, lang AS tag, length(text) AS size FROM documents UNION ALL SELECT 'turn', conv_id, role, length(text) FROM conversations UNION ALL SELECT 'phrase', item_id, NULL, length(text) FROM benchmark")
def heterogeneous_union(spark, sf_dir) -> DataFrame:
    size = F.length("text").cast("long").alias("size")
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("origin"), F.col("doc_id").alias("id"), F.col("lang").alias("tag"), size)
    c = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("origin"), F.col("conv_id").alias("id"), F.col("role").alias("tag"), size)
    b = table(spark, sf_dir, "benchmark").select(F.lit("phrase").alias("origin"), F.col("item_id").alias("id"), size)
    return d.unionByName(c).unionByName(b, allowMissingColumns=True)


@query("U04", "SELECT o_custkey AS id, 'only_orders' AS side FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) UNION ALL SELECT c_custkey, 'only_customers' FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'both' FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def set_algebra(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(o.subtract(c), "only_orders").union(side(c.subtract(o), "only_customers")).union(side(c.intersect(o), "both"))


@query("S04", "SELECT conv_id AS session, turn AS seq, text, CAST(NULL AS DOUBLE) AS t0, CAST(NULL AS VARCHAR) AS lang FROM conversations UNION ALL SELECT doc_id, 0, text, NULL, lang FROM documents")
def layout_adaptive_scan(spark, sf_dir) -> DataFrame:
    layout = {"session": "bigint", "seq": "bigint", "text": "string", "t0": "double", "lang": "string"}
    a = table(spark, sf_dir, "conversations").withColumnsRenamed({"conv_id": "session", "turn": "seq"})
    b = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "session").withColumn("seq", F.lit(0))
    return select_or_null(a, layout).unionByName(select_or_null(b, layout))


@query("S02", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'")
def parameterised_query(spark, sf_dir) -> DataFrame:
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 100000, "status": "F"}, orders=table(spark, sf_dir, "orders"))


@query("L01", "SELECT event_id, value FROM events WHERE (value, event_id) > (50.0, 1000) ORDER BY value, event_id LIMIT 21")
def keyset_page(spark, sf_dir) -> DataFrame:
    after = (F.col("value") > 50.0) | ((F.col("value") == 50.0) & (F.col("event_id") > 1000))
    return events(spark, sf_dir).filter(after).orderBy("value", "event_id").limit(21).select("event_id", "value")


@query("L02", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey) = 1")
def top1_by_composite(spark, sf_dir) -> DataFrame:
    best = F.max_by(F.struct("p_partkey", "p_retailprice"), F.struct("p_retailprice", "p_size", -F.col("p_partkey"))).alias("b")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best).select("p_brand", "b.*")


@query("L03", "SELECT p_type, count(*) AS n, (SELECT count(*) FROM part) AS total FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def topn_with_total(spark, sf_dir) -> DataFrame:
    per = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))  # one row
    return per.orderBy(F.desc("n"), "p_type").limit(10).join(F.broadcast(total))


@query("L04", "SELECT conv_id, turn, CASE WHEN before + n > 2400 THEN 2400 - before ELSE n END AS taken FROM (SELECT conv_id, turn, least(length(text), 240) AS n, coalesce(sum(least(length(text), 240)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM conversations) WHERE before < 2400")
def greedy_char_budget(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("n", F.least(F.length("text"), F.lit(240)).cast("long"))
    t = within_budget(t, ["conv_id"], [F.col("turn")], F.col("n"), 2400, after=False)
    return t.select("conv_id", "turn", F.least(F.col("n"), 2400 - F.col("before")).alias("taken"))


@query("L05", "SELECT conv_id, turn FROM (SELECT *, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM conversations) WHERE upto <= 2000 OR role = 'system'")
def byte_budget_newest(spark, sf_dir) -> DataFrame:
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("upto", upto).filter("upto <= 2000 OR role = 'system'").select("conv_id", "turn")


@query("L07", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def priority_claim(spark, sf_dir) -> DataFrame:
    due = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP_NTZ '1997-01-01'")
    return due.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(1).select("o_orderkey", "o_orderpriority")


@query("L08", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 32")
def cap_eviction(spark, sf_dir) -> DataFrame:
    return latest_per_key(events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 32).select("event_id", "user_id")


@query("W07", "SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def preceding_k_context(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), ",").alias("context"))


@query("S21", "SELECT doc_id, CASE WHEN left(text, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || text ELSE text END AS cell FROM documents")
def csv_guard(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.substring(t, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), t)).otherwise(t).alias("cell"))


@query("F42", "SELECT l_orderkey, l_linenumber, least(3600, 5 * CAST(pow(2, l_linenumber - 1) AS BIGINT)) AS delay FROM lineitem")
def retry_backoff(spark, sf_dir) -> DataFrame:
    delay = F.least(F.lit(3600), 5 * F.pow(F.lit(2), F.col("l_linenumber") - 1).cast("long"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", delay.alias("delay"))
