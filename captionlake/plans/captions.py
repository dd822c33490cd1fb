"""Caption timing, lint, export and evaluation. Turns of conversations stand for captions: a turn begins every five seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions import sequences as Q
from ..functions import text as X
from ..operators import folds
from ..operators.windows import islands
from ..registry import query
from . import recursions
from ..sources.tables import events, table

CUES = "SELECT conv_id, turn, role, text, turn * 5000 AS t0, CASE WHEN turn % 3 = 0 THEN turn * 5000 + 4000 + (length(text) % 4) * 1000 END AS t1 FROM conversations"


def cues(spark, sf_dir) -> DataFrame:
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").withColumns({"t0": t * 5000, "t1": F.when(t % 3 == 0, t * 5000 + 4000 + F.length("text") % 4 * 1000)})


def in_session():
    return Window.partitionBy("conv_id").orderBy("turn")


@query("W02 F14 A22", f"""WITH c AS ({CUES}), d AS (SELECT role, (length(text) - 0.5 * length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g'))) / (coalesce(t1 - t0, lead(t0) OVER (PARTITION BY conv_id ORDER BY turn) - t0, 3000) / 1000.0) AS cps FROM c)
SELECT role, count(*) AS n, count(*) FILTER (cps > 17) AS fast, round(max(cps), 6) AS max, round(quantile_cont(cps, 0.5), 6) AS p50, round(quantile_cont(cps, 0.9), 6) AS p90 FROM d GROUP BY 1""")
def reading_speed(spark, sf_dir) -> DataFrame:
    """A cue lasts to its end, else to the next one's start, else three seconds."""
    lasts = F.coalesce(F.col("t1") - F.col("t0"), F.lead("t0").over(in_session()) - F.col("t0"), F.lit(3000))
    c = cues(spark, sf_dir).withColumn("cps", X.half_width(F.col("text")) / (lasts / 1000.0))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("cps") > 17).alias("fast"), F.round(F.max("cps"), 6).alias("max"), *[F.round(F.percentile("cps", q), 6).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9))])


@query("W03 F30", f"""WITH c AS ({CUES}), l AS (SELECT *, lag(coalesce(t1, t0 + 3000)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM c)
SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN t0 < before THEN 'overlap' END, CASE WHEN t1 IS NULL THEN 'no_end' END, CASE WHEN length(text) > 200 THEN 'long_line' END, CASE WHEN t1 - t0 > 6000 THEN 'too_long' END], lambda x: x IS NOT NULL)) AS rule FROM l) GROUP BY 1""")
def lint_violations(spark, sf_dir) -> DataFrame:
    before = F.lag(F.coalesce("t1", F.col("t0") + 3000)).over(in_session())
    c = cues(spark, sf_dir).withColumn("before", before)
    rules = F.array(F.when(F.col("t0") < F.col("before"), "overlap"), F.when(F.col("t1").isNull(), "no_end"), F.when(F.length("text") > 200, "long_line"), F.when(F.col("t1") - F.col("t0") > 6000, "too_long"))
    return c.select(F.explode(F.array_compact(rules)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("W04", f"""WITH c AS ({CUES}), s AS (SELECT conv_id % 10 AS room, conv_id, max(coalesce(t1, t0 + 3000)) AS last FROM c GROUP BY 1, 2) SELECT room, conv_id, CAST(coalesce(sum(last) OVER (PARTITION BY room ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s""")
def timeline_offsets(spark, sf_dir) -> DataFrame:
    """A session begins where the ones before it in its room end."""
    s = cues(spark, sf_dir).groupBy((F.col("conv_id") % 10).alias("room"), "conv_id").agg(F.max(F.coalesce("t1", F.col("t0") + 3000)).alias("last"))
    before = Window.partitionBy("room").orderBy("conv_id").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("room", "conv_id", F.coalesce(F.sum("last").over(before), F.lit(0)).alias("start"))


@query("W09", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WHERE value > 20), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first FROM i GROUP BY 1, 2 HAVING count(*) >= 2")
def islands_of_activity(spark, sf_dir) -> DataFrame:
    """Runs of events over a threshold with gaps of two hours at most and two events at least."""
    e = events(spark, sf_dir).filter("value > 20").withColumn("us", F.unix_micros("ts"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("gap", F.col("us") - F.lag("us").over(w))
    out = islands(e, ["user_id"], ["ts", "event_id"], F.col("gap").isNull() | (F.col("gap") > 7_200_000_000))
    return out.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first")).filter("n >= 2")


@query("W10", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, value < 50 ORDER BY ts, event_id) AS g FROM events) SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM r WHERE value < 50 GROUP BY 1, 2) GROUP BY 1")
def longest_run(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    low = F.col("value") < 50
    e = events(spark, sf_dir).withColumn("low", low).withColumn("turned", low & ~F.coalesce(F.lag(low).over(w), F.lit(False)))
    runs = islands(e, ["user_id"], ["ts", "event_id"], F.col("turned")).filter("low").groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"))


@query("S20 F15 F16", f"""WITH c AS ({CUES}), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(t1, t0 + 1000) AS e FROM c WHERE text <> '')
SELECT conv_id, md5(string_agg(i || chr(10) || printf('%02d:%02d:%02d,%03d', t0 // 3600000, t0 // 60000 % 60, t0 // 1000 % 60, t0 % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', e // 3600000, e // 60000 % 60, e // 1000 % 60, e % 1000) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS srt FROM n GROUP BY 1""")
def srt_export(spark, sf_dir) -> DataFrame:
    c = cues(spark, sf_dir).filter("text <> ''").withColumn("i", F.row_number().over(in_session()))
    end = F.coalesce("t1", F.col("t0") + 1000)
    block = F.concat(F.col("i").cast("string"), F.lit("\n"), X.timecode(F.col("t0")), F.lit(" --> "), X.timecode(end), F.lit("\n"), F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").cast("binary")).alias("srt"))


#: A cue's text in each variant: the spoken line, its translation (here every other line has one), or both.
SPOKEN, TARGET = "trim(text)", "CASE WHEN turn % 2 = 1 THEN '>> ' || trim(text) ELSE '' END"
VARIANTS = {"zh": SPOKEN, "target": TARGET, "bilingual": f"CASE WHEN {SPOKEN} <> '' AND {TARGET} <> '' THEN {SPOKEN} || chr(10) || {TARGET} ELSE {SPOKEN} || {TARGET} END"}
CODE = "printf('%02d:%02d:%02d{s}%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"
BLOCKS = {
    "srt": (f"i || chr(10) || {CODE.format(s=',', t='t0')} || ' --> ' || {CODE.format(s=',', t='e')} || chr(10) || line || chr(10)", "", "chr(10)"),
    "vtt": (f"{CODE.format(s='.', t='t0')} || ' --> ' || {CODE.format(s='.', t='e')} || chr(10) || line || chr(10)", "WEBVTT\n\n", "chr(10)"),
    "txt": ("line", "", "chr(10)"),
    "json": ("""'{"t0_ms":' || t0 || ',"t1_ms":' || e || ',"text":' || to_json(line) || '}'""", "", "chr(10)"),
    "md": (f"'**[' || {CODE.format(s='.', t='t0')} || ']** ' || replace(line, chr(10), '  ' || chr(10)) || chr(10)", "# captions\n\n", "chr(10)"),
}
EXPORTS = " UNION ALL ".join(
    f"SELECT conv_id, '{v}' AS variant, '{f}' AS format, md5('{head}' || string_agg({block}, {sep} ORDER BY turn)) AS file FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM (SELECT conv_id, turn, t0, CASE WHEN coalesce(t1, t0 + 1000) <= t0 THEN t0 + 400 ELSE coalesce(t1, t0 + 1000) END AS e, {line} AS line FROM c) WHERE line <> '') GROUP BY 1"
    for v, line in VARIANTS.items() for f, (block, head, sep) in BLOCKS.items()
)


@query("S20", f"WITH c AS ({CUES}) {EXPORTS}".replace("\\n", "\n"))
def caption_exports(spark, sf_dir) -> DataFrame:
    """Each session as a file of each format in each variant; lines without a text in the variant are left out and not numbered."""
    c = cues(spark, sf_dir)
    spoken = F.trim("text")
    target = F.when(F.col("turn") % 2 == 1, F.concat(F.lit(">> "), spoken)).otherwise("")
    both = F.concat_ws("\n", F.when(spoken != "", spoken), F.when(target != "", target))
    last = F.coalesce("t1", F.col("t0") + 1000)
    lined = c.select("conv_id", "turn", "t0", F.when(last <= F.col("t0"), F.col("t0") + 400).otherwise(last).alias("e"), F.explode(F.create_map(F.lit("zh"), spoken, F.lit("target"), target, F.lit("bilingual"), both)).alias("variant", "line")).filter("line <> ''")
    n = F.row_number().over(Window.partitionBy("conv_id", "variant").orderBy("turn"))
    stamp = lambda comma: F.concat(X.timecode(F.col("t0"), comma), F.lit(" --> "), X.timecode(F.col("e"), comma), F.lit("\n"), F.col("line"), F.lit("\n"))
    text = F.regexp_replace(F.regexp_replace(F.to_json(F.struct(F.col("line").alias("x"))), r'^\{"x":', ""), r"\}$", "")
    blocks = {
        "srt": F.concat(n.cast("string"), F.lit("\n"), stamp(",")), "vtt": stamp("."), "txt": F.col("line"),
        "json": F.concat(F.lit('{"t0_ms":'), F.col("t0").cast("string"), F.lit(',"t1_ms":'), F.col("e").cast("string"), F.lit(',"text":'), text, F.lit("}")),
        "md": F.concat(F.lit("**["), X.timecode(F.col("t0"), "."), F.lit("]** "), F.replace("line", F.lit("\n"), F.lit("  \n")), F.lit("\n")),
    }
    heads = F.create_map(*[F.lit(x) for f, (_, head, _) in BLOCKS.items() for x in (f, head)])
    each = lined.select("conv_id", "variant", "turn", F.create_map(*[x for f, b in blocks.items() for x in (F.lit(f), b)]).alias("m")).select("conv_id", "variant", "turn", F.explode("m").alias("format", "block"))
    files = each.groupBy("conv_id", "variant", "format").agg(F.array_sort(F.collect_list(F.struct("turn", "block"))).alias("b"))
    return files.select("conv_id", "variant", "format", F.md5(F.concat(F.element_at(heads, F.col("format")), F.array_join(F.transform("b", lambda x: x["block"]), "\n")).cast("binary")).alias("file"))


@query("S28", "SELECT conv_id, md5(string_agg('- ' || text, chr(10) ORDER BY turn)) AS minutes, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def ordered_text_agg(spark, sf_dir) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("- "), x["text"]))
    c = table(spark, sf_dir, "conversations").filter(F.trim("text") != "")
    return c.groupBy("conv_id").agg(F.md5(F.array_join(lines, "\n").cast("binary")).alias("minutes"), F.count("*").alias("n"))


@query("A18", """SELECT l_suppkey % 5 AS dim, count(*) FILTER (l_linenumber > 3) AS wins, count(*) FILTER (l_linenumber < 3) AS losses, count(*) FILTER (l_linenumber = 3) AS ties FROM lineitem GROUP BY 1""")
def ab_outcomes(spark, sf_dir) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("dim")).agg(F.count_if(n > 3).alias("wins"), F.count_if(n < 3).alias("losses"), F.count_if(n == 3).alias("ties"))


@query("A19", """WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS w, count(*) FILTER (event_type = 'error') AS l FROM events GROUP BY 1)
SELECT user_id, w, l, round(least(1.0, 2 * list_sum(list_transform(range(0, least(w, l) + 1), lambda i: exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) - (w + l) * ln(2.0))))), 9) AS p FROM e""")
def sign_test(spark, sf_dir) -> DataFrame:
    """The two-sided sign test of wins and losses."""
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("w"), F.count_if(F.col("event_type") == "error").alias("l"))
    return e.select("user_id", "w", "l", F.round(numbers.sign_test(F.col("w"), F.col("l")), 9).alias("p"))


@query("F18", f"""WITH c AS ({CUES}), b AS (SELECT conv_id, turn, text, t0 - lag(coalesce(t1, t0 + 4800)) OVER w AS gap, lag(text) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  UNION ALL SELECT -1, i, t, g, b FROM (VALUES (1, '短句', 400, '前句'), (2, '短句', 401, '前句'), (3, '短句', 0, '前句。'), (4, 'nine char', 0, 'a'), (5, '', 0, 'a'), (6, 'x', 0, 'why?')) AS v(i, t, g, b))
SELECT conv_id, turn, coalesce(gap <= 400 AND before <> '' AND text <> '' AND NOT regexp_matches(before, '[。！？?!.]$') AND length(text) <= 8, false) AS joins FROM b""")
def join_candidates(spark, sf_dir) -> DataFrame:
    """A line joins the one before after 400 ms at most, if that doesn't end a sentence and the line has eight characters at most."""
    c = cues(spark, sf_dir)
    end = F.lag(F.coalesce("t1", F.col("t0") + 4800)).over(in_session())
    odd = spark.sql("SELECT -1L AS conv_id, CAST(i AS BIGINT) AS turn, t AS text, CAST(g AS BIGINT) AS gap, b AS before FROM VALUES (1, '短句', 400, '前句'), (2, '短句', 401, '前句'), (3, '短句', 0, '前句。'), (4, 'nine char', 0, 'a'), (5, '', 0, 'a'), (6, 'x', 0, 'why?') AS v(i, t, g, b)")
    b = c.select("conv_id", "turn", "text", (F.col("t0") - end).alias("gap"), F.lag("text").over(in_session()).alias("before")).unionByName(odd)
    joins = (F.col("gap") <= 400) & (F.col("before") != "") & (F.col("text") != "") & ~F.col("before").rlike("[。！？?!.]\\z") & (F.length("text") <= 8)
    return b.select("conv_id", "turn", F.coalesce(joins, F.lit(False)).alias("joins"))


@query("F25", "SELECT event_id, CAST(greatest(128, least(1500, ceil((value * 62.5 + 64) / 64) * 64)) AS BIGINT) AS ctx, CAST(greatest(16, least(224, ceil(10 * value) + 8)) AS BIGINT) AS cap FROM events")
def audio_ctx_caps(spark, sf_dir) -> DataFrame:
    v = F.col("value")
    ctx = F.greatest(F.lit(128), F.least(F.lit(1500), F.ceil((v * 62.5 + 64) / 64) * 64)).cast("long")
    return events(spark, sf_dir).select("event_id", ctx.alias("ctx"), F.greatest(F.lit(16), F.least(F.lit(224), F.ceil(10 * v) + 8)).cast("long").alias("cap"))


@query("F36", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 6) AS rms, CAST(list_max(embedding) AS FLOAT) AS peak FROM embeddings")
def frame_rms(spark, sf_dir) -> DataFrame:
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(squares / F.size("embedding")), 6).alias("rms"), F.array_max("embedding").cast("float").alias("peak"))


ASKED = "(VALUES (1, '好嗎'), (2, '你呢 '), (3, '好嗎？'), (4, '好。'), (5, ''), (6, 'really?'), (7, '走')) AS t(id, text)"


@query("F17", f"WITH r AS (SELECT item_id + 100 AS id, text FROM benchmark UNION ALL SELECT * FROM {ASKED}) SELECT id, CASE WHEN trim(text) LIKE '%嗎' OR trim(text) LIKE '%呢' THEN trim(text) || '？' ELSE trim(text) END AS marked FROM r")
def question_marks(spark, sf_dir) -> DataFrame:
    """A question mark after a line that ends in a question particle, and has no mark."""
    t = F.trim("text")
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100).alias("id"), "text")
    lines = b.unionByName(spark.sql(f"SELECT CAST(id AS BIGINT) AS id, text FROM {ASKED}"))
    return lines.select("id", F.when(t.endswith("嗎") | t.endswith("呢"), F.concat(t, F.lit("？"))).otherwise(t).alias("marked"))


@query("", "SELECT item_id, len(regexp_extract_all(text, '[^.,;!?]{1,24}[.,;!?]?')) AS phrases FROM benchmark")
def phrase_segmentation(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(F.regexp_extract_all("text", F.lit("[^.,;!?]{1,24}[.,;!?]?"), F.lit(0))).cast("long").alias("phrases"))


@query("", "SELECT item_id, regexp_matches(text, '[,.!?]') AS ascii_marks, length(replace(text, '(', '')) <> length(replace(text, ')', '')) AS unbalanced, length(text) > 160 AS wide FROM benchmark")
def typography_rules(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    gone = lambda c: F.length(F.replace(t, F.lit(c), F.lit("")))
    return table(spark, sf_dir, "benchmark").select("item_id", t.rlike("[,.!?]").alias("ascii_marks"), (gone("(") != gone(")")).alias("unbalanced"), (F.length(t) > 160).alias("wide"))


@query("", "SELECT conv_id, turn, NOT regexp_matches(text, '[\\x00-\\x08]') AND NOT regexp_matches(text, '<[a-z]+>') AND NOT regexp_matches(lower(text), '^(sure|here is|okay)') AS valid FROM conversations WHERE role = 'assistant'")
def caption_validators(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    valid = ~t.rlike("[\\x00-\\x08]") & ~t.rlike("<[a-z]+>") & ~F.lower(t).rlike("^(sure|here is|okay)")
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", valid.alias("valid"))


@query("T18", "SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_slices(spark, sf_dir) -> DataFrame:
    w = F.window("ts", "1 hour")
    return events(spark, sf_dir).groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.floor(F.unix_timestamp("window.start") / 3600).alias("slot"), "n")


@query("T19", "SELECT CAST(s AS BIGINT) AS slot, count(*) AS n FROM events, unnest([floor(epoch(ts) / 1800), floor(epoch(ts) / 1800) - 1]) AS u(s) GROUP BY 1")
def sliding_slices(spark, sf_dir) -> DataFrame:
    w = F.window("ts", "1 hour", "30 minutes")
    return events(spark, sf_dir).groupBy(w).agg(F.count("*").alias("n")).select(F.floor(F.unix_timestamp("window.start") / 1800).alias("slot"), "n")


@query("T16", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(event_id) AS first, count(*) AS n FROM i GROUP BY user_id, s")
def session_windows(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("event_id").alias("first"), F.count("*").alias("n")).drop("session_window")


@query("T20", recursions.throttling(3_600_000_000, recursions.MICROS))
def throttled_updates(spark, sf_dir) -> DataFrame:
    """An update goes out if it differs from the last one sent and that is an hour old."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("text"))
    return folds.throttle(e, 3_600_000_000)


@query("T32", """WITH l AS (SELECT *, CASE WHEN value < 30 THEN 'ok' WHEN value < 100 THEN 'warn' ELSE 'bad' END AS level FROM events),
c AS (SELECT *, level = lag(level, 1) OVER w AND level = lag(level, 2) OVER w AS steady, row_number() OVER w AS i FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, last_value(CASE WHEN steady OR i = 1 THEN level END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shown FROM c""")
def hysteresis(spark, sf_dir) -> DataFrame:
    """The shown level switches after three equal readings."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.col("value")
    e = events(spark, sf_dir).withColumn("level", F.when(v < 30, "ok").when(v < 100, "warn").otherwise("bad"))
    x = F.col("level")
    e = e.withColumn("switch", F.when(((x == F.lag("level", 1).over(w)) & (x == F.lag("level", 2).over(w))) | (F.row_number().over(w) == 1), x))
    return e.select("event_id", F.last("switch", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("shown"))


@query("A21 W08", "SELECT role, room, count(*) AS n, max(length(text)) AS longest FROM (SELECT *, conv_id % 10 AS room FROM conversations) GROUP BY GROUPING SETS ((), (role), (room), (role, room))")
def drift_summary(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("room", F.col("conv_id") % 10)
    return c.cube("role", "room").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


@query("F12 F22 F28 L06")
def hard_text_functions(spark, sf_dir) -> DataFrame:
    """Functions that SQL lacks: match ratio with the phrase's reverse case, fixpoint rewriting, line breaking and longest-first picks."""
    b = table(spark, sf_dir, "benchmark")
    t = F.col("text")
    return b.select("item_id", Q.match_ratio(t, F.lower(t)).alias("ratio"), Q.rewrite({"the": "THE", "THE and": "BOTH"})(t).alias("rewritten"), Q.break_lines(16)(t).alias("lines"), Q.longest_first(t, ["the", "then", "with", "and"]).alias("picked"))


@query("W12", """SELECT vec_id, round(list_reduce(list_prepend(CAST(0.008 AS DOUBLE), list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))),
 lambda f, x: greatest(CASE WHEN x < f THEN 0.7 * f + 0.3 * x WHEN x >= greatest(0.008, f * 3.0) THEN f ELSE 0.995 * f + 0.005 * x END, 0.0001)), 9) AS floor FROM embeddings""")
def noise_floor(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(Q.smoothed_floor(F.transform("embedding", lambda x: F.abs(x.cast("double")))), 9).alias("floor"))


@query("T31", """WITH j AS (SELECT user_id, event_id, ts, epoch_us(ts) // 1000 AS due, CAST(trunc(value * 1000) AS BIGINT) AS cost FROM events),
s AS (SELECT *, sum(cost) OVER (PARTITION BY user_id ORDER BY due, event_id ROWS UNBOUNDED PRECEDING) AS upto FROM j),
d AS (SELECT *, CAST(upto + max(due - upto + cost) OVER (PARTITION BY user_id ORDER BY due, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done FROM s)
SELECT user_id, max(done) AS done, max(done - due) AS max_lag, arg_max(done - due, (due, event_id)) AS lag FROM d GROUP BY 1""")
def backlog_simulation(spark, sf_dir) -> DataFrame:
    """A serial worker per user: a job starts when it is due and the one before is done. The end of job i is the cost of all so far plus the most by which a due time was ahead of the cost before it, so windows do."""
    w = Window.partitionBy("user_id").orderBy("due", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    j = events(spark, sf_dir).select("user_id", "event_id", F.unix_millis("ts").alias("due"), (F.col("value") * 1000).cast("long").alias("cost")).withColumn("upto", F.sum("cost").over(w))
    d = j.withColumn("done", F.col("upto") + F.max(F.col("due") - F.col("upto") + F.col("cost")).over(w))
    lag = F.col("done") - F.col("due")
    return d.groupBy("user_id").agg(F.max("done").alias("done"), F.max(lag).alias("max_lag"), F.max_by(lag, F.struct("due", "event_id")).alias("lag"))


@query("T31")
def parallel_backlog(spark, sf_dir) -> DataFrame:
    """The same with three workers, and the most jobs that wait or run at a time."""
    jobs = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_millis("ts").alias("due"), F.col("event_id").alias("id"), (F.col("value") * 3_600_000).cast("long").alias("cost"))
    return folds.queue(jobs, 3)
