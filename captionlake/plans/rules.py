"""Rules of captions, glossaries, audio frames, jobs and late results, as the sources state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import captions as C
from ..functions import sequences as Q
from ..operators import folds
from ..operators import glossary as G
from ..registry import query
from . import recursions
from ..sources.tables import events, table

#: Replies that the tables lack: id, reply, source.
REPLIES = """VALUES (1, ' A line. ', '一句'), (2, 'Here is the translation: a', '一'), (3, 'Of course, we begin.', '開'), (4, '"quoted"', 'x'), (5, '{"en": " inner ", "current": ""}', '裡'), (6, '{"en": 5}', 'x'),
 (7, 'has 漢字 run', 'x'), (8, 'a\\n\\nb', 'x'), (9, 'a\\nNote: b', 'x'), (10, '<|im_end|>', 'x'), (11, '', 'x'), (12, '[1]', 'x'), (13, 'これは線です', '這是線'), (14, '這是一條很長很長的線', '這是一條很長很長的線段'), (15, '短線', '長條')"""
LINES = "VALUES (1, '今日は「晴れ」です。'), (2, '、「始め'), (3, 'はい,e.g. 3.5 OK.'), (4, '这是，漢，字。。'), (5, '{漢字|かんじ}と）'), (6, 'これは十六文字をずっと超えてしまう行です')"


@query("F26")
def reply_validation(spark, sf_dir) -> DataFrame:
    """Captions that replies hold, by the English and the Japanese rules: replies of conversations, and odd ones."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = c.withColumn("source", F.lag("text").over(w)).filter("role = 'assistant'").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("text").alias("reply"), "source")
    odd = spark.sql(f"SELECT -1L AS conv_id, CAST(i AS BIGINT) AS turn, r AS reply, s AS source FROM {REPLIES} AS t(i, r, s)")
    r, s = F.col("reply"), F.col("source")
    return said.unionByName(odd).select("conv_id", "turn", F.md5(C.english_reply(r, s, F.array(F.lit("some 漢字 here"))).cast("binary")).alias("english"), F.md5(C.japanese_reply(r, s).cast("binary")).alias("japanese"))


@query("F29")
def typography_checks(spark, sf_dir) -> DataFrame:
    """All six rules over benchmark lines and Japanese ones."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("line"), "text").unionByName(spark.sql(f"SELECT concat('odd', i) AS line, text FROM {LINES} AS t(i, text)"))
    return b.select("line", *[n_times.cast("long").alias(rule) for rule, n_times in C.typography(F.col("text")).items()])


MARKS = C.PHRASE_END
PHRASES = f"regexp_extract_all(text, '(?s)([^{MARKS}]{{0,11}}[{MARKS}]|[^{MARKS}]{{1,12}})')"


@query("F27", f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS line, text FROM benchmark UNION ALL SELECT 'odd' || i, t FROM ({LINES}) AS v(i, t))
SELECT line, len({PHRASES}) AS n, md5(array_to_string({PHRASES}, '|')) AS cut, list_filter(['今日', '漢字', 'the'], lambda x: contains(text, x)) AS ruby FROM b""")
def phrases_and_readings(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("line"), "text").unionByName(spark.sql(f"SELECT concat('odd', i) AS line, text FROM {LINES} AS t(i, text)"))
    terms = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(r).alias("reading")) for t, r in (("今日", "きょう"), ("漢字", "かんじ"), ("今日", "こんにち"), ("字", ""), ("the", "ザ"))])
    p = C.phrases(F.col("text"))
    return b.select("line", F.size(p).cast("long").alias("n"), F.md5(F.array_join(p, "|").cast("binary")).alias("cut"), F.transform(C.readings_in(F.col("text"), terms), lambda x: x["text"]).alias("ruby"))


def glossary_texts(spark, sf_dir) -> DataFrame:
    """A glossary text for each brand, a term a line; with every seventh brand some lines are odd."""
    odd = F.when(F.col("p_partkey") % 97 == 0, "no separator").when(F.col("p_partkey") % 89 == 0, F.concat("p_name", F.lit("||x＝"), "p_type"))
    line = F.coalesce(odd, F.concat("p_name", F.lit(" | "), F.lower("p_type"), F.lit(" = "), "p_type"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("room"), "p_partkey", line.alias("l"))
    lines = p.groupBy("room", F.floor(F.col("p_partkey") / 1500).alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "l"))).alias("ls"))
    return lines.select(F.concat_ws("-", "room", "page").alias("id"), F.concat(F.lit("# terms\n\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n")).alias("text"))


@query("F20")
def glossary_lenient(spark, sf_dir) -> DataFrame:
    return G.lenient_terms(glossary_texts(spark, sf_dir), "id", "text")


@query("F20")
def glossary_strict(spark, sf_dir) -> DataFrame:
    return G.strict_terms(glossary_texts(spark, sf_dir), "id", "text")


@query("F21", """WITH g AS (SELECT p_partkey AS id, lower(trim(p_name)) AS term, lower(trim(CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN p_name[1:1] WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN '開始' ELSE p_type END)) AS alias FROM part),
f AS (SELECT term, min(id) AS id FROM g GROUP BY 1), a AS (SELECT g.* FROM g JOIN f USING (term, id))
SELECT g.id, 'duplicate' AS rule, NULL AS alias FROM g JOIN f USING (term) WHERE g.id <> f.id UNION ALL SELECT id, 'short_alias', alias FROM a WHERE length(alias) < 2 UNION ALL SELECT id, 'stop_alias', alias FROM a WHERE alias = '開始'
UNION ALL SELECT id, 'alias_is_term', alias FROM a WHERE alias IN (SELECT term FROM f) UNION ALL SELECT id, 'alias_in_term', alias FROM a WHERE length(alias) >= 2 AND EXISTS (SELECT 1 FROM f WHERE f.term <> a.term AND f.term <> a.alias AND contains(f.term, a.alias))
UNION ALL SELECT id, 'alias_owners', alias FROM a WHERE alias IN (SELECT alias FROM a GROUP BY 1 HAVING count(DISTINCT term) > 1)""")
def glossary_set_check(spark, sf_dir) -> DataFrame:
    by = F.col("p_partkey") % 5
    alias = F.when(by == 0, F.col("p_brand")).when(by == 1, F.left("p_name", F.lit(1))).when(by == 2, F.split_part("p_name", F.lit(" "), F.lit(1))).when(by == 3, F.lit("開始")).otherwise(F.col("p_type"))
    return G.set_violations(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"), F.array(alias).alias("aliases")))


@query("F21", """WITH g AS (SELECT p_brand AS brand, p_partkey AS id, lower(trim(p_name)) AS term, lower(split_part(p_name, ' ', 1)) AS alias FROM part),
o AS (SELECT brand, id FROM g QUALIFY row_number() OVER (PARTITION BY brand ORDER BY id) = 9), k AS (SELECT * FROM g WHERE brand NOT IN (SELECT brand FROM o)),
f AS (SELECT brand, term, min(id) AS id FROM k GROUP BY 1, 2), a AS (SELECT k.* FROM k JOIN f USING (brand, term, id))
SELECT brand, id, 'too_many' AS rule, NULL AS alias FROM o UNION ALL SELECT k.brand, k.id, 'duplicate', NULL FROM k JOIN f USING (brand, term) WHERE k.id <> f.id
UNION ALL SELECT brand, id, 'alias_is_term', alias FROM a WHERE (brand, alias) IN (SELECT (brand, term) FROM f) UNION ALL SELECT brand, id, 'alias_in_term', alias FROM a WHERE EXISTS (SELECT 1 FROM f WHERE f.brand = a.brand AND f.term <> a.term AND f.term <> a.alias AND contains(f.term, a.alias))
UNION ALL SELECT brand, id, 'alias_owners', alias FROM a WHERE (brand, alias) IN (SELECT (brand, alias) FROM a GROUP BY brand, alias HAVING count(DISTINCT term) > 1)""")
def glossary_sets(spark, sf_dir) -> DataFrame:
    """A glossary for each brand, whose aliases are in full-width capitals; one of more than eight terms is refused."""
    wide = F.translate(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    return G.set_violations(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_name").alias("term"), F.array(wide).alias("aliases")), "brand", 8)


@query("F22", """SELECT doc_id, md5(replace(replace(replace(text, 'the', chr(1)), 'he', 'HE'), chr(1), 'the')) AS rewritten, CASE WHEN contains(text, 'the') THEN ['HE'] WHEN text IS NOT NULL THEN [] END AS guarded FROM documents""")
def guarded_rewriting(spark, sf_dir) -> DataFrame:
    """An alias stays within a guard word, and is told."""
    aliases, guards = {"he": "HE"}, ("the",)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(Q.rewrite(aliases, guards=guards)(F.col("text")).cast("binary")).alias("rewritten"), Q.guarded(aliases, guards)(F.col("text")).alias("guarded"))


#: Milliseconds of a frame, share of speech frames under which audio is silent, padding, and the least saving for which it is trimmed.
FRAME_MS, SPEECH_SHARE, PAD_MS, LEAST_SAVED_MS = 32, 0.05, 200, 500


@query("T17", """WITH h AS (SELECT vec_id, len(embedding) AS n, list_filter(range(1, len(embedding) + 1), lambda i: abs(embedding[i]) >= 0.25) AS spoken FROM embeddings),
t AS (SELECT vec_id, n * 32 AS total, len(spoken) < 0.05 * n AS silent, greatest(0, (list_min(spoken) - 1) * 32 - 200) AS a, least(n * 32, list_max(spoken) * 32 + 200) AS b FROM h)
SELECT vec_id, silent, CAST(CASE WHEN b > a AND total - (b - a) >= 500 THEN a ELSE 0 END AS BIGINT) AS start_ms, CAST(CASE WHEN b > a AND total - (b - a) >= 500 THEN b ELSE total END AS BIGINT) AS end_ms FROM t""")
def voice_gate(spark, sf_dir) -> DataFrame:
    """Frames' levels stand for speech probabilities: silent audio has few speech frames; other audio is cut to its speech and padding where that saves enough."""
    n, at = F.size("embedding"), F.filter(F.transform("embedding", lambda x, i: F.when(F.abs(x) >= 0.25, i)), lambda i: i.isNotNull())
    h = table(spark, sf_dir, "embeddings").select("vec_id", n.alias("n"), at.alias("at"))
    begin = F.when(F.size("at") > 0, F.greatest(F.lit(0), F.array_min("at") * FRAME_MS - PAD_MS))
    end = F.when(F.size("at") > 0, F.least(F.col("n") * FRAME_MS, (F.array_max("at") + 1) * FRAME_MS + PAD_MS))
    t = h.select("vec_id", (F.size("at") < SPEECH_SHARE * F.col("n")).alias("silent"), begin.alias("a"), end.alias("b"), (F.col("n") * FRAME_MS).alias("total"))
    worth = (F.col("b") > F.col("a")) & (F.col("total") - (F.col("b") - F.col("a")) >= LEAST_SAVED_MS)
    return t.select("vec_id", "silent", F.when(worth, F.col("a")).otherwise(0).cast("long").alias("start_ms"), F.when(worth, F.col("b")).otherwise(F.col("total")).cast("long").alias("end_ms"))


@query("F36", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
w AS (SELECT vec_id, x, list_transform(range(0, len(x), 10), lambda i: x[i + 1:i + 10]) AS ws, list_transform(range(0, len(x) // 2), lambda i: (x[2 * i + 1] + x[2 * i + 2]) / 2) AS mono FROM p),
r AS (SELECT vec_id, ws, mono, list_transform(range(0, CAST(floor(len(mono) * 16 / 24) AS BIGINT)), lambda i: mono[i * 3 // 2 + 1] + (i * 1.5 - i * 3 // 2) * (mono[least(i * 3 // 2 + 2, len(mono))] - mono[i * 3 // 2 + 1])) AS y FROM w)
SELECT vec_id, round(list_max(list_transform(ws, lambda a: sqrt(list_sum(list_transform(a, lambda v: v * v)) / len(a)))), 6) AS loudest, len(mono) AS mono, len(y) AS resampled, round(list_sum(y), 6) AS total FROM r""")
def pcm_math(spark, sf_dir) -> DataFrame:
    """The loudest window of ten samples, pairs of channels mixed down, and the mix resampled from 24 to 16 by linear interpolation."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    last = F.size("x") - 1
    windows = F.transform(F.sequence(F.lit(0), last, F.lit(10)), lambda i: F.slice("x", i + 1, F.lit(10)))
    power = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v) / F.size(a))
    mono = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda i: (F.get("x", 2 * i) + F.get("x", 2 * i + 1)) / 2)
    m = p.filter(F.size("x") >= 4).select("vec_id", F.array_max(F.transform(windows, power)).alias("loudest"), mono.alias("m"))

    def at(i):
        low = F.floor(i * 1.5).cast("int")
        a, b = F.get("m", low), F.get("m", F.least(low + 1, F.size("m") - 1))
        return a + (i * 1.5 - low) * (b - a)

    y = F.transform(F.sequence(F.lit(0), F.floor(F.size("m") * 2 / 3).cast("int") - 1), at)
    total = F.aggregate("y", F.lit(0.0), lambda s, v: s + v)
    return m.withColumn("y", y).select("vec_id", F.round("loudest", 6).alias("loudest"), F.size("m").cast("long").alias("mono"), F.size("y").cast("long").alias("resampled"), F.round(total, 6).alias("total"))


@query("T12", """WITH l AS (SELECT event_id, value, epoch_us(ts) AS t0, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t1 FROM events)
SELECT event_id, CASE WHEN value > 300 THEN 'timeout' WHEN value > 60 AND t1 IS NOT NULL AND t1 - t0 < 7200000000 THEN 'stale' WHEN value > 20 AND t1 - t0 <= CAST(round(value * 100) AS BIGINT) * 600000000 THEN 'late' ELSE 'shown' END AS outcome FROM l""")
def late_results(spark, sf_dir) -> DataFrame:
    """A line that waited too long is skipped, a stale one with a newer one soon after too; a late result is dropped if a newer line is there when it comes."""
    e = events(spark, sf_dir).withColumn("at", F.unix_micros("ts"))
    ahead = F.lead("at").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - F.col("at")
    v = F.col("value")
    e = e.withColumn("ahead", ahead)
    outcome = F.when(v > 300, "timeout").when((v > 60) & (F.col("ahead") < 7_200_000_000), "stale").when((v > 20) & (F.col("ahead") <= F.col("cents") * 600_000_000), "late").otherwise("shown")
    return e.select("event_id", outcome.alias("outcome"))


@query("M11", recursions.leased(20 * 3600, 3, 1800))
def job_leases(spark, sf_dir) -> DataFrame:
    """Jobs under leases of 20 hours: views claim, clicks beat, purchases finish, errors ask for another try (some for a later one), signups cancel."""
    kinds = F.create_map(*[F.lit(x) for pair in (("view", "claim"), ("click", "beat"), ("purchase", "finish"), ("signup", "cancel")) for x in pair])
    kind = F.when(F.col("event_type") == "error", F.when(F.col("k") % 3 == 0, "defer").otherwise("retry")).otherwise(F.coalesce(F.element_at(kinds, F.col("event_type")), F.lit("beat")))
    e = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_seconds("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), (F.col("k") % 2).alias("owner"))
    return folds.leases(e, 20 * 3600, 3, 1800)
