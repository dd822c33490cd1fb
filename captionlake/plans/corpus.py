"""Curation of text corpora: masking, quality cascade, dedup, drop funnel, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.joins import edit_pairs
from ..operators.windows import latest_per_key
from ..registry import query
from ..sources.tables import table

NORM = "regexp_replace(lower(text), '[^a-z0-9\\x{c0}-\\x{24f}]', '', 'g')"


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("A13", f"SELECT doc_id, source FROM (SELECT d.doc_id, source, lang, {NORM} AS norm, coalesce(quality, -1) AS q FROM documents d LEFT JOIN labels USING (doc_id)) QUALIFY row_number() OVER (PARTITION BY lang, norm ORDER BY q DESC, doc_id) = 1")
def exact_dedup_keep_best(spark, sf_dir) -> DataFrame:
    """The best of each group; groups meet by the hash of their key, so only hashes travel, and each is one aggregate."""
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    best = F.min(F.struct(-F.coalesce("quality", F.lit(-1)), "doc_id", "source")).alias("b")
    return d.groupBy("lang", F.sha2(X.loose_key(F.col("text")), 256).alias("h")).agg(best).select("b.doc_id", "b.source")


@query("A14", r"SELECT doc_id, count(*) OVER (PARTITION BY key) AS n FROM (SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[\p{P}\p{S}\p{Z}\p{C}]', '', 'g') AS key, coalesce(quality, -1) AS q FROM documents LEFT JOIN labels USING (doc_id)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY q DESC, doc_id) = 1")
def near_dedup_keep_best(spark, sf_dir) -> DataFrame:
    """The same over all languages, under the whole normal form of any script."""
    hashed = docs(spark, sf_dir).select("doc_id", F.sha2(X.memory_key(F.col("text")), 256).alias("h"))
    return hashed.join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("h").agg(F.min(F.struct(-F.coalesce("quality", F.lit(-1)), "doc_id")).alias("b"), F.count("*").alias("n")).select("b.doc_id", "n")


LICENCE = "CASE WHEN source IN ('src3', 'src4') THEN 'restricted' WHEN source = 'src5' THEN 'unknown' ELSE 'open' END"


@query("A15 F09 F10", f"""WITH r AS (SELECT doc_id, lang, {LICENCE} AS licence, coalesce(
 CASE WHEN {LICENCE} <> 'open' THEN 'licence' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}') THEN 'pii' END, CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN length(text) > 4000 THEN 'too_long' END,
 CASE WHEN 4 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < length(text) THEN 'script' END, CASE WHEN quality = 0 THEN 'low_quality' END) AS reason FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, licence, coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def corpus_funnel(spark, sf_dir) -> DataFrame:
    """Each row counts under the first reason that drops it."""
    t, source = F.col("text"), F.col("source")
    licence = F.when(source.isin("src3", "src4"), "restricted").when(source == "src5", "unknown").otherwise("open")
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("licence", licence)
    reason = X.first_reason(
        (F.col("licence") != "open", "licence"), (t.rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), "pii"), (F.length(F.trim(t)) == 0, "empty"), (F.length(t) > X.MAX_CHARS, "too_long"),
        (4 * F.length(F.regexp_replace(t, "[^A-Za-z]", "")) < F.length(t), "script"), (F.col("quality") == 0, "low_quality"),
    )
    return d.groupBy("lang", "licence", F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


MAIL, PHONE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[+][0-9]{1,3} [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}"


@query("F07", f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \\n]+', '[URL]', 'g'), '{MAIL}', '[EMAIL]', 'g'), '{PHONE}', '[PHONE]', 'g')) AS masked,
CAST(len(regexp_extract_all(text, '{MAIL}')) AS BIGINT) AS mails, CAST(len(regexp_extract_all(text, '{PHONE}')) AS BIGINT) AS phones FROM documents""")
def pii_mask(spark, sf_dir) -> DataFrame:
    """Texts without a sign of a pattern skip it."""
    step = lambda t, sign, pattern, tag: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, tag)).otherwise(t)
    count = lambda sign, pattern: F.when(F.contains("text", F.lit(sign)), F.regexp_count("text", F.lit(pattern))).otherwise(0).cast("long")
    masked = step(step(step(F.col("text"), "://", r"https?://[^ \n]+", "[URL]"), "@", MAIL, "[EMAIL]"), "+", PHONE, "[PHONE]")
    return docs(spark, sf_dir).select("doc_id", F.md5(masked.cast("binary")).alias("masked"), count("@", MAIL).alias("mails"), count("+", PHONE).alias("phones"))


@query("F07")
def pii_redact(spark, sf_dir) -> DataFrame:
    """All steps of masking; a document with more than three hits is dropped, as a publisher may choose."""
    text, counts = X.redact(F.col("text"), names=["Anna", "Schmidt"], all_urls=True)
    return docs(spark, sf_dir).select("doc_id", F.md5(text.cast("binary")).alias("masked"), *[n.alias(k) for k, n in counts.items()], (sum(counts.values()) > 3).alias("dropped"))


@query("F08", "SELECT doc_id, CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS latin, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS BIGINT) AS digits, CASE WHEN length(text) = 0 THEN 'empty' WHEN 2 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < length(text) THEN 'mixed' ELSE 'latin' END AS script FROM documents")
def script_profile(spark, sf_dir) -> DataFrame:
    t = F.col("text")
    latin, digits = F.regexp_count(t, F.lit("[A-Za-z]")).cast("long"), F.regexp_count(t, F.lit("[0-9]")).cast("long")
    script = F.when(F.length(t) == 0, "empty").when(2 * latin < F.length(t), "mixed").otherwise("latin")
    return docs(spark, sf_dir).select("doc_id", latin.alias("latin"), digits.alias("digits"), script.alias("script"))


@query("F09", """SELECT a.conv_id, a.turn, coalesce(CASE WHEN length(b.text) = 0 THEN 'empty' END, CASE WHEN a.text = b.text THEN 'src_equals_tgt' END, CASE WHEN length(b.text) < 0.5 * length(a.text) OR length(b.text) > 2 * length(a.text) THEN 'length_ratio' END, 'ok') AS verdict
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""")
def length_ratio_flags(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    b = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    s, t = F.length("src"), F.length("tgt")
    verdict = X.first_reason((t == 0, "empty"), (F.col("src") == F.col("tgt"), "src_equals_tgt"), ((t < X.LEAST_RATIO * s) | (t > X.MOST_RATIO * s), "length_ratio"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.coalesce(verdict, F.lit("ok")).alias("verdict"))


@query("F11", "SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name) AS d FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 12")
def edit_distance_pairs(spark, sf_dir) -> DataFrame:
    return edit_pairs(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey", "p_name", 12)


@query("F37", """SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_visible_text(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.visible_text(F.col("html")).cast("binary")).alias("text_md5"))


DIGESTS = "SELECT source, doc_id AS i, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\p{P}\\p{S}\\p{Z}\\p{C}]', '', 'g')) AS h FROM documents"
for _ in range(4):
    DIGESTS = f"SELECT source, i // 1000 AS i, sha256(string_agg(h, chr(10) ORDER BY i, h)) AS h FROM ({DIGESTS}) GROUP BY 1, 2"


@query("F38", f"SELECT source, h[:16] AS fingerprint FROM ({DIGESTS})")
def content_fingerprint(spark, sf_dir) -> DataFrame:
    """A digest of all lines of a source in order: lines are hashed where they are read, and digests of a thousand neighbours are hashed again, level by level, so no group holds a source."""
    d = docs(spark, sf_dir).select("source", F.col("doc_id").alias("i"), F.sha2(X.plain_key(F.col("text")), 256).alias("h"))
    for _ in range(4):
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        d = d.groupBy("source", F.floor(F.col("i") / 1000).alias("j")).agg(F.sha2(F.array_join(hashes, "\n"), 256).alias("h")).withColumnRenamed("j", "i")
    return d.select("source", F.substring("h", 1, 16).alias("fingerprint"))


@query("F10", "SELECT doc_id, coalesce(CASE WHEN doc_id % 10 = 0 THEN 'session' END, CASE WHEN source IN ('src1', 'src2') THEN 'room' END, CASE WHEN lang = 'de' THEN 'origin' END, 'unknown') AS licence FROM documents")
def licence_precedence(spark, sf_dir) -> DataFrame:
    licence = X.first_reason((F.col("doc_id") % 10 == 0, "session"), (F.col("source").isin("src1", "src2"), "room"), (F.col("lang") == "de", "origin"))
    return docs(spark, sf_dir).select("doc_id", F.coalesce(licence, F.lit("unknown")).alias("licence"))


@query("F06", f"SELECT doc_id, sha1(lang || '|' || source || '|' || {NORM}) AS tm_key, sha256(concat_ws(chr(0), lang, source, CAST(doc_id AS VARCHAR)))[:32] AS entry_id FROM documents")
def stable_hashes(spark, sf_dir) -> DataFrame:
    tm = F.sha1(F.concat_ws("|", "lang", "source", X.loose_key(F.col("text"))).cast("binary"))
    return docs(spark, sf_dir).select("doc_id", tm.alias("tm_key"), F.substring(F.sha2(F.concat_ws("\0", "lang", "source", F.col("doc_id").cast("string")), 256), 1, 32).alias("entry_id"))


@query("F01 F02 F03", f"SELECT doc_id, md5({NORM}) AS key FROM documents")
def loose_keys(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(X.loose_key(F.col("text")).cast("binary")).alias("key"))


@query("F01 F02 F13")
def unicode_keys(spark, sf_dir) -> DataFrame:
    """The Unicode-exact forms, whose folding SQL lacks."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(X.nfkc_fold(t).cast("binary")).alias("fold"), F.md5(X.translation_key(t).cast("binary")).alias("memory"), X.display_width(t).alias("width"))


HAN_ROWS = "(VALUES (1, '因緣生'), (2, 'GPU 訓練開始了'), (3, 'plain words'), (4, ''), (5, 'あいう,因')) AS t(id, text)"


@query("F05", f"WITH r AS (SELECT item_id + 100 AS id, text FROM benchmark UNION ALL SELECT * FROM {HAN_ROWS}) SELECT id, trim(regexp_replace(regexp_replace(text, '([\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{3040}}-\\x{{30ff}}])', ' \\1 ', 'g'), ' +', ' ', 'g')) AS spaced FROM r")
def han_spacing(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100).alias("id"), "text")
    return b.unionByName(spark.sql(f"SELECT CAST(id AS BIGINT) AS id, text FROM {HAN_ROWS}")).select("id", X.space_han(F.col("text")).alias("spaced"))


@query("F31", """SELECT b.item_id, list_filter([CASE WHEN d.text IS NULL THEN 'missing' END, CASE WHEN d.text = '' THEN 'empty' END, CASE WHEN NOT contains(d.text, split_part(b.text, ' ', 1)) THEN 'must' END, CASE WHEN contains(d.text, '#') THEN 'forbidden' END], lambda x: x IS NOT NULL) AS rules FROM benchmark b LEFT JOIN documents d ON b.item_id * 7 = d.doc_id""")
def regression_rules(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 7).alias("doc_id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("must"))
    t = F.col("text")
    rules = F.array(F.when(t.isNull(), "missing"), F.when(t == "", "empty"), F.when(~F.contains(t, F.col("must")), "must"), F.when(t.contains("#"), "forbidden"))
    return b.join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "left").select("item_id", F.array_compact(rules).alias("rules"))


WIDE, NARROW = "０１２３４５６７８９．，＋－％", "0123456789.,+-%"
NUMBERS = f"regexp_extract_all(translate({{}}, '{WIDE}', '{NARROW}'), '(?:^|[^0-9A-Za-z.])([+-]?[0-9]+(?:[.,][0-9]+)*%?)', 1)"
LOCKED = "document"
#: Units of time in a source, before "after" and "within".
UNITS = "分鐘|秒|小時|天|日|週|月|年"
ODD_PAIRS = "(1, '5 分鐘後 3.5% -7', 'within 5 minutes 3.5%'), (2, 'the document', ''), (3, 'a document', 'a file <b>x</b>'), (4, '12天後，2小時內', 'Within 12 days'), (5, '１２ 年後', 'in 12 years'), (6, '3月後', 'WITHIN 3 months')"


@query("F45", f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS tgt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' UNION ALL SELECT -1, i, s, t FROM (VALUES {ODD_PAIRS}) AS v(i, s, t))
SELECT conv_id, turn, list_filter([CASE WHEN trim(tgt) = '' THEN 'empty' END, CASE WHEN trim(tgt) <> '' AND regexp_matches(tgt, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|<[^<>]+>') THEN 'format' END,
  CASE WHEN trim(tgt) <> '' AND len(list_filter({NUMBERS.format('src')}, lambda x: NOT list_contains({NUMBERS.format('tgt')}, x))) > 0 THEN 'numbers' END,
  CASE WHEN trim(tgt) <> '' AND regexp_matches(src, '[0-9０-９]\\s*({UNITS})後') AND NOT regexp_matches(src, '[0-9０-９]\\s*({UNITS})內') AND regexp_matches(lower(tgt), '\\bwithin\\b') THEN 'relation' END,
  CASE WHEN trim(tgt) <> '' AND contains(src, '{LOCKED}') AND NOT contains(lower(tgt), '{LOCKED}') THEN 'locked_term' END], lambda x: x IS NOT NULL) AS flags FROM p""")
def translation_flags(spark, sf_dir) -> DataFrame:
    """What is suspicious of a translation: nothing there, markup or control characters, numbers of the source missing, "after" a time told as "within" it, a locked term missing."""
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    odd = spark.sql(f"SELECT -1L AS conv_id, CAST(i AS BIGINT) AS turn, s AS src, t AS tgt FROM VALUES {ODD_PAIRS} AS v(i, s, t)")
    src, tgt = F.col("src"), F.col("tgt")
    numbers = lambda x: F.regexp_extract_all(F.translate(x, WIDE, NARROW), F.lit(r"(?<![0-9A-Za-z.])[+-]?[0-9]+(?:[.,][0-9]+)*%?"), F.lit(0))
    span = lambda word: src.rlike(rf"[0-9０-９]\s*({UNITS}){word}")
    there = F.trim(tgt) != ""
    rules = {
        "empty": ~there, "format": there & tgt.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]|<[^<>]+>"), "numbers": there & (F.size(F.array_except(numbers(src), numbers(tgt))) > 0),
        "relation": there & span("後") & ~span("內") & F.lower(tgt).rlike(r"\bwithin\b"), "locked_term": there & src.contains(LOCKED) & ~F.lower(tgt).contains(LOCKED),
    }
    pairs = a.join(b, ["conv_id", "turn"]).unionByName(odd)
    return pairs.select("conv_id", "turn", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("flags"))


@query("F24")
def repetition_loops(spark, sf_dir) -> DataFrame:
    from ..functions.sequences import has_loop

    return docs(spark, sf_dir).select("doc_id", has_loop(F.col("text")).alias("loop"))


@query("L02", f"SELECT norm AS h, doc_id FROM (SELECT md5({NORM}) AS norm, doc_id, n_chars FROM documents) QUALIFY row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) = 1")
def top1_per_hash(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir).select(F.md5(X.loose_key(F.col("text")).cast("binary")).alias("h"), "doc_id", "n_chars")
    return latest_per_key(d, ["h"], [F.desc("n_chars"), F.col("doc_id")]).select("h", "doc_id")
