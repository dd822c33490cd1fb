"""Search, translation memory, dictionary and vectors."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dictionary as D
from ..functions.stems import stem
from ..functions.text import loose_key
from ..operators import search as S
from ..operators.fuzzy import fuzzy_matches
from ..operators.index import TextIndex, ranked, search
from ..operators.vectors import cosine_top_k
from ..registry import query
from ..sources.tables import table
from ..streaming.run import shared_dir

W_SQL = "SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents"


@query("X05", f"""WITH w AS ({W_SQL}), l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len FROM documents), s AS (SELECT count(*) AS n, sum(len) AS total FROM l),
h AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('with', 'from', 'nicht') GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM h GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (total / n)))), 6) AS score FROM h JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(spark, sf_dir) -> DataFrame:
    return S.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["with", "from", "nicht"], 20)


@query("X02", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the')")
def trigram_search(spark, sf_dir) -> DataFrame:
    """A phrase by a scan: what a table without an index costs."""
    return S.phrase_search(table(spark, sf_dir, "documents"), "doc_id", "text", "tion the")


def new_index(spark, key: str) -> TextIndex:
    return TextIndex(spark, f"{shared_dir(spark)}/captionlake-index-{uuid.uuid4().hex}", key)


#: Texts that the tables lack.
HAN_ROWS = "(VALUES (-1, '因緣生法，因緣生'), (-2, '緣生 ABC'), (-3, 'abcd 法'), (-4, '因緣 qu'))"


@query("X01 X02 X03", f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {HAN_ROWS})
SELECT 'long' AS q, doc_id, 'gram' AS way FROM d WHERE contains(lower(text), 'tion the') UNION ALL SELECT 'short', doc_id, 'token' FROM d WHERE regexp_matches(lower(text), '(^|[^\\pL\\pN])qu')
UNION ALL SELECT 'spaced', doc_id, 'gram' FROM d WHERE contains(lower(text), '因緣生') UNION ALL SELECT 'han', doc_id, 'token' FROM d WHERE contains(text, '緣生')""")
def routed_search(spark, sf_dir) -> DataFrame:
    """Four questions by the stored index: three characters or more go to the trigrams, fewer to the tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM {HAN_ROWS[1:-1]} AS t(doc_id, text)"))
    index = new_index(spark, "doc_id")
    index.add(d, "text")
    hits = [search(index, d, "text", q).select(F.lit(name).alias("q"), "doc_id", "way") for name, q in (("long", " tion  the "), ("short", "qu"), ("spaced", "因 緣 生"), ("han", "緣 生"))]
    return reduce(DataFrame.unionByName, hits)


@query("X02 X03", "SELECT page_id FROM pages WHERE contains(lower(url), '/en/') AND page_id % 3 > 0")
def gram_index_search(spark, sf_dir) -> DataFrame:
    """Current rows of an index over all rows; two appends hold half of them, and the rest, not indexed yet, is looked through."""
    p, index = table(spark, sf_dir, "pages").select("page_id", "url"), new_index(spark, "page_id")
    for part in (0, 1):
        index.add(p.filter(F.col("page_id") % 4 == part), "url")
    return search(index, p, "url", "/en/", F.col("page_id") % 3 > 0).select("page_id")


@query("X05", """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM benchmark), s AS (SELECT count(*) AS n, sum(len(w)) AS total FROM w),
t AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM w) WHERE term IN ('the', 'that', 'thin') GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
b AS (SELECT item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / (total / n)))), 6) AS score FROM t JOIN d USING (term) JOIN w USING (item_id), s GROUP BY 1 ORDER BY score DESC, item_id LIMIT 20),
f AS (SELECT item_id, score, w, greatest(1, least(list_min(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ('the', 'that', 'thin'))) - 4, len(w) - 15)) AS f FROM b JOIN w USING (item_id))
SELECT item_id, score, CASE WHEN f > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(w[f:f + 15], lambda x: CASE WHEN x IN ('the', 'that', 'thin') THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN f + 16 <= len(w) THEN ' …' ELSE '' END AS snippet FROM f""")
def ranked_snippets(spark, sf_dir) -> DataFrame:
    """The best texts for three words with the place of the first hit, by the stored index."""
    b, index = table(spark, sf_dir, "benchmark"), new_index(spark, "item_id")
    index.add(b, "text")
    return ranked(index, b, "text", ["the", "that", "thin"], 20)


@query("X03", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({W_SQL}) WHERE term LIKE 'wit%' GROUP BY 1")
def prefix_search(spark, sf_dir) -> DataFrame:
    p = S.postings(table(spark, sf_dir, "documents"), "doc_id", "text").filter(F.col("term").startswith("wit"))
    return p.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query("X06", """WITH m AS (SELECT DISTINCT ON (k) md5(regexp_replace(lower(text), '[^a-z0-9\\x{c0}-\\x{24f}]', '', 'g')) AS k, doc_id FROM documents ORDER BY k, doc_id)
SELECT d.doc_id, m.doc_id AS match_id FROM documents d JOIN m ON md5(regexp_replace(lower(d.text), '[^a-z0-9\\x{c0}-\\x{24f}]', '', 'g')) = m.k WHERE m.doc_id < d.doc_id""")
def tm_exact(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(loose_key(F.col("text")).cast("binary")).alias("k"))
    m = d.groupBy("k").agg(F.min("doc_id").alias("match_id"))
    return d.join(m, "k").filter("match_id < doc_id").select("doc_id", "match_id")


@query("X07 F12")
def tm_fuzzy(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return fuzzy_matches(p.select(F.col("p_partkey").alias("q_id"), "p_name"), p.select(F.col("p_partkey").alias("m_id"), "p_name"), "q_id", "m_id", "p_name")


@query("X04")
def stemmed_search(spark, sf_dir) -> DataFrame:
    """Words by stem, so that forms of a word meet; distinct words are stemmed once."""
    p = S.postings(table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id", "text")
    stems = p.select("term").distinct().withColumn("stem", stem("term"))
    return p.join(stems, "term").groupBy("stem").agg(F.sum("tf").alias("n"), F.count_distinct("doc_id").alias("docs")).filter("docs > 1")


HAN_TEXTS = "(VALUES (1, '因緣生法，因緣生'), (2, '緣生'), (3, 'abc 法'), (4, '因緣')) AS t(id, text)"
HAN_GRAMS = " UNION ALL ".join(f"SELECT id, unnest(list_transform(range(1, length(w) - {n} + 2), lambda i: w[i:i + {n} - 1])) AS g FROM r" for n in (2, 3, 4))


@query("A11", f"WITH x AS (SELECT doc_id + 100 AS id, text FROM documents UNION ALL SELECT * FROM {HAN_TEXTS}), r AS (SELECT id, unnest(regexp_extract_all(text, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]+')) AS w FROM x) SELECT g AS gram, count(*) AS n, count(DISTINCT id) AS sessions, min(id) AS first FROM ({HAN_GRAMS}) GROUP BY 1")
def han_ngrams(spark, sf_dir) -> DataFrame:
    """Han 2- to 4-grams, overlapping ones too: how often, in how many sessions, and where first."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("id"), "text")
    runs = d.unionByName(spark.sql(f"SELECT CAST(id AS BIGINT) AS id, text FROM {HAN_TEXTS}")).select("id", F.explode(F.regexp_extract_all("text", F.lit("[\\u3400-\\u4dbf\\u4e00-\\u9fff]+"), F.lit(0))).alias("w"))
    cut = lambda n: F.filter(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substr("w", i, F.lit(n))), lambda g: F.length(g) == n)
    return runs.select("id", F.explode(F.flatten(F.array(*[cut(n) for n in (2, 3, 4)]))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("id").alias("sessions"), F.min("id").alias("first"))


GRAMS_SQL = "SELECT item_id, unnest(list_transform(range(1, length(w) - {n} + 2), lambda i: w[i:i + {n} - 1])) AS g FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM benchmark)"
GRAMS = " UNION ALL ".join(GRAMS_SQL.format(n=n) for n in (4, 5, 6))


def mined(spark, sf_dir) -> DataFrame:
    """gram, n, items, first: 4- to 6-grams within words, overlapping ones too."""
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1))), lambda i: F.substr("w", i, F.lit(n)))
    whole = lambda n: F.filter(cut(n), lambda g: F.length(g) == n)
    all_cuts = F.flatten(F.array(*[whole(n) for n in (4, 5, 6)]))
    g = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).select("item_id", F.explode(all_cuts).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"), F.min("item_id").alias("first"))


@query("A11", f"SELECT g AS gram, count(*) AS n, count(DISTINCT item_id) AS items, min(item_id) AS first FROM ({GRAMS}) GROUP BY 1 HAVING count(*) >= 3")
def ngram_gap_candidates(spark, sf_dir) -> DataFrame:
    return mined(spark, sf_dir).filter("n >= 3")


@query("A12", f"WITH m AS (SELECT g AS gram, count(*) AS n FROM ({GRAMS}) GROUP BY 1 HAVING count(*) >= 3) SELECT gram, n FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.n = m.n AND length(b.gram) > length(m.gram) AND contains(b.gram, m.gram))")
def subgram_suppression(spark, sf_dir) -> DataFrame:
    """A gram goes if a longer one with the same count holds it: the longer ones' parts are exploded and joined by equality."""
    m = mined(spark, sf_dir).filter("n >= 3").select("gram", "n")
    part = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("gram") - n + 1, F.lit(1))), lambda i: F.substr("gram", i, F.lit(n)))
    parts = m.filter(F.length("gram") > 4).select("n", "gram", F.explode(F.flatten(F.array(part(4), part(5)))).alias("sub")).filter(F.length("sub") < F.length("gram"))
    return m.join(parts.select("n", F.col("sub").alias("gram")), ["gram", "n"], "left_anti")


ORDERED = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
STOPS = ", ".join(f"'{w}'" for w in D.STOP_WORDS)
TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*(?:[''-][a-z0-9]+)*'), lambda x: x NOT IN (" + STOPS + "))"


@query("F32 F33 X09", f"""WITH e0 AS (SELECT item_id, text, lower(split_part(text, ' ', 1)) AS word, lower(split_part(text, ' ', 2)) AS alt, list_concat(CASE WHEN length(text) <= 160 THEN [lower(text)] ELSE [] END, {TOKENS}) AS rest FROM benchmark),
e1 AS (SELECT *, list_filter(list_concat([word, alt], rest), lambda x: x <> '' AND length(x) <= 160) AS l FROM e0), e AS (SELECT item_id, text, word, alt, unnest(list_slice({ORDERED.format(l='l')}, 1, 64)) AS key FROM e1),
q0 AS (SELECT conv_id, turn, regexp_extract_all(lower(trim(text))[:600], '[a-z][a-z''-]{{1,39}}') AS l FROM conversations), q AS (SELECT conv_id, turn, unnest(list_slice({ORDERED.format(l='l')}, 1, 80)) AS key FROM q0),
h AS (SELECT conv_id, turn, item_id, any_value(word) AS word, any_value(length(text)) AS len, min(CASE WHEN key IN (word, alt) THEN 0 ELSE 1 END) AS rank FROM q JOIN e USING (key) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER w AS i FROM h WINDOW w AS (PARTITION BY conv_id, turn ORDER BY rank, word, item_id) QUALIFY row_number() OVER w <= 12),
b AS (SELECT *, CAST(coalesce(sum(least(240, len)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM r)
SELECT conv_id, turn, item_id, rank, least(240, len, 2400 - used) AS chars FROM b WHERE used < 2400""")
def dictionary_references(spark, sf_dir) -> DataFrame:
    """References of every turn: entries that share a key with it, 12 at most, those whose word it has first, within 2,400 characters."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("word"), F.lower(F.split_part("text", F.lit(" "), F.lit(2))).alias("alt"))
    e = b.select("item_id", "word", "alt", F.length("text").alias("len"), F.explode(D.entry_keys(F.col("word"), F.col("alt"), F.array("text"))).alias("key"))
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(D.query_keys(F.col("text"))).alias("key"))
    rank = F.min(F.when((F.col("key") == F.col("word")) | (F.col("key") == F.col("alt")), 0).otherwise(1))
    h = q.join(e, "key").groupBy("conv_id", "turn", "item_id").agg(F.first("word").alias("word"), F.first("len").alias("len"), rank.alias("rank"))
    w = Window.partitionBy("conv_id", "turn").orderBy("rank", "word", "item_id")
    first = h.withColumn("i", F.row_number().over(w)).filter("i <= 12")
    used = F.coalesce(F.sum(F.least(F.lit(240), F.col("len"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("used", used).filter("used < 2400").select("conv_id", "turn", "item_id", "rank", F.least(F.lit(240), F.col("len"), 2400 - F.col("used")).alias("chars"))


@query("", """SELECT item_id, CAST(i AS BIGINT) AS line, trim(split_part(l, ' ', 1)) AS term, trim(l[length(split_part(l, ' ', 1)) + 1:]) AS target FROM (SELECT item_id, unnest(string_split(text, '. ')) AS l, unnest(range(1, len(string_split(text, '. ')) + 1)) AS i FROM benchmark) WHERE trim(l) <> '' AND i <= 40""")
def glossary_parse(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ")).alias("i", "l")).filter((F.trim("l") != "") & (F.col("i") < 40))
    term = F.split_part("l", F.lit(" "), F.lit(1))
    return lines.select("item_id", (F.col("i") + 1).cast("long").alias("line"), F.trim(term).alias("term"), F.trim(F.substr("l", F.length(term) + 1)).alias("target"))


@query("F39", "SELECT p_brand AS word, arg_max(p_type, p_partkey) AS target FROM part WHERE length(p_brand) <= 16 AND p_size > 5 GROUP BY 1")
def hotword_map(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").filter((F.length("p_brand") <= 16) & (F.col("p_size") > 5)).groupBy(F.col("p_brand").alias("word")).agg(F.max_by("p_type", "p_partkey").alias("target"))


@query("F40", "SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS bad FROM embeddings GROUP BY 1")
def vector_dim_check(spark, sf_dir) -> DataFrame:
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))


@query("X11", """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, v.vec_id, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS c FROM q JOIN embeddings v ON v.vec_id <> query_id)
SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) <= 8""")
def cosine_topk(spark, sf_dir) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    return cosine_top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 8)


@query("X12", """SELECT d.doc_id, c.item_id FROM documents d JOIN (SELECT item_id, sha256(trim(split_part(text, ' ', 1))) AS h FROM benchmark) c ON sha256(trim(split_part(d.text, ' ', 1))) = c.h QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY c.item_id) <= 3""")
def cached_context(spark, sf_dir) -> DataFrame:
    topic = F.sha2(F.trim(F.split_part("text", F.lit(" "), F.lit(1))), 256)
    first = F.row_number().over(Window.partitionBy("h").orderBy("item_id"))
    cache = table(spark, sf_dir, "benchmark").select(topic.alias("h"), "item_id").withColumn("r", first).filter("r <= 3")  # ranked before anything of a topic is gathered
    d = table(spark, sf_dir, "documents").select("doc_id", topic.alias("h"))
    return d.join(cache, "h").select("doc_id", "item_id")
