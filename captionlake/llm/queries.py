"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chat, read_back, text_part
from .common import table
from .fm import fit_on_labels, is_held_out, score_documents
from .forest import near_vectors
from .hyperminhash import near_duplicates
from .packing import pack_documents
from .pii import replace_entities
from .quality_rules import quality_rules
from .repeats import remove_repeats
from .sharding import shard_records
from .spelling import observed_words, spelling_variants
from .topk import exact_top_k
from .unigram import encode_documents
from .wand import ranked_search

QUERIES, ORACLES = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op1_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: The secret under which surrogates are drawn; a deployment passes its own.
PII_KEY = "captionlake-example-key"


@query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


@query
def op3_unigram_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


#: Two rows that are formatted beside the table: texts that look like the control strings of a template.
ODD_TURNS = "SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'"


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(ODD_TURNS))
    out = read_back(format_chat(turns.withColumn("parts", text_part(F.col("text")))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )


ORACLES["op7_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>|</?SYS>>|\|[a-z]+\|>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g')) AS n_body,
    length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>|</?SYS>>|\|[a-z]+\|>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g')) AS n_role
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + n_role + 1 + n_body + length('<|end|>') + 1) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM e GROUP BY conv_id
"""

ORACLES["op4_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) > 0) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
v AS (
  SELECT doc_id, lang, source, base_failed, rule, coalesce(CASE WHEN n_words > 0 THEN scale * x // n_words END, 0) AS v, margin FROM f,
  LATERAL (VALUES ('word_length', word_chars, 100, 150), ('symbols', n_symbols, 1000, 100), ('dup_lines', n_dup_lines, 1000, 50), ('repeats', n_repeat_words, 1000, 300)) AS p(rule, x, scale, margin)),
b AS (SELECT *, 32 * greatest(length(bin(v)) - 6, 0) + (v >> greatest(length(bin(v)) - 6, 0)::BIGINT) AS b FROM v),
low AS (SELECT *, (b - 32 * greatest(b // 32 - 1, 0)) << greatest(b // 32 - 1, 0)::BIGINT AS f FROM b),
q AS (
  SELECT lang, source, rule, count(*) AS n, quantile_disc(f, 0.25) AS q25, quantile_disc(f, 0.75) AS q75, any_value(margin) AS margin, GROUPING(lang) AS gl, GROUPING(source) AS gs
  FROM low WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source, rule), (lang, rule), (rule))),
fence AS (
  SELECT k.lang, k.source, k.rule, CASE WHEN k.n >= 100 THEN 'source' WHEN l.n >= 100 THEN 'lang' ELSE 'all' END AS level, CASE WHEN k.n >= 100 THEN k.q75 + 3 * (k.q75 - k.q25) WHEN l.n >= 100 THEN l.q75 + 3 * (l.q75 - l.q25) ELSE e.q75 + 3 * (e.q75 - e.q25) END + k.margin AS fence
  FROM q k JOIN q l ON k.gs = 0 AND l.gs = 1 AND l.gl = 0 AND k.lang IS NOT DISTINCT FROM l.lang AND k.rule = l.rule JOIN q e ON e.gl = 1 AND k.rule = e.rule),
bad AS (SELECT low.doc_id, list(low.rule ORDER BY CASE low.rule WHEN 'word_length' THEN 1 WHEN 'symbols' THEN 2 WHEN 'dup_lines' THEN 3 ELSE 4 END) AS rules
  FROM low JOIN fence ON low.lang IS NOT DISTINCT FROM fence.lang AND low.source IS NOT DISTINCT FROM fence.source AND low.rule = fence.rule WHERE NOT base_failed AND v > fence.fence GROUP BY low.doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(bad.rules, []::VARCHAR[]) AS failed_rules, level AS fence_level, NOT base_failed AND bad.rules IS NULL AS kept
FROM f LEFT JOIN bad USING (doc_id) LEFT JOIN (SELECT DISTINCT lang, source, level FROM fence) x ON f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source
"""


@query
def op5_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=85)


ORACLES["op5_hyperminhash_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS origin, doc_id AS reached FROM n UNION SELECT r.origin, u.b FROM r JOIN u ON r.reached = u.a),
c AS (SELECT origin AS doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


@query
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op11_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op11_block_max_wand"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
p AS MATERIALIZED (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY 1, 2),
q AS MATERIALIZED (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term),
x AS (SELECT q.item_id, p.doc_id, CAST(sum(q.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * n.n * s.nn) // s.ll)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN n ON n.doc_id = p.doc_id, s GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(observed_words(table(spark, sf_dir, "documents")))


@query
def op13_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.9)


ORACLES["op13_projection_forest"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS origin, vec_id AS reached FROM embeddings UNION SELECT r.origin, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT origin AS vec_id, min(reached) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""


#: crc32 by bytes: the table follows from the polynomial; letters beyond ASCII (U+00C0 to U+00FF) are the bytes 195 and the code point less 64.
ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b, list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
t AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY 1, 2),
b AS (SELECT r, n, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END)) AS b FROM t),
h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM b, tab),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
m AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
e AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM m a JOIN m b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT m.word, w.word, w.n FROM m JOIN w ON w.word = m.l || m.r UNION SELECT w.word, m.word, m.n FROM m JOIN w ON w.word = m.l || m.r),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near, CASE WHEN x.best.n >= 2 * w.n THEN x.best.near END AS form, CASE WHEN x.best.n >= 2 * w.n THEN x.best.n END AS form_n
  FROM w LEFT JOIN (SELECT word, count(*) AS n_near, first({'near': near, 'n': n} ORDER BY n DESC, near) AS best FROM e GROUP BY word) x USING (word)),
up AS (SELECT word, word AS top, 0 AS step FROM f UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN f ON f.word = up.top WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(top, step) AS root FROM up GROUP BY word) USING (word)
"""
