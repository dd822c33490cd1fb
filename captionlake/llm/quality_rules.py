"""Quality rules with adaptive thresholds (DataFrame functions only).

Each rule's values are summarised per language and source in a mergeable quantile sketch: counts in
buckets whose width is at most 1/32 of their value, so sketches of parts add up to the sketch of the whole,
in any order. Fences come from the sketch's quartiles and are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rule -> (numerator, scale, least margin beyond the quartile). Values are scale * numerator / n_words.
RULES = {"word_length": ("word_chars", 100, 150), "symbols": ("n_symbols", 1000, 100), "dup_lines": ("n_dup_lines", 1000, 50), "repeats": ("n_repeat_words", 1000, 300)}
#: Fence: q75 + SPREAD * (q75 - q25) + margin. Groups of fewer than LEAST documents take the sketch merged over their language, small languages that of all.
SPREAD, LEAST = 3, 100
SALTS = 16


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) to ``docs``.

    Null and empty texts have zeros. 3-word windows are told apart by 64-bit hashes within their document.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.withColumns({"_cl_w": F.array_remove(F.split(t, SPACE, -1), ""), "_cl_l": F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)})
    w = F.col("_cl_w")
    n = F.size(w)
    h = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    a = a.withColumns({"n_words": n.cast("long"), "_cl_h": h})
    # documents without a repeated window are done; the others sort their windows by (hash, place)
    again = F.size(F.array_distinct("_cl_h")) < F.size("_cl_h")
    a = a.withColumn("_cl_s", F.when(again, F.array_sort(F.transform("_cl_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s, k = F.col("_cl_s"), F.size("_cl_s")
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    before, after = F.concat(F.array(none), F.slice(s, 1, k - 1)), F.concat(F.slice(s, 2, k - 1), F.array(none))
    same = F.zip_with(F.zip_with(before, after, lambda x, y: F.struct(x["h"].alias("b"), y["h"].alias("a"))), s, lambda n, x: F.when(n["b"].eqNullSafe(x["h"]) | n["a"].eqNullSafe(x["h"]), x["i"]))
    a = a.withColumn("_cl_p", F.when(s.isNotNull(), F.array_sort(F.filter(same, lambda x: x.isNotNull()))))
    # windows at places p cover p, p + 1, p + 2; each adds what the next one doesn't cover
    nexts = F.concat(F.slice("_cl_p", 2, 2_000_000_000), F.array(F.lit(1 << 30)))
    covered = F.aggregate(F.zip_with("_cl_p", nexts, lambda x, y: F.least(y - x, F.lit(3))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return a.withColumns({
        "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_cl_l") - F.size(F.array_distinct("_cl_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    }).drop("_cl_w", "_cl_l", "_cl_h", "_cl_s", "_cl_p")


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value >= 0: below 64 the value, then 32 buckets for each power of two."""
    e = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (32 * e + F.floor(value / F.pow(F.lit(2.0), e))).cast("long")


def bucket_floor(b: Column) -> Column:
    e = F.greatest(F.floor(b / 32) - 1, F.lit(0))
    return ((b - 32 * e) * F.pow(F.lit(2.0), e)).cast("long")


def rule_values() -> dict[str, Column]:
    return {name: F.coalesce(F.floor(F.try_divide(scale * F.col(top), F.col("n_words"))), F.lit(0)).cast("long") for name, (top, scale, _) in RULES.items()}


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the sketch of every language and source."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(v).alias("bucket")) for r, v in rule_values().items()])).alias("x")
    return counts.filter(~F.col("base_failed")).select("lang", "source", pairs).groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches to the level of ``keys`` and read q25, q75 and the number of documents for each rule."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rule")
    run = merged.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})
    at = lambda q: bucket_floor(F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bucket"))))
    return run.groupBy(*keys, "rule").agg(at(1).alias("q25"), at(3).alias("q75"), F.max("all").alias("n"))


@tidy
def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", spread: int = SPREAD, least: int = LEAST) -> DataFrame:
    """Judge every document: fixed base rules, then fences that adapt to its language and source.

    Returns key, the counts of document_counts(), base_failed (fewer than 50 words, or more than half of the
    words in repeated 3-word windows), failed_rules (names of rules whose value is beyond its fence), fence_level
    (source, lang or all: whose sketch gave the fences; null where no document of the group passes the base rules)
    and kept. ``spread`` and ``least`` are SPREAD and LEAST.
    Fences are learnt from the documents that pass the base rules. Null languages and sources are groups of
    their own. Null and empty texts fail the base rules; very long ones are counted whole. Repeated rows are judged alike and all returned.
    Extra columns are not read; an empty table gives an empty result.
    """
    slim = document_counts(docs.select(F.col(key).alias("_cl_key"), "lang", "source", F.col(text).alias("_cl_text")), "_cl_text").drop("_cl_text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = written(slim.withColumn("base_failed", failed))
    sketch = written(sketches(counts))
    # the fences of a group, of its language where the group is small, of all where that is small too
    group, lang, every = quartiles(sketch, ["lang", "source"]), quartiles(sketch, ["lang"]), quartiles(sketch, [])
    group = group.withColumn("k", F.struct("q25", "q75", "n"))
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("rule").alias("l_rule"), F.struct("q25", "q75", "n").alias("l"))
    every = every.select(F.col("rule").alias("e_rule"), F.struct("q25", "q75", "n").alias("e"))  # a row for each rule
    joined = group.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rule") == F.col("l_rule"))).join(F.broadcast(every), F.col("rule") == F.col("e_rule"))
    by = lambda k, l, e: F.when(F.col("k.n") >= least, k).when(F.col("l.n") >= least, l).otherwise(e)
    use, level = by(F.col("k"), F.col("l"), F.col("e")), by(F.lit("source"), F.lit("lang"), F.lit("all"))
    margin = F.create_map(*[F.lit(x) for r, (_, _, m) in RULES.items() for x in (r, m)])
    fence = use["q75"] + spread * (use["q75"] - use["q25"]) + F.element_at(margin, F.col("rule"))
    fences = joined.select("lang", "source", "rule", fence.alias("fence"), level.alias("level")).groupBy("lang", "source").agg(F.max("level").alias("fence_level"), F.map_from_entries(F.collect_list(F.struct("rule", "fence"))).alias("fences"))
    # one source may hold a third of all rows: both sides carry a salt
    right = fences.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), "fences", "fence_level", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    left = counts.withColumn("salt", F.pmod(F.xxhash64("_cl_key", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    both = left.join(right, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")) & (F.col("salt") == F.col("f_salt")), "left")
    broken = F.filter(F.array(*[F.when(v > F.element_at("fences", F.lit(r)), F.lit(r)) for r, v in rule_values().items()]), lambda x: x.isNotNull())
    return both.withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken)).select(
        F.col("_cl_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "fence_level",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
    )
