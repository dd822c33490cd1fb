"""Glossaries: lines of a text to terms, and rules over a set of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.captions import strip
from ..functions.text import match_fold
from .joins import containment

#: Common words that are no aliases.
STOP_ALIASES = ("開始", "法式", "師傅", "社科", "只觀", "工案", "開事", "一座", "產修")
#: Terms of a text, characters of a target and of a term, least characters of an alias.
MOST_TERMS, MOST_TARGET, MOST_TERM, LEAST_ALIAS = 40, 80, 40, 2
#: What ends a line for the lenient reader; for the strict one only a line feed does, and the last three must not occur.
BREAKS, HIDDEN = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", r"[\x85\u2028\u2029]"


def _lines(df: DataFrame, key: str, text: str, breaks: str) -> DataFrame:
    """key, line (from 1), and of lines with a separator (the first =, else the first full-width one) term, target and aliases; no blank lines and comments."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), breaks)).alias("i", "l")).select(key, (F.col("i") + 1).alias("line"), strip(F.col("l")).alias("l")).filter("l <> '' AND NOT startswith(l, '#')")
    mark = F.when(F.contains("l", F.lit("=")), "=").when(F.contains("l", F.lit("＝")), "＝")
    at = F.locate("=", F.col("l"))
    at = F.when(at > 0, at).otherwise(F.locate("＝", F.col("l")))
    parts = F.transform(F.split(F.substr("l", F.lit(1), at - 1), r"\|"), strip)
    cut = lines.withColumn("parts", F.when(mark.isNotNull(), parts)).withColumn("target", F.when(mark.isNotNull(), strip(F.substr("l", at + 1))))
    return cut.select(key, "line", F.element_at("parts", 1).alias("term"), "target", F.slice("parts", 2, 1 << 20).alias("aliases"))


def lenient_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Terms of glossary texts, ``term|alias|alias=target`` a line: cut to their lengths, the first of a text that there is room for, other lines left out. A null text has none."""
    t = _lines(df, key, text, BREAKS).select(key, "line", F.left("term", F.lit(MOST_TERM)).alias("term"), F.left("target", F.lit(MOST_TARGET)).alias("target"), F.filter("aliases", lambda a: a != "").alias("aliases"))
    return t.filter("term <> '' AND target <> ''").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("line"))).filter(F.col("_n") <= MOST_TERMS).drop("_n")


def strict_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Terms of glossary texts all or nothing: key, line, term, target, aliases, reason. A text with a bad line has only its bad lines (reason says why), one with too many terms only the first beyond; one without terms, or with hidden line breaks, a row of line 0."""
    t = _lines(df, key, text, "\n")
    reasons = F.array_compact(F.array(F.when(F.col("term").isNull(), "no_separator"), F.when(F.exists("aliases", lambda a: a == ""), "empty_alias"), F.when((F.col("term") == "") | (F.col("target") == ""), "empty_side")))
    t = t.withColumn("why", reasons).withColumn("long", (F.size("why") == 0) & (F.length("target") > MOST_TARGET))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    good = (F.size("why") == 0) & ~F.col("long")
    t = t.withColumn("n", F.coalesce(F.count_if(good).over(before), F.lit(0))).withColumn("over", (F.size("why") == 0) & (F.col("n") >= MOST_TERMS))
    t = t.withColumn("why", F.when(F.col("long"), F.array(F.lit("long_target"))).otherwise(F.col("why")))
    whole = Window.partitionBy(key)
    t = t.withColumn("over_at", F.min(F.when(F.col("over"), F.col("line"))).over(whole)).withColumn("bad", F.max(F.size("why")).over(whole) > 0)
    t = t.withColumn("why", F.when(F.col("over_at").isNotNull(), F.when(F.col("line") == F.col("over_at"), F.array(F.lit("too_many"))).otherwise(F.array().cast("array<string>"))).otherwise(F.col("why")))
    kept = t.filter("(over_at IS NULL AND NOT bad) OR size(why) > 0").select(key, "line", "term", "target", "aliases", F.explode_outer("why").alias("reason"))
    hidden = df.filter(F.col(text).rlike(HIDDEN)).select(key)
    none = df.select(key).join(hidden, key, "left_anti").join(kept.select(key).distinct(), key, "left_anti")
    row0 = lambda d, why: d.select(key, F.lit(0).alias("line"), *[F.lit(None).cast(k).alias(c) for c, k in (("term", "string"), ("target", "string"), ("aliases", "array<string>"))], F.lit(why).alias("reason"))
    return kept.join(hidden, key, "left_anti").unionByName(row0(hidden, "hidden_break")).unionByName(row0(none, "no_terms"))


def set_violations(terms: DataFrame, key: str | None = None, most: int | None = None) -> DataFrame:
    """Rules over glossaries' rows (id, term, aliases), as id, rule, alias: a term given twice (all rows but the least id), and aliases that are short, common words, a term themselves, inside another term, or of several terms.

    Texts are compared as match_fold() gives them. ``key``: the column that tells the glossary of a row, which the result has too (rows
    where it is null are left out); without it all rows are one glossary. Of a glossary of more than ``most`` rows only
    the first row beyond is given, as too_many.
    """
    of = F.col(key) if key else F.lit(0)
    rows = terms.select(of.alias("_set"), "id", "term", "aliases").filter("_set IS NOT NULL")
    none = F.lit(None).cast("string").alias("alias")
    if most is not None:
        ranked = rows.select("_set", "id", F.row_number().over(Window.partitionBy("_set").orderBy("id")).alias("_n")).filter(F.col("_n") <= most + 1)
        over = ranked.filter(F.col("_n") == most + 1).select("_set", "id")
        rows = rows.join(over.select("_set"), "_set", "left_anti")
    fold = lambda c: match_fold(F.trim(c))
    t = rows.select("_set", "id", fold(F.col("term")).alias("term"), "aliases")
    first = t.groupBy("_set", "term").agg(F.min("id").alias("first"))
    twice = t.join(first, ["_set", "term"]).filter("id <> first").select("_set", "id", F.lit("duplicate").alias("rule"), none)
    # a repeated term's aliases aren't judged
    a = t.join(first.withColumnRenamed("first", "id"), ["_set", "id", "term"]).select("_set", "id", "term", F.explode("aliases").alias("a")).select("_set", "id", "term", fold(F.col("a")).alias("alias")).distinct()
    named = lambda d, rule: d.select("_set", "id", F.lit(rule).alias("rule"), "alias")
    distinct = t.select("_set", "term").distinct()
    owners = a.groupBy("_set", "alias").agg(F.min("term").alias("x"), F.max("term").alias("y")).filter("x <> y").select("_set", "alias")
    long = a.filter(F.length("alias") >= LEAST_ALIAS).select(F.col("alias").alias("_alias")).distinct()
    inside = containment(distinct, long, "term", "_alias").filter("term <> _alias").select("_set", F.col("term").alias("other"), F.col("_alias").alias("alias"))
    inside = a.join(inside, ["_set", "alias"]).filter("other <> term").select("_set", "id", "alias").distinct()
    found = (
        twice.unionByName(named(a.filter(F.length("alias") < LEAST_ALIAS), "short_alias")).unionByName(named(a.filter(F.col("alias").isin(*STOP_ALIASES)), "stop_alias"))
        .unionByName(named(a.join(distinct.select("_set", F.col("term").alias("alias")), ["_set", "alias"], "left_semi"), "alias_is_term")).unionByName(named(inside, "alias_in_term")).unionByName(named(a.join(owners, ["_set", "alias"], "left_semi"), "alias_owners"))
    )
    if most is not None:
        found = found.unionByName(over.select("_set", "id", F.lit("too_many").alias("rule"), none))
    return found.withColumnRenamed("_set", key) if key else found.drop("_set")
