"""Terms of a glossary in lines: leftmost, then longest; what a prompt takes from a line and its context; locked terms that a translation misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import TERM_CHARS, hits_of

#: Characters of a term at least, lines of context, terms of a prompt.
LEAST, CONTEXT, MOST = 2, 4, 40


def _starts(automaton, text: str) -> list[tuple[int, str]]:
    """At each place where terms begin, the longest."""
    longest: dict[int, str] = {}
    for end, word in automaton.iter(text):
        at = end - len(word) + 1
        if len(word) > len(longest.get(at, "")):
            longest[at] = word
    return sorted(longest.items())


def matched(lines: DataFrame, terms: DataFrame, keys: list[str], text: str, term: str, most_chars: int = TERM_CHARS) -> DataFrame:
    """``lines`` (of distinct keys) with found: the terms of two characters or more that stand in the text, from left to right, at each place the longest, none within another."""
    long = terms.filter(F.length(term) >= LEAST)
    hits = hits_of(lines, long.select(F.col(term).alias("_hits")), text, "_hits", _starts, "array<struct<at:int,term:string>>", most_chars)
    each = hits.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("_hits")), lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(F.length(b["term"]) - F.length(a["term"]))).alias("_h"))  # a row for each wave of terms
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("picked"))

    def pick(s, h):
        return F.when(h["at"] < s["end"], s).otherwise(F.struct((h["at"] + F.length(h["term"])).alias("end"), F.array_append(s["picked"], h["term"]).alias("picked")))

    picked = each.select(*keys, F.aggregate("_h", zero, pick)["picked"].alias("found"))
    return lines.join(picked, keys, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))


def prompt_terms(found: DataFrame, session: list[str], order: str) -> DataFrame:
    """With prompt: the distinct terms of a line's found, then those of the four lines before it, oldest first; forty at most."""
    before = F.flatten(F.collect_list("found").over(Window.partitionBy(*session).orderBy(order).rowsBetween(-CONTEXT, -1)))
    return found.withColumn("prompt", F.slice(F.array_distinct(F.concat("found", before)), 1, MOST))


def missing_locked(found: DataFrame, terms: DataFrame, keys: list[str], translation: str) -> DataFrame:
    """keys, term, target: locked terms (term, target, locked) of a line whose target doesn't stand in its translation as whole words, in any case, with hyphens as spaces."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("-"), F.lit(" "))), r"\s+", " "))
    each = found.select(*keys, translation, F.explode(F.array_distinct("found")).alias("term"))
    locked = terms.filter("locked").select("term", "target")
    there = F.rlike(plain(F.col(translation)), F.concat(F.lit(r"(?<!\w)\Q"), plain(F.col("target")), F.lit(r"\E(?!\w)")))
    return each.join(locked, "term").filter(~F.coalesce(there, F.lit(False)) | (plain(F.col("target")) == "")).select(*keys, "term", "target")
