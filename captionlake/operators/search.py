"""Text search over postings that are derived tables: n-grams, words, BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: BM25 parameters.
K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def grams(text: Column, n: int = 3) -> Column:
    """Distinct n-grams of a text; a shorter text is one gram."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(cut)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf and the document's length in words. Text goes no further than its own row, then only terms shuffle."""
    w = words(F.col(text))
    exploded = docs.select(key, F.size(w).cast("long").alias("len"), F.explode(w).alias("term"))
    return exploded.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k: int) -> DataFrame:
    """The k best documents for some terms, ties to the smaller key. Only postings of the query's terms are kept before anything shuffles."""
    w = words(F.col(text))
    sized = docs.select(key, w.alias("_w")).select(key, F.size("_w").cast("long").alias("len"), F.filter("_w", lambda x: x.isin(*terms)).alias("_t"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.sum("len").alias("all_len"))  # one row
    hits = sized.filter(F.size("_t") > 0).select(key, "len", F.explode("_t").alias("term")).groupBy(key, "term", "len").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row for each term
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - B + B * F.col("len") / (F.col("all_len") / F.col("n_docs"))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    return scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def phrase_search(docs: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Documents that hold a phrase. The check by ``contains`` is pruned by nothing here; a table of grams prunes it where one is kept."""
    return docs.filter(F.contains(F.lower(F.col(text)), F.lit(phrase.lower()))).select(key)
