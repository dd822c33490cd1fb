"""A stored inverted index: trigrams and tokens of texts as partitioned tables, built once and appended to.

Postings lie in folders by kind and by a hash of the term, sorted by term within files, a row holding those of one term in a
block of neighbouring documents. Blocks are built where their texts are read, so single postings are never shuffled. A search names the folders and
terms it needs, so Spark prunes the others, and intersects the postings from the rarest term on; what is left is checked
on the texts. Texts are never read for terms that no document holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import B, K1

#: Folders of a kind.
BUCKETS = 64
#: Characters of a block of documents, about: a task holds some 40 bytes for each. Files of an append in a folder, at most, or two for each core.
BLOCK_CHARS, FILES = 1 << 21, 64
#: Characters that are tokens of their own, in Spark's and in Python's way, and tokens of a snippet.
HAN_RANGE, HAN_CHARS, SNIPPET = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3134f}", "㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f", 16


TOKEN = rf"[{HAN_RANGE}]|[\p{{L}}\p{{N}}&&[^{HAN_RANGE}]]+"


def tokens(text: Column) -> Column:
    """Tokens in lower case: each Han character, and each run of letters and digits of other scripts."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_tokens(q: str) -> list[str]:
    return re.findall(rf"[{HAN_CHARS}]|[^\W_{HAN_CHARS}]+", q.lower())


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


def distinct_grams(text: str, piece: int = BLOCK_CHARS) -> np.ndarray:
    """The distinct trigrams of a text in order, three code points of 21 bits each; a very long text is cut into pieces that overlap."""
    out = np.zeros(0, "int64")
    for at in range(0, len(text) - 2, piece):
        c = np.frombuffer(text[at : at + piece + 2].encode("utf-32-le"), "<u4").astype("int64")
        new = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
        out = np.unique(np.concatenate([out, new])) if len(out) else new
    return out


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, and the number of rows."""
    change = reduce(np.logical_or, [x[1:] != x[:-1] for x in sorted_columns])
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(sorted_columns[0])]]).astype("int32")


def _gram_postings(keys: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array] | None:
    """term, keys, places (null) of a block's trigrams."""
    each = [distinct_grams(t) for t in texts.to_pylist()]
    grams = np.concatenate(each)
    if not len(grams):
        return None
    order = np.argsort(grams, kind="stable")
    grams, docs = grams[order], np.repeat(np.arange(len(each)), [len(x) for x in each])[order]
    starts = _starts(grams)
    first = grams[starts[:-1]]
    chars = np.stack([first >> 42, first >> 21 & 0x1FFFFF, first & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    terms = pa.array([chars[i : i + 3] for i in range(0, len(chars), 3)], "string")
    return terms, pa.ListArray.from_arrays(starts, keys.take(pa.array(docs))), pa.nulls(len(terms), pa.list_(pa.list_(pa.int32())))


def _token_postings(keys: pa.Array, words: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array] | None:
    """term, keys and for each key the places of a block's tokens."""
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(words.flatten())
    if not len(coded):
        return None
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    codes, docs = codes[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    places = (np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1)[order].astype("int32")
    each = _starts(codes, docs)  # of a term in a document
    of = _starts(codes[each[:-1]])  # of a term
    return (
        coded.dictionary.cast("string").take(pa.array(codes[each[:-1]][of[:-1]])), pa.ListArray.from_arrays(of, keys.take(pa.array(docs[each[:-1]]))),
        pa.ListArray.from_arrays(of, pa.ListArray.from_arrays(each, pa.array(places))),
    )


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, term, keys, places of the blocks of key, t, words."""
    for batch in batches:
        at = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)) // BLOCK_CHARS
        cuts = _starts(at) if len(at) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            keys, texts, words = (batch.column(i).slice(a, b - a) for i in range(3))
            for kind, rows in (("gram", _gram_postings(keys, texts)), ("token", _token_postings(keys, words))):
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows[0]), "string"), *rows], ["kind", "term", "keys", "places"])


class TextIndex:
    """The index of a text column under ``path``: postings (kind, bucket, term, keys, places), lengths (key, len).

    ``add`` appends documents whose keys the index doesn't hold; a document's places are the
    numbers of a token in it, from 1 (trigrams have none). Null and empty texts have no postings. Very long texts and
    frequent terms are rows like others: a term's postings are spread over blocks and files, never gathered.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "long"):
        self.spark, self.path, self.key, self.kind = spark, path.rstrip("/"), key, kind

    def add(self, docs: DataFrame, text: str, files: int | None = None) -> None:
        """Append documents, in ``files`` files of a folder at most. The lengths are written last: a document counts as indexed once they are there, so an append that fails half-way is done again whole."""
        t = docs.select(F.col(self.key).cast(self.kind).alias("key"), F.make_valid_utf8(F.lower(F.col(text))).alias("t")).filter("key IS NOT NULL")
        whole = t.filter(F.length("t") > 0).coalesce(files or max(FILES, 2 * self.spark.sparkContext.defaultParallelism))
        rows = whole.select("key", "t", tokens(F.col("t")).alias("words")).mapInArrow(_postings, f"kind string, term string, keys array<{self.kind}>, places array<array<int>>")
        rows.withColumn("bucket", bucket(F.col("term"))).sortWithinPartitions("kind", "bucket", "term").write.mode("append").option("compression", "zstd").partitionBy("kind", "bucket").parquet(f"{self.path}/postings")
        t.select("key", F.coalesce(F.regexp_count("t", F.lit(TOKEN)), F.lit(0)).cast("long").alias("len")).write.mode("append").parquet(f"{self.path}/lengths")

    def lengths(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.kind}, len long").parquet(f"{self.path}/lengths").groupBy("key").agg(F.max("len").alias("len"))

    def _each(self, condition: Column) -> DataFrame:
        """term, key, places of rows of the index, each term and key once: an append that was done again has the same places again."""
        rows = self.spark.read.schema(f"term string, keys array<{self.kind}>, places array<array<int>>, kind string, bucket int").parquet(f"{self.path}/postings").filter(condition)
        each = rows.select("term", "places", F.posexplode("keys").alias("i", "key")).select("term", "key", F.get("places", F.col("i")).alias("places"))
        return each.groupBy("term", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))

    def postings(self, kind: str, terms: list[str]) -> DataFrame:
        """term, key, places of some terms: only their folders are read."""
        numbers = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket(F.col("term"))).distinct().collect()]  # the query's terms, not the table's
        return self._each((F.col("kind") == kind) & F.col("bucket").isin(*numbers) & F.col("term").isin(*terms))

    def prefixed(self, prefix: str) -> DataFrame:
        """term, key, places of tokens that begin with ``prefix``."""
        return self._each((F.col("kind") == "token") & F.col("term").startswith(prefix))

    def holding(self, kind: str, terms: list[str]) -> DataFrame:
        """Keys of documents that hold all terms: from the rarest on, each further term's postings are only looked up for what is left."""
        rows = self.postings(kind, terms)
        df = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row for each term of the query
        if len(df) < len(set(terms)):
            return rows.select("key").limit(0)
        order = sorted(set(terms), key=lambda t: (df[t], t))
        of = lambda t: rows.filter(F.col("term") == t).select("key")
        return reduce(lambda left, t: left.join(of(t), "key", "left_semi"), order[1:], of(order[0]))

    def phrase(self, words: list[str], last_is_prefix: bool = False) -> DataFrame:
        """Keys of documents in which the tokens stand side by side in order; the last may be a prefix."""
        whole = words[:-1] if last_is_prefix else words
        rows = self.postings("token", whole) if whole else None
        starts = None
        for i, w in enumerate(words):
            p = self.prefixed(w) if last_is_prefix and i == len(words) - 1 else rows.filter(F.col("term") == w)
            here = p.select("key", F.explode("places").alias("at")).select("key", (F.col("at") - i).alias("at")).distinct()
            starts = here if starts is None else starts.join(here, ["key", "at"], "left_semi")
        return starts.select("key").distinct()


def routed(q: str) -> tuple[str, str]:
    """(the way, the question): without spaces where it holds Han characters; three characters or more go to the trigrams, fewer to the tokens."""
    q = ("" if re.search(f"[{HAN_CHARS}]", q) else " ").join(q.split())
    return ("gram" if len("".join(q.split())) >= 3 else "token"), q


def search(index: TextIndex, docs: DataFrame, text: str, q: str, current: Column | None = None) -> DataFrame:
    """key, way: documents that hold ``q`` by the index; documents that aren't in the index yet are looked through. Of old versions, which are indexed too, none is returned unless ``current`` holds.

    The trigrams' way finds the phrase as characters, in any case. The tokens' way finds Han characters side by side, and words that begin with what is asked; mixed
    questions need each part.
    """
    way, q = routed(q)
    rows = docs if current is None else docs.filter(current)
    rows = rows.select(F.col(index.key).alias("key"), F.col(text).alias("t"))
    holds = F.contains(F.lower("t"), F.lit(q.lower()))
    if not q:
        return rows.limit(0).select(F.col("key").alias(index.key), F.lit(way).alias("way"))
    if way == "gram":
        low = q.lower()
        keys = index.holding("gram", sorted({low[i : i + 3] for i in range(len(low) - 2)})) if len(low) >= 3 else None
        found = rows.join(keys, "key", "left_semi").filter(holds)
    else:
        words = query_tokens(q)
        han = [bool(re.match(f"[{HAN_CHARS}]", w)) for w in words]
        if not words:
            keys = index.lengths().select("key").limit(0)
        elif all(han):
            keys = index.phrase(words)
        else:
            parts = [index.postings("token", [w]).select("key") if h else index.prefixed(w).select("key").distinct() for w, h in zip(words, han, strict=True)]
            keys = reduce(lambda a, b: a.join(b, "key", "left_semi"), parts)
        found = rows.join(keys, "key", "left_semi")
    unread = rows.join(index.lengths(), "key", "left_anti").filter(holds)
    return found.unionByName(unread).select(F.col("key").alias(index.key), F.lit(way).alias("way"))


def ranked(index: TextIndex, docs: DataFrame, text: str, words: list[str], k: int) -> DataFrame:
    """key, score, snippet: the k best indexed documents for some words by BM25 (ties to the smaller key), with up to SNIPPET tokens
    around the first hit, in lower case, hits in brackets and … where the text goes on. Only the words' postings and the lengths are read, and the texts of the k documents."""
    words = sorted({w.lower() for w in words})
    lengths = index.lengths()
    stats = lengths.agg(F.count("*").alias("n_docs"), F.sum("len").alias("all_len"))  # one row
    hits = index.postings("token", words).select("term", "key", F.size("places").alias("tf"), F.col("places")[0].alias("at"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row for each word
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(stats)).join(lengths, "key")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (F.col("all_len") / F.col("n_docs"))))
    best = scored.groupBy("key").agg(F.round(F.sum(part), 6).alias("score"), F.min("at").alias("at")).orderBy(F.desc("score"), "key").limit(k)
    t = docs.select(F.col(index.key).alias("key"), F.col(text).alias("t")).join(F.broadcast(best), "key")
    shown = F.transform(F.slice(tokens(F.col("t")), "first", F.lit(SNIPPET)), lambda w: F.when(w.isin(*words), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    t = t.withColumn("n", F.size(tokens(F.col("t")))).withColumn("first", F.greatest(F.lit(1), F.least(F.col("at") - SNIPPET // 4, F.col("n") - SNIPPET + 1)).cast("int"))
    snippet = F.concat(F.when(F.col("first") > 1, "… ").otherwise(""), F.array_join(shown, " "), F.when(F.col("first") + SNIPPET <= F.col("n"), " …").otherwise(""))
    one = t.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("t"))).filter("r = 1")
    return one.select(F.col("key").alias(index.key), "score", snippet.alias("snippet"))
