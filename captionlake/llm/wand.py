"""Ranked lexical search by variable-block-max WAND.

Documents are dealt into shards as they come, and each shard gets its own inverted index, so postings are shuffled
only where a query asks for them. Dynamic programming cuts every posting list into blocks of any length, so that the
sum of what the blocks' maxima overstate, plus a price for each block, is least. A shard is searched interval by
interval: where the block maxima of a query's terms add up to less than its k-th best score so far, whole blocks
are skipped; what is left is scored exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, tidy, written

#: Documents and words of a shard at most (a longer document is a shard of its own).
SHARD_DOCS, SHARD_WORDS = 4096, 1 << 21
#: Postings of a block at most, and what a block costs: as many times the mean score of its list.
BLOCK, BLOCK_PRICE = 64, 6
#: Documents that are scored first, in order of their bounds, to find a threshold.
FIRST = 64
#: Words of the queries of a wave (about).
WAVE_WORDS = 1 << 20
#: Rows of texts that a task reads at a time.
ROWS_AT_ONCE = 512

#: Letters and digits in lower case, everything beyond ASCII as it is, all else a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8: maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z in lower case."""
    return (text or "").encode().translate(FOLD).split()


def lexical_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The inverted index: a row (shard, term, docs, counts) for each term of a shard, with the places of its documents in
    the shard and its occurrences in each (32-bit, packed); and a row without term for the shard, with keys and lengths (64-bit, packed).

    A document without terms isn't in the index, a null key is stored as the least long. Written with written(): it outlives lost executors.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n_shards = TaskContext.get().partitionId(), 0
        ids, lengths, words, names, places, counts = [], [], 0, {}, [], []

        def shard() -> pd.DataFrame:
            nonlocal n_shards, words
            each = np.array([len(x) for x in counts], "int64")
            doc = np.repeat(np.arange(len(ids), dtype="<u4"), each)
            place, count = np.concatenate(places), np.concatenate(counts)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(len(names) + 1)) * 4
            d, c = doc[order].tobytes(), count[order].tobytes()
            out = pd.DataFrame({"shard": part << 32 | n_shards, "term": [None, *names], "docs": [np.array(ids, "<i8").tobytes(), *(d[i:j] for i, j in zip(cuts, cuts[1:], strict=False))], "counts": [np.array(lengths, "<i8").tobytes(), *(c[i:j] for i, j in zip(cuts, cuts[1:], strict=False))]})
            n_shards, words = n_shards + 1, 0
            for x in (ids, lengths, names, places, counts):
                x.clear()
            return out

        for b in batches:
            for k, t in zip(b["k"], b["t"], strict=True):
                if not (found := terms(t)):
                    continue
                if ids and (len(ids) == shard_docs or words + len(found) > shard_words):
                    yield shard()
                tf = Counter(found)
                ids.append(k)
                lengths.append(len(found))
                words += len(found)
                places.append(np.fromiter((names.setdefault(w, len(names)) for w in tf), "<u4", len(tf)))
                counts.append(np.fromiter(tf.values(), "<u4", len(tf)))
        if ids:
            yield shard()

    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(text).alias("t"))
    return written(slim.mapInPandas(build, "shard long, term binary, docs binary, counts binary"), ROWS_AT_ONCE)


def cut_blocks(scores: list[np.ndarray], most: int = BLOCK, price: float = BLOCK_PRICE) -> list[np.ndarray]:
    """The ends of the blocks of each posting list that minimise sum(max * length) + blocks * price * mean, blocks of ``most`` postings at most.

    All lists take a step at a time, the longest first, so each step is a few array operations.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order], "int64")
    start = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([scores[i] for i in order]).astype("float64")
    fee = price * np.add.reduceat(flat, start[:-1]) / sizes
    back = np.zeros(len(flat), "int32")
    # column c: a block that starts at posting i - c (after posting i is taken)
    cost, top = np.full((len(sizes), most), np.inf), np.zeros((len(sizes), most))
    best = np.zeros(len(sizes))
    length = np.arange(1, most + 1)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -i, side="left"))  # lists with more than i postings
        cost[:live, 1:], top[:live, 1:] = cost[:live, :-1], top[:live, :-1].copy()
        cost[:live, 0], top[:live, 0] = best[:live] + fee[:live], 0
        s = flat[start[:live] + i]
        np.maximum(top[:live], s[:, None], out=top[:live])
        total = cost[:live] + top[:live] * length
        at = total.argmin(1)
        best[:live] = total[np.arange(live), at]
        back[start[:live] + i] = at + 1
    out: list[np.ndarray] = [np.empty(0, "int64")] * len(scores)
    for k, i in enumerate(order):
        ends, end, b = [], int(sizes[k]), back[start[k] : start[k + 1]]
        while end > 0:
            ends.append(end)
            end -= int(b[end - 1])
        out[i] = np.array(ends[::-1], "int64")
    return out


class _Shard:
    """Posting lists with their blocks, as flat arrays over all terms of a shard that are asked for."""

    def __init__(self, g: pd.DataFrame, n_docs: int, n_words: int):
        head = g["term"].isna().to_numpy().argmax()
        self.ids = np.frombuffer(g["docs"].iat[head], "<i8")
        lengths = np.frombuffer(g["counts"].iat[head], "<i8")
        self.asked, self.weight = [], []
        docs, scores = [], []
        if 75 * int(lengths.max()) * n_docs < 1 << 62:
            m = 25 + (75 * lengths * n_docs) // n_words
        else:
            m = np.array([25 + 75 * int(n) * n_docs // n_words for n in lengths], "int64")
        for t, d, c, w, items in zip(g["term"], g["docs"], g["counts"], g["w"], g["items"], strict=True):
            if t is not None:
                docs.append(np.frombuffer(d, "<u4").astype("int64"))
                tf = np.frombuffer(c, "<u4").astype("int64")
                scores.append(1_000_000_000 * tf // (1000 * tf + 8 * m[docs[-1]]))
                self.weight.append(int(w))
                self.asked.append(items)
        ends = cut_blocks(scores)
        base = np.cumsum([0, *map(len, docs)])
        self.docs, self.scores = np.concatenate(docs), np.concatenate(scores)
        self.start = np.concatenate([b + np.concatenate([[0], e[:-1]]) for b, e in zip(base, ends, strict=False)])
        self.size = np.concatenate([np.diff(e, prepend=0) for e in ends])
        self.first, self.last = self.docs[self.start], self.docs[self.start + self.size - 1]
        self.top = np.maximum.reduceat(self.scores, self.start)
        self.blocks = np.cumsum([0, *map(len, ends)])

    def queries(self) -> dict[int, list[tuple[int, int]]]:
        """item -> (term's place, occurrences in the item)."""
        out: dict[int, list[tuple[int, int]]] = {}
        for t, items in enumerate(self.asked):
            for x in items:
                out.setdefault(x["item"], []).append((t, x["times"]))
        return out

    def search(self, query: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and keys of documents that score above 0 and may be among the k best, given that ``least`` is reached k times elsewhere."""
        block = np.concatenate([np.arange(self.blocks[t], self.blocks[t + 1]) for t, _ in query])
        each = np.array([self.blocks[t + 1] - self.blocks[t] for t, _ in query])
        weight = np.repeat(np.array([self.weight[t] * times for t, times in query], "int64"), each)
        rise = np.zeros(len(self.ids) + 1, "int64")
        np.add.at(rise, self.first[block], self.top[block] * weight)
        np.add.at(rise, self.last[block] + 1, -self.top[block] * weight)
        bound = np.cumsum(rise)[:-1]
        score, done = np.zeros(len(self.ids), "int64"), np.zeros(len(self.ids), bool)

        def settle(live: np.ndarray) -> None:
            """Score the documents of ``live``; blocks without one are not read."""
            inside = np.concatenate([[0], np.cumsum(live)])
            hit = inside[self.last[block] + 1] > inside[self.first[block]]
            size = self.size[block[hit]]
            at = np.arange(size.sum()) + np.repeat(self.start[block[hit]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            at, w = at[live[self.docs[at]]], np.repeat(weight[hit], size)[live[self.docs[at]]]
            np.add.at(score, self.docs[at], self.scores[at] * w)
            done[live] = True

        least = max(least, 1)
        may = bound >= least
        if may.sum() > FIRST:
            head = np.zeros(len(bound), bool)
            head[np.argpartition(-bound, FIRST)[:FIRST]] = True
            settle(head & may)
            if (done & (score > 0)).sum() >= k:
                least = max(least, int(np.partition(score[done], -k)[-k]))
            may &= (bound >= least) & ~done
        if may.any():
            settle(may)
        at = np.flatnonzero(done & (score >= least))
        return score[at], self.ids[at]


@tidy
def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", index: DataFrame | None = None, wave_words: int = WAVE_WORDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The k best-scoring documents of every item: item, rank (from 1), key, score; equal scores by ascending key.

    Scores are whole numbers. N documents have a term, L terms are in all, n in one; a term that df documents hold weighs
    w = floor(1000 * ln((2N + 2) / (2df + 1))) and adds w * (10^9 tf div (1000 tf + 8m)), m = 25 + 75nN div L, for each
    time it stands in the item. Only scores above 0 count. ``index``: a stored lexical_index() of the documents.

    Null, empty and blank texts have no terms: they are in no count and no result. Very long texts are shards of their
    own. Documents with a null key count in N, L and df but are in no result; rows that repeat a key are ranked each. Items
    with a null key are left out; of items that repeat a key the one of the least text is asked. Other columns are not
    read; no documents, or no items, give an empty result. Keys are longs. Queries are asked in waves of about ``wave_words``
    words, which bounds what a shard is joined with; each wave reads the index once.
    """
    own = index is None
    if own:
        index = lexical_index(docs, key, text, shard_docs)
    heads, lists = index.filter("term IS NULL"), index.filter("term IS NOT NULL")

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": [len(x) // 8 for x in b["counts"]], "l": [int(np.frombuffer(x, "<i8").sum()) for x in b["counts"]]})

    total = heads.select("counts").mapInPandas(lengths, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    n_docs, n_words = total["n"] or 0, total["l"] or 0

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, w, n) for i, t in zip(b["item"], b["t"], strict=True) for w, n in Counter(terms(t)).items()]
            yield pd.DataFrame(rows, columns=["item", "term", "times"]).astype({"item": "int64", "times": "int64"})

    asked = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("t")).filter("item IS NOT NULL AND t IS NOT NULL").groupBy("item").agg(F.min("t").alias("t"))
    asked = written(asked.mapInPandas(words, "item long, term binary, times long"))
    n_waves = max(1, -(-asked.count() // wave_words))
    df = lists.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.octet_length("docs") / 4).cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    asked = written(asked.join(df, "term").select("term", weight.alias("w"), F.struct("item", "times").alias("x"), F.pmod(F.xxhash64("item"), F.lit(n_waves)).alias("wave")))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in runs(batches, "shard"):
            if g["term"].isna().all():
                continue
            shard = _Shard(g, n_docs, n_words)
            for q, query in shard.queries().items():
                s, d = best.get(q, (np.empty(0, "int64"), np.empty(0, "int64")))
                more, ids = shard.search(query, k, int(s[-1]) if len(s) == k else 0)
                keep = ids != -(1 << 63)
                s, d = np.concatenate([s, more[keep]]), np.concatenate([d, ids[keep]])
                order = np.lexsort((d, -s))[:k]
                best[q] = s[order], d[order]
        for q, (s, d) in best.items():
            if len(s):
                yield pd.DataFrame({"item": q, "doc": d, "score": s})

    found = []
    for wave in range(n_waves):
        now = asked.filter(F.col("wave") == wave).groupBy("term").agg(F.first("w").alias("w"), F.collect_list("x").alias("items"))  # bounded by the wave
        rows = lists.join(now, "term").select("shard", "term", "docs", "counts", "w", "items")
        rows = rows.unionByName(heads.select("shard", "term", "docs", "counts", F.lit(None).cast("long").alias("w"), F.lit(None).cast(rows.schema["items"].dataType).alias("items")))
        found.append(written(rows.repartition("shard").sortWithinPartitions("shard").mapInPandas(search, "item long, doc long, score long"), 2048))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc")
    out = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
