"""Exact fuzzy matches of a translation memory: a prefix-filtered similarity join.

A match ratio r = 2M / T of two texts (M matched characters of T in all) bounds what the texts must have in common: at
most T - 2M characters are unmatched, so there are at most T - 2M + 1 matching blocks, and of the texts' trigrams
(with two marks before and behind) at least M + 4 - 2 (T - 2M + 1) are shared. Texts that share so many must share one
of their rarest: only those are joined on. Lengths, bitmaps of trigrams and counts of letters, which all bound M as
well, rule pairs out where they meet, the length of the longest common subsequence does before the ratio is taken.
No trigram and no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..streaming.run import kept

#: The least ratio for which trigrams bound a match; memory texts of a block; bits of a trigram bitmap; counters of letters.
LEAST, BLOCK, BITS, LETTERS = 0.8, 1024, 512, 32
MARKS = "\x01\x01", "\x02\x02"


def least_matched(total, ratio: float):
    """The least number of matched characters of two texts with ``total`` in all."""
    return np.ceil(np.asarray(total) * ratio / 2 - 1e-9).astype("int64")


def least_shared(total, ratio: float):
    """The least number of marked trigrams that two such texts share, repeats counted."""
    m = least_matched(total, ratio)
    return m + 4 - 2 * (np.asarray(total) - 2 * m + 1)


def prefix_length(length: int, ratio: float) -> int:
    """How many of the rarest trigrams of a text are joined on, so that no partner of any length is missed."""
    other = np.arange(int(np.ceil(length * ratio / (2 - ratio) - 1e-9)), int(length * (2 - ratio) / ratio + 1e-9) + 1)
    return int((length + 2 - least_shared(length + other, ratio) + 1).max())


def marked(text: str) -> list[str]:
    t = MARKS[0] + text + MARKS[1]
    return [t[i : i + 3] for i in range(len(t) - 2)]


def _signature(text: str) -> bytes:
    """A bitmap of the trigrams and counts (255 at most) of the letters of a text, by hashes."""
    bits, letters = np.zeros(BITS, bool), np.zeros(LETTERS, "int64")
    bits[[xxhash.xxh32_intdigest(g) % BITS for g in marked(text)]] = True
    np.add.at(letters, [ord(c) * 2654435761 % (1 << 32) >> 27 for c in text], 1)
    return np.packbits(bits, bitorder="little").tobytes() + np.minimum(letters, 255).astype("uint8").tobytes()


@F.pandas_udf(BinaryType())
def signature(texts: pd.Series) -> pd.Series:
    return texts.map(_signature)


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio_from(least: float):
    """A function of two texts: their match ratio where it is ``least`` or more, else null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float | None:
            total = len(x) + len(y)
            if total and 2 * common_length(x, y) < least * total - 1e-9:
                return None
            r = SequenceMatcher(None, x, y, autojunk=False).ratio()
            return r if r >= least else None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def _tokens(texts: DataFrame, ratio: float) -> DataFrame:
    """side, id, token for the rarest trigrams of each text; the n-th occurrence of a trigram in a text is a token of its own. Rarity is counted over all texts."""
    length = F.length("t")
    t = F.concat(F.lit(MARKS[0]), F.col("t"), F.lit(MARKS[1]))
    grams = F.transform(F.sequence(F.lit(1), length + 2), lambda i: F.substr(t, i, F.lit(3)))
    rows = texts.select("side", "id", length.alias("len"), F.explode(grams).alias("g"))
    each = rows.groupBy("side", "id", "len", "g").agg(F.count("*").alias("n")).select("side", "id", "len", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.concat(F.col("g"), i.cast("string")))).alias("token"))
    df = each.groupBy("token").agg(F.count("*").alias("df"))

    @F.pandas_udf("int")
    def prefix(lengths: pd.Series) -> pd.Series:
        known = {n: prefix_length(n, ratio) for n in lengths.unique()}
        return lengths.map(known)

    w = Window.partitionBy("side", "id").orderBy("df", "token")
    return each.join(df, "token").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= prefix(F.col("len"))).select("side", "id", "token")


def similar_texts(queries: DataFrame, memory: DataFrame, text: str, least: float) -> DataFrame:
    """q, m, ratio: distinct query texts and memory texts whose match ratio is ``least`` or more and under 1. Empty texts match nothing."""
    if least < LEAST:
        raise ValueError(f"trigrams bound ratios of {LEAST} or more")
    distinct = lambda d, side: d.select(F.lit(side).alias("side"), F.col(text).alias("t")).filter("t <> ''").distinct()
    texts = kept(distinct(queries, "q").unionByName(distinct(memory, "m")).withColumns({"id": F.md5(F.col("t").cast("binary")), "sig": signature("t")}))
    tokens = kept(_tokens(texts, least))
    n = tokens.groupBy("token").agg(F.count_if(F.col("side") == "m").alias("ms"), F.count_if(F.col("side") == "q").alias("qs")).filter("ms > 0 AND qs > 0")
    n = kept(n.select("token", F.ceil(F.col("ms") / BLOCK).alias("blocks")))
    met = tokens.join(n, "token")
    # a token's memory texts are dealt into blocks, and its queries visit each block
    own = met.filter("side = 'm'").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    visits = met.filter("side = 'q'").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = own.unionByName(visits).select("token", "block", "side", "id").join(texts.select("side", "id", F.length("t").alias("len"), "sig"), ["side", "id"])

    def arrays(rows: list) -> tuple:
        ids, lens, sigs = zip(*rows, strict=True)
        raw = np.frombuffer(b"".join(sigs), "uint8").reshape(len(ids), -1)
        return np.array(ids), np.array(lens, "int64"), np.ascontiguousarray(raw[:, : BITS // 8]).view("<u8"), raw[:, BITS // 8 :].astype("int16")

    def pairs(memory: list, asked: list) -> pd.DataFrame:
        """Pairs of a block that no bound rules out."""
        ids, n, bits, letters = arrays(memory)
        q_ids, q_n, q_bits, q_letters = arrays(asked)
        out = []
        for i in range(len(q_ids)):
            total = n + q_n[i]
            at = np.flatnonzero(2 * np.minimum(n, q_n[i]) >= least * total - 1e-9)
            m, shared = least_matched(total[at], least), least_shared(total[at], least)
            fits = (q_n[i] + 2 - np.bitwise_count(q_bits[i] & ~bits[at]).sum(1) >= shared) & (n[at] + 2 - np.bitwise_count(bits[at] & ~q_bits[i]).sum(1) >= shared)
            at, m = at[fits], m[fits]
            over = letters[at] - q_letters[i]  # counts of 255 may stand for more
            capped = (letters[at] == 255).any(1) | (q_letters[i] == 255).any()
            at = at[(np.abs(over).sum(1) <= total[at] - 2 * m) | capped]
            out += [(q_ids[i], x) for x in ids[at] if x != q_ids[i]]
        return pd.DataFrame(out, columns=["q_id", "m_id"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted: of each token and block the memory texts, then the queries."""
        now, held, asked = None, [], []
        for b in batches:
            for token, block, side, i, n, sig in b[["token", "block", "side", "id", "len", "sig"]].itertuples(index=False, name=None):
                if (token, block) != now:
                    if held and asked:
                        yield pairs(held, asked)
                    now, held, asked = (token, block), [], []
                (held if side == "m" else asked).append((i, n, sig))
                if len(asked) == BLOCK:
                    if held:
                        yield pairs(held, asked)
                    asked = []
        if held and asked:
            yield pairs(held, asked)

    found = kept(dealt.repartition("token", "block").sortWithinPartitions("token", "block", "side").mapInPandas(meet, "q_id string, m_id string").distinct())
    of = lambda side, to: texts.filter(F.col("side") == side).select(F.col("id").alias(f"{to}_id"), F.col("t").alias(to))
    rated = found.join(of("q", "q"), "q_id").join(of("m", "m"), "m_id").withColumn("ratio", ratio_from(least)(F.col("q"), F.col("m")))
    return rated.filter("ratio < 1").select("q", "m", "ratio")


def fuzzy_matches(queries: DataFrame, memory: DataFrame, q: str, m: str, text: str, least: float = 0.86, k: int = 3) -> DataFrame:
    """For each query the k best memory texts with a match ratio of ``least`` to under 1: q, rank, m, ratio; ties to the smaller m.

    Distinct texts are compared, and copies joined back: of a memory text its k smallest keys at most, which is all that k places hold. Null and empty texts match nothing.
    """
    like = kept(similar_texts(queries, memory, text, least))
    first: Column = F.row_number().over(Window.partitionBy("m").orderBy("_m"))
    copies = memory.select(F.col(text).alias("m"), F.col(m).alias("_m")).withColumn("_c", first).filter(F.col("_c") <= k).drop("_c")
    best = Window.partitionBy("q").orderBy(F.desc("ratio"), "_m")
    ranked = kept(like.join(copies, "m").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("q", "rank", F.col("_m").alias("m_key"), "ratio"))
    return queries.select(F.col(q).alias("_q"), F.col(text).alias("q")).join(ranked, "q").select(F.col("_q").alias(q), "rank", F.col("m_key").alias(m), "ratio")
