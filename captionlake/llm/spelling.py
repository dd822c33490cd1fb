"""Spelling variants by full neighbourhood generation.

Every word emits all distinct strings that one deletion, replacement or insertion over the observed alphabet makes of
it; those that are words are its near words, without any distance being computed. Strings are first told by hashes
that follow from the word's own hash in constant time, and a Bloom filter of the vocabulary drops almost all of them
before they become strings; the join with the vocabulary is on the strings and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, tidy, written

#: Bits of the filter a word, hashes a word, and words of a wave: a wave's filter has 64 MB at most.
FILTER_BITS, HASHES, WAVE_WORDS = 32, 3, 1 << 24
#: Words that a task takes (some 15 million strings), and strings that are hashed at a time.
TASK_WORDS, AT_ONCE = 1 << 14, 1 << 20
#: An odd base of the polynomial hash, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def observed_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, slip: int = 97) -> DataFrame:
    """word, n: the words of whole texts with at least ``least_length`` code points and ``least_count`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z in lower case. A run whose crc32 of ``<key>:<run>`` is
    divisible by ``slip`` loses the code point at that sum modulo its length (a planted slip of the pen). Null texts have no
    words; a null key counts as an empty one. Counts are sums, so repeated rows and hot words cost an aggregate.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), run.alias("r"))
    runs = runs.select("k", F.when(F.col("r").rlike("[A-Z]"), F.translate("r", UPPER, LOWER)).otherwise(F.col("r")).alias("r"))
    runs = runs.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "r")))
    at = (F.col("h") % F.length("r")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))).otherwise(F.col("r"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(words: list[str]) -> np.ndarray:
    """Code points plus one, a row for each of some words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype("uint64") + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [BASE] * n, "uint64"))


def word_hashes(words: list[str]) -> np.ndarray:
    """A polynomial hash of each of some words of one length."""
    c = _codes(words)
    return (c * _powers(c.shape[1])[:-1]).sum(1, dtype="uint64")


def neighbours(words: list[str], alphabet: np.ndarray, may) -> Iterator[tuple[int, str]]:
    """(place of a word, string) for all distinct strings one edit away from some words of one length whose hashes ``may`` lets pass.

    Of edits that make one string only one counts: of equal letters in a row the first is deleted, and a letter is inserted before its
    like and not behind it. Edits of three kinds differ in length, and replacements in their place.
    """
    c, letters = _codes(words), alphabet.astype("uint64") + np.uint64(1)
    k, n = c.shape
    p = _powers(n + 1)
    upto = np.concatenate([np.zeros((k, 1), "uint64"), np.cumsum(c * p[:n], axis=1, dtype="uint64")], 1)
    rest = upto[:, -1:] - upto
    # deletions: [word, place]
    gone = upto[:, :-1] + rest[:, 1:] * np.uint64(INVERSE)
    new = np.ones((k, n), bool)
    new[:, 1:] = c[:, 1:] != c[:, :-1]
    for w, i in np.argwhere(may(gone) & new):
        yield w, words[w][:i] + words[w][i + 1 :]
    # replacements: [word, place, letter]
    h = upto[:, -1, None, None] + (letters[None, None, :] - c[:, :, None]) * p[None, :n, None]
    for w, i, a in np.argwhere(may(h) & (c[:, :, None] != letters[None, None, :])):
        yield w, words[w][:i] + chr(alphabet[a]) + words[w][i + 1 :]
    # insertions: [word, place, letter]
    h = upto[:, :, None] + letters[None, None, :] * p[None, : n + 1, None] + rest[:, :, None] * np.uint64(BASE)
    new = np.ones((k, n + 1, len(letters)), bool)
    new[:, 1:] = c[:, :, None] != letters[None, None, :]
    for w, i, a in np.argwhere(may(h) & new):
        yield w, words[w][:i] + chr(alphabet[a]) + words[w][i:]


def _of_one_length(words: list[str], most: int) -> Iterator[list[str]]:
    """Words of one length, at most ``most`` code points in all and one word at least."""
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for n, some in by.items():
        step = max(1, most // max(n, 1))
        yield from (some[i : i + step] for i in range(0, len(some), step))


@tidy
def spelling_variants(words: DataFrame, word: str = "word", count: str = "n", wave_words: int = WAVE_WORDS) -> DataFrame:
    """Group words by the more frequent spelling that each leads to.

    ``words`` has a row for each word and its count. Returns word, form (its near word of largest count, ties to the least in
    code-point order, if that count is twice the word's or more; else null), root (where forms lead in the end, the word itself if it
    has none), n, n_near and form_n. Two words are near if one deletion, insertion or replacement of a code point makes one of the other.

    Null words and counts are left out, the empty word is a word; words of any length are edited at every place; rows that repeat a word are added
    up. Other columns are not read; an empty table gives an empty result. Nothing is capped: a word with many near words is an aggregate.

    The alphabet (at most as many letters as words use) and a wave's filter (64 MB at most) pass through the driver; a larger vocabulary takes more waves.
    """
    spark = words.sparkSession
    vocabulary = words.select(F.col(word).alias("word"), F.col(count).cast("long").alias("n")).filter("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = written(vocabulary)
    size = vocabulary.count()
    n_waves = max(1, -(-size // wave_words))
    bits = 1 << max(15, (FILTER_BITS * -(-size // n_waves) - 1).bit_length())
    alphabet = np.array(sorted(ord(r[0]) for r in vocabulary.filter("word != ''").select(F.explode(F.expr("transform(sequence(1, length(word)), i -> substring(word, i, 1))"))).distinct().collect()), "int64")

    def place_of(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(20)) & np.uint64(bits - 1)

    def wave_of(h: np.ndarray) -> np.ndarray:
        return _mix(h) % np.uint64(n_waves)

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for some in _of_one_length(list(b["word"]), AT_ONCE):
                h = word_hashes(some)
                wave, x = wave_of(h).astype("int64"), h
                for _ in range(HASHES):
                    x = _mix(x + np.uint64(BASE))
                    at = place_of(x).astype("int64")
                    yield pd.DataFrame({"wave": wave, "chunk": at >> 15, "bit": at & 32767})

    marked = vocabulary.select("word").mapInPandas(marks, "wave long, chunk long, bit long").groupBy("wave", "chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))
    marked = written(marked)
    many = vocabulary.select("word").repartition(max(1, -(-size // TASK_WORDS)), "word")
    near = None
    for wave in range(n_waves):
        table = bytearray(bits // 8)
        for r in marked.filter(F.col("wave") == wave).toLocalIterator():
            table[r["chunk"] << 12 : (r["chunk"] + 1) << 12] = r["bits"]
        sent = spark.sparkContext.broadcast(bytes(table))

        def emit(batches: Iterator[pd.DataFrame], wave=wave, sent=sent) -> Iterator[pd.DataFrame]:
            seen = np.frombuffer(sent.value, "uint8")

            def may(h: np.ndarray) -> np.ndarray:
                flat = h.ravel()
                left = np.flatnonzero(wave_of(flat) == wave) if n_waves > 1 else np.arange(flat.size)
                x = flat[left]
                for _ in range(HASHES):
                    x = _mix(x + np.uint64(BASE))
                    at = place_of(x)
                    hit = (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("uint8")) & 1 == 1
                    left, x = left[hit], x[hit]
                out = np.zeros(flat.size, bool)
                out[left] = True
                return out.reshape(h.shape)

            for b in batches:
                for some in _of_one_length(list(b["word"]), max(1, AT_ONCE // max(1, len(alphabet)))):
                    rows = [(some[w], s) for w, s in neighbours(some, alphabet, may)]
                    yield pd.DataFrame(rows, columns=["word", "near"])

        pairs = written(many.mapInPandas(emit, "word string, near string"))
        near = pairs if near is None else near.unionByName(pairs)
    hits = near.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = hits.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("b"))
    led = F.col("b.minus") <= -2 * F.col("n")
    out = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("b.near")).alias("form"), F.when(led, -F.col("b.minus")).alias("form_n"))
    out = written(out)
    # counts at least double from word to form, so the way up has 63 steps at most; each round doubles the reach
    up = written(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        jumped = written(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_written(up)
        up = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return out.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
