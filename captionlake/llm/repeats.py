"""Repeated passages by suffix sorting, with a column-wise construction for many texts.

Texts are cut into short segments such that equal windows of WINDOW bytes always meet in one group, and at the
same place: windows that follow each other and share the gram of least hash (their minimizer) are one segment,
and segments with equal minimizers are one group, aligned at it. Groups of one segment, or of copies of one,
need no sorting. The others are dealt to tasks; each task inserts one symbol of every segment a round, from
the last column to the first, and updates the order of the suffixes (the column of the collection's
Burrows-Wheeler transform) and the common prefixes of neighbours by one sequential pass over the column before.
Neighbours with a common prefix of WINDOW bytes are repeated windows.

As equal windows stand in the same column, suffixes of different columns needn't be compared, so a round costs
the number of segments and not that of all suffixes so far.

A group of more than ``largest`` distinct segments is subdivided by content: its columns are cut into stripes, and
the bytes that all windows of a stripe have in common are the key of a smaller group of shorter segments, in
which the same is done again. Stripes of one column hold copies of one window, which need no sorting. So no
task holds a group that grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, tidy, written

#: Bytes of a window, and of a gram (a power of two).
WINDOW, GRAM = 200, 32
#: Bytes that are hashed at a time (longer texts in overlapping parts), segments that a task sorts at a time, and rows that a task reads at a time where rows hold texts.
CHUNK, SORTED, ROWS_AT_ONCE = 1_000_000, 40_000, 512
#: Segments that are put into columns at a time: each of their bytes takes some 25 bytes of indices meanwhile.
PLACED = 1_000
#: Distinct segments of a group that are sorted together; larger groups are subdivided.
LARGEST = 256
#: Bits of a gram's hash that order minimizers; the others hold its place. Grams that agree in them tie in any text, and the leftmost wins.
PLACE_BITS = np.uint64(31)
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, "uint64")
#: Columns of an aligned group: those before the minimizer, and those from it on.
BEFORE = WINDOW - GRAM
COLUMNS = BEFORE + WINDOW
#: Columns of a stripe at each level of subdivision: 169 columns are 13 stripes of 13 columns.
STRIPES = (13, 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes, by doubling."""
    h, n, power = _TABLE[data], 1, 0x9E3779B97F4A7C15
    while n < GRAM:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % (1 << 64), 2 * n
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Segments of texts: number of the text, start and length (bytes), offset of the minimizer, its hash, and a hash of the content."""
    lens = np.array([len(t) for t in texts], "int64")
    joined = b"".join(texts)
    data = np.frombuffer(joined, "uint8")
    if len(data) < WINDOW:
        return tuple(np.zeros(0, "int64") for _ in range(6))
    grams, width, n = _gram_hashes(data), BEFORE + 1, 1
    m = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype="uint64")  # the leftmost of equal ones is the least
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    if width > n:
        m = np.minimum(m[: n - width], m[width - n :])
    ends = np.cumsum(lens)
    doc = np.repeat(np.arange(len(texts)), lens)[: len(m)]
    ok = np.arange(len(m)) + WINDOW <= ends[doc]
    new = ok.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~ok[:-1]
    starts = np.flatnonzero(new)
    count = np.add.reduceat(ok, starts, dtype="int64") if len(starts) else np.zeros(0, "int64")
    at = (m[starts] & np.uint64((1 << int(PLACE_BITS)) - 1)).astype("int64")
    view, size = memoryview(joined), count + WINDOW - 1
    content = np.fromiter((xxhash.xxh3_64_intdigest(view[a : a + c]) for a, c in zip(starts.tolist(), size.tolist(), strict=True)), "uint64", len(starts))
    return doc[starts], starts - (ends - lens)[doc[starts]], size, at - starts, grams[at].view("int64"), content.view("int64")


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo] to values[hi], for each pair, over tables of powers of two."""
    level, out, n = np.frexp(hi - lo + 1)[1] - 1, np.zeros(len(lo), values.dtype), 1
    for k in range(int(level.max(initial=-1)) + 1):
        pick = np.flatnonzero(level == k)
        out[pick] = np.minimum(values[lo[pick]], values[hi[pick] - n + 1])
        values, n = np.minimum(values[:-n], values[n:]) if len(values) > n else values, 2 * n
    return out


def repeated_windows(parts: list[bytes], offsets: np.ndarray) -> np.ndarray:
    """Whether the window at each column of aligned segments is also in another one: [segment, column].

    Symbols are the bytes plus 1; 0 stands before a segment's first byte. A segment enters the order, as the
    empty suffix, where its last byte stands.
    """
    n = len(parts)
    columns = np.zeros((COLUMNS, n), "int16")
    sizes = np.array([len(p) for p in parts])
    for at in range(0, n, PLACED):
        own = sizes[at : at + PLACED]
        flat = np.frombuffer(b"".join(parts[at : at + PLACED]), "uint8")
        who = np.repeat(np.arange(at, at + len(own)), own)
        columns[np.arange(len(flat)) - np.repeat(np.cumsum(own) - own, own) - offsets[who] + BEFORE, who] = flat.astype("int16") + 1
    last = BEFORE + sizes - offsets - 1
    entry = np.argsort(last, kind="stable")
    upto = np.searchsorted(last[entry], np.arange(COLUMNS + 1))
    found = np.zeros((n, COLUMNS), bool)
    order, common = np.zeros(0, "int64"), np.zeros(0, "int16")
    for c in range(COLUMNS - 1, -1, -1):
        enter = entry[upto[c] : upto[c + 1]]
        if len(enter):
            order, common = np.concatenate([enter, order]), np.concatenate([np.zeros(len(enter), "int16"), common])
            common[: len(enter) + 1] = 0
        if not len(order):
            continue
        symbols = columns[c, order]
        to = np.argsort(symbols, kind="stable")
        same = np.flatnonzero((symbols[to[1:]] == symbols[to[:-1]]) & (symbols[to[1:]] > 0)) + 1
        prefix = np.zeros(len(order), "int16")
        prefix[same] = _range_minima(common, to[same - 1] + 1, to[same]) + 1
        order, common = order[to], prefix
        hit = np.flatnonzero(common >= WINDOW)
        found[order[hit], c] = True
        found[order[hit - 1], c] = True
    return found


def spans_of(found: np.ndarray, offset: int) -> list[list[int]]:
    """Covered [start, end) of a segment, flat, from the columns of its repeated windows."""
    at = np.flatnonzero(found)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return np.stack([first - BEFORE + offset, last - BEFORE + offset + WINDOW], 1).tolist()


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of [start, end) spans."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    cut = np.flatnonzero(spans[1:, 0] > top[:-1])
    return np.stack([spans[np.concatenate([[0], cut + 1]), 0], top[np.concatenate([cut, [len(spans) - 1]])]], 1)


def stripes(data: bytes, offset: int, width: int) -> Iterator[tuple]:
    """Cut an aligned segment into stripes of ``width`` columns: for each, a 128-bit hash of its number and of the bytes that all its windows share, its start in the segment, its own offset, and its bytes."""
    first = BEFORE - offset
    last = first + len(data) - WINDOW
    for j in range(first // width, last // width + 1):
        lo, hi = max(first, j * width), min(last, (j + 1) * width - 1)
        shared = data[(j + 1) * width - 1 - first : j * width + WINDOW - first]
        yield xxhash.xxh3_128_digest(j.to_bytes(2, "little") + shared), lo - first, BEFORE - lo, data[lo - first : hi - first + WINDOW]


_PIECE = "g binary, c binary, whole boolean, off int, data binary"
_MARK = "g binary, c binary, spans array<array<int>>"


def _sorted_marks(pieces: DataFrame) -> DataFrame:
    """The repeated windows of pieces whose groups ``g`` are small, as spans within each piece; not for whole ones."""

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group; whole groups are sorted together, about SORTED segments at a time."""
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= SORTED:
                b = pd.concat(held, ignore_index=True)
                last = b["g"] == b["g"].iat[-1]
                yield from out(b[~last])
                held, n = [b[last]], int(last.sum())
        if held:
            yield from out(pd.concat(held, ignore_index=True))

    def out(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(b):
            found = repeated_windows(b["data"].tolist(), b["off"].to_numpy("int64"))
            some = found.any(1) & ~b["whole"].to_numpy()
            b, found = b[some], found[some]
            if len(b):  # Arrow has no type for an empty column of lists
                yield pd.DataFrame({"g": b["g"], "c": b["c"], "spans": [spans_of(f, o) for f, o in zip(found, b["off"], strict=True)]})

    return pieces.repartition("g").sortWithinPartitions("g").mapInPandas(sort, _MARK)


def marks_of(pieces: DataFrame, largest: int, level: int = 0) -> DataFrame:
    """g, c, spans: repeated windows of ``pieces`` (g, c, whole, off, data), which are distinct in (g, c) and aligned in each group g.

    ``whole`` pieces occur twice: they are compared with the others but not marked.
    """
    kinds = written(pieces.groupBy("g").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    several = pieces.join(kinds, "g")
    marks = _sorted_marks(several.filter(F.col("kinds") <= largest).drop("kinds"))
    big = several.filter(F.col("kinds") > largest)
    if kinds.filter(F.col("kinds") > largest).isEmpty():
        done = written(marks, 8192)
        drop_written(kinds)
        return done

    width = STRIPES[level]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, c, whole, off, data in zip(b["g"], b["c"], b["whole"], b["off"], b["data"], strict=True):
                for key, shift, own, part in stripes(data, off, width):
                    rows.append((g, c, whole, key, xxhash.xxh3_128_digest(own.to_bytes(2, "little") + part), shift, own, part if width > 1 else None))
            yield pd.DataFrame(rows, columns=["g", "c", "whole", "g2", "c2", "shift", "off", "data"])

    parts = big.mapInPandas(cut, "g binary, c binary, whole boolean, g2 binary, c2 binary, shift int, off int, data binary")
    if width == 1:  # a group holds copies of one window
        each = written(parts.select("g", "c", "whole", "g2", "shift"), 8192)
        twice = written(each.groupBy("g2").agg(F.count("*").alias("n"), F.max("whole").alias("whole")).filter("n > 1 OR whole").select("g2"))
        hits, scratch = each.filter("NOT whole").join(twice, "g2").select("g", "c", F.array(F.col("shift"), F.col("shift") + WINDOW).alias("span")), [each, twice]
    else:
        each = written(parts, ROWS_AT_ONCE)
        counted = written(each.groupBy("g2", "c2").agg(F.count("*").alias("n")))
        inner = each.select("g2", "c2", "off", "data").dropDuplicates(["g2", "c2"]).join(counted, ["g2", "c2"]).select(F.col("g2").alias("g"), F.col("c2").alias("c"), (F.col("n") > 1).alias("whole"), "off", "data")
        inner = written(inner, ROWS_AT_ONCE)
        below = marks_of(inner, largest, level + 1)
        full = inner.filter("whole").select("g", "c", F.array(F.array(F.lit(0), F.octet_length("data"))).alias("spans"))
        found = written(below.unionByName(full).select(F.col("g").alias("g2"), F.col("c").alias("c2"), "spans"))
        moved = F.transform("spans", lambda s: F.array(F.get(s, 0) + F.col("shift"), F.get(s, 1) + F.col("shift")))
        hits = each.filter("NOT whole").select("g", "c", "g2", "c2", "shift").join(found, ["g2", "c2"]).select("g", "c", F.explode(moved).alias("span"))
        scratch = [each, counted, inner, below, found]
    done = written(marks.unionByName(hits.groupBy("g", "c").agg(F.collect_set("span").alias("spans"))), 8192)
    drop_written(kinds, *scratch)
    return done


def text_id(key: str, text: str):
    """128 bits by which texts are told apart: two hashes of key and text."""
    half = lambda *x: F.lpad(F.hex(F.xxhash64(*x)), 16, "0")
    return F.unhex(F.concat(half(F.col(key), F.col(text)), half(F.lit(1), F.col(text), F.col(key))))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", largest: int = LARGEST, chunk: int = CHUNK) -> DataFrame:
    """d, spans: for each text with repeated windows, the [start, end) spans of bytes that they cover in it, not merged. d is text_id() of key and text."""
    slim = docs.select(text_id(key, text).alias("d"), F.col(text).alias("t"))
    # rows that repeat key and text are read once, as a text that occurs twice
    again = written(slim.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d"))
    if again.isEmpty():
        slim = slim.withColumn("times", F.lit(1))
    else:
        slim = slim.join(again, "d", "left_anti").withColumn("times", F.lit(1)).unionByName(slim.join(again, "d", "left_semi").dropDuplicates(["d"]).withColumn("times", F.lit(2)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(held: list) -> pd.DataFrame:
            ids, times, bases, texts = zip(*held, strict=True)
            doc, start, size, offset, m, content = segments(texts)
            return pd.DataFrame({"d": np.array(ids, object)[doc], "times": np.array(times, "int32")[doc], "m": m, "content": content, "place": start + np.array(bases, "int64")[doc] << 20 | size << 10 | offset})

        for b in batches:
            held, n = [], 0
            for d, times, t in zip(b["d"], b["times"], b["t"], strict=True):
                t = (t or "").encode()
                for base in range(0, len(t) - WINDOW + 1, chunk):
                    part = t[base : base + chunk + WINDOW - 1]
                    held.append((d, times, base, part))
                    n += len(part)
                    if n > chunk:
                        yield out(held)
                        held, n = [], 0
            if held:
                yield out(held)

    cuts = written(slim.mapInPandas(cut, "d binary, times int, m long, content long, place long"), ROWS_AT_ONCE)
    shared = written(cuts.groupBy("m").agg(F.sum("times").alias("n")).filter("n > 1").select("m"))
    kept = written(cuts.join(shared, "m"))
    drop_written(cuts, shared)
    # one row for each distinct segment: how often it occurs, and one place
    distinct = written(kept.groupBy("m", "content").agg(F.sum("times").alias("n"), F.min(F.struct("d", "place")).alias("one")))
    several = written(distinct.groupBy("m").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("m"))
    # segments that occur once, among others: their windows must be looked at; those that occur twice are covered whole
    wanted = distinct.join(several, "m").select("m", "content", (F.col("n") > 1).alias("whole"), "one.*")
    lists = written(wanted.groupBy("d").agg(F.collect_list(F.struct("m", "content", "whole", "place")).alias("cuts")))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, cuts in zip(b["t"], b["cuts"], strict=True):
                t = t.encode()
                for c in cuts:
                    start = c["place"] >> 20
                    rows.append((c["m"].to_bytes(8, "big", signed=True), c["content"].to_bytes(8, "big", signed=True), c["whole"], c["place"] & 1023, t[start : start + (c["place"] >> 10 & 1023)]))
            yield pd.DataFrame(rows, columns=["g", "c", "whole", "off", "data"])

    pieces = written(slim.join(lists, "d").mapInPandas(fetch, _PIECE), ROWS_AT_ONCE)
    marks = marks_of(pieces, largest)
    number = lambda c: F.conv(F.hex(c), 16, -10).cast("long")
    marks = marks.select(number("g").alias("m"), number("c").alias("content"), "spans")

    size = F.shiftright("place", 10).bitwiseAND(F.lit(1023)).cast("int")
    whole = distinct.filter("n > 1").select("m", "content").join(kept, ["m", "content"]).select("d", F.array(F.array(F.lit(0), size)).alias("spans"), "place")
    part = marks.join(kept, ["m", "content"]).select("d", "spans", "place")
    start = F.shiftright("place", 20)
    moved = F.transform("spans", lambda s: F.array(F.get(s, 0) + F.col("start"), F.get(s, 1) + F.col("start")))
    placed = whole.unionByName(part).withColumn("start", start).select("d", F.explode(moved).alias("span"))
    spans = written(placed.groupBy("d").agg(F.collect_set("span").alias("spans")))
    drop_written(again, kept, distinct, several, lists, pieces)
    return spans


@tidy
def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", largest: int = LARGEST, chunk: int = CHUNK) -> DataFrame:
    """Remove from every text each byte that is covered by a WINDOW-byte string which also starts anywhere else.

    Adds to ``docs``: n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that are left)
    and kept_text (the same as text; a character of which only some bytes are covered stays whole). All copies
    of a passage go, overlaps count, and texts are judged as they came in.

    Null texts are empty; texts under WINDOW bytes can't hold a repeat; very long texts are hashed in parts, and
    a row's segments take about its bytes. Copies of a text, repeated rows and null keys are texts like any other:
    rows that repeat key and text are read once and count twice. Segments are told apart by 64-bit hashes within groups of one minimizer,
    texts by a 128-bit one of key and text. Columns of ``docs`` with the names of added ones are replaced. An
    empty table gives an empty result.
    """
    spans = repeated_spans(docs, key, text, largest, chunk)
    kind = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"

    @F.pandas_udf(kind)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans, strict=True):
            data = (t or "").encode()
            runs = merged(np.array([list(x) for x in s], "int64")) if s is not None and len(s) else np.zeros((0, 2), "int64")
            left, chars, at, char_at = [], [], 0, 0
            for a, b in runs.tolist():
                left.append(data[at:a])
                at = b
                while a < b and data[a] & 192 == 128:  # begins within a character
                    a += 1
                while b < len(data) and b > a and data[b] & 192 == 128:  # ends within one
                    b -= 1
                chars.append(data[char_at:a])
                char_at = b
            kept = b"".join([*left, data[at:]])
            rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), b"".join([*chars, data[char_at:]]).decode("utf-8", "replace")))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    own = docs.drop(*[c for c in names if c not in (key, text)]).withColumn("_cl_d", text_id(key, text))
    joined = own.join(spans.select(F.col("d").alias("_cl_d"), F.col("spans").alias("_cl_spans")), "_cl_d", "left")
    return joined.withColumn("_cl_x", cut(F.col(text), F.col("_cl_spans"))).select(*[c for c in own.columns if c != "_cl_d"], "_cl_x.*")
