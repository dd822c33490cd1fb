"""Near-duplicate detection with HyperMinHash.

A document's set of word shingles is hashed once; each register keeps the least hash of its bucket as a count
of leading zeros and some mantissa bits. Bands of registers find candidates, the share of equal registers,
corrected for chance collisions, estimates their Jaccard similarity, and full sets confirm the links. The
estimate only orders the work: likely pairs are confirmed first, the others where they would still join two
components. Only safe bounds rule a pair out before: the sizes of the sets, and bitmaps of them.

Links are looked for until every two documents that share a band are either in one component or known not to
be linked, but not all pairs are formed: a band's members are first compared with one of them, and then only
members outside of the band's main component with the others of like size, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, split_by_keys, tidy, written
from .components import connected_components

#: Registers, registers of a band, bands, mantissa bits. Two sets of similarity 0.85 share no band once in 10**9.
REGISTERS, ROWS, BANDS, MANTISSA = 128, 4, 28, 10
#: Standard deviations by which an estimate may fall short of the threshold before a pair has to wait.
SLACK = 2
#: Members of a band that are compared at a time, and rows that a task reads at a time where rows hold texts or sets.
BLOCK, ROWS_AT_ONCE = 256, 512
VALUE_BITS = 50
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "uint64")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z in lower case. Fewer words than ``width`` are one shingle; none, no shingle."""
    words = (text or "").encode().translate(LOWER).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    if not len(h):
        return h
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, n, "uint64")
    for i in range(n):
        s = s * ODD[4] + h[i : len(h) - n + 1 + i] * ODD[i % 4]
    return np.unique(_mix(s))


def registers(s: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a non-empty set, as uint16.

    A shingle falls into one bucket and each bucket keeps its least value. Buckets that stay empty take the
    first value of further rounds of hashing; so each register of two sets agrees with the probability of
    their similarity, for sets of any size.
    """
    low = np.full(REGISTERS, np.iinfo("uint64").max)
    n_rounds, done = 1, 0
    while done == 0 or (low == np.iinfo("uint64").max).any():
        rounds = np.arange(done, done + n_rounds, dtype="uint64")
        v = _mix(s[:, None] ^ _mix(rounds * ODD[0] + ODD[1])[None, :])
        at = (rounds[None, :] << np.uint64(VALUE_BITS)) | (v >> np.uint64(64 - VALUE_BITS))
        np.minimum.at(low, (v % np.uint64(REGISTERS)).astype("int64").ravel(), at.ravel())
        done += n_rounds
        n_rounds = max(1, int(REGISTERS * 5 / len(s)))
    rounds, value = low >> np.uint64(VALUE_BITS), low & np.uint64((1 << VALUE_BITS) - 1)
    fraction, exponent = np.frexp(value.astype("float64"))
    zeros = VALUE_BITS - exponent
    mantissa = ((2 * fraction - 1) * (1 << MANTISSA)).astype("int64") & ((1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) | (mantissa ^ (rounds.astype("int64") * 389 & ((1 << MANTISSA) - 1)))).astype("<u2")


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers of sets of n and m shingles. By chance, registers of disjoint sets agree at about 0.17 * 4x / (1 + x)^2 / 2^MANTISSA, x = n / m."""
    x = n / m
    c = 0.1699 * 4 * x / (1 + x) ** 2 / (1 << MANTISSA)
    return (equal / REGISTERS - c) / (1 - c)


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each hash of a set among 8 to 16 times as many (4096 bytes at most), as uint8 of a power of two in length."""
    bits = min(max(64, 1 << int(8 * len(s)).bit_length()), 1 << 15)
    out = np.zeros(bits, bool)
    out[(s >> np.uint64(24)).astype("int64") & (bits - 1)] = True
    return np.packbits(out, bitorder="little")


def may_link(maps: list[np.ndarray], n: np.ndarray, x: int, others: np.ndarray, threshold: int) -> np.ndarray:
    """Those of ``others`` that the bitmaps allow to be linked with x: a bit of one set only is a member of that set only, so it bounds the intersection. Longer bitmaps are folded."""
    sizes = np.array([len(maps[o]) for o in others])
    out = np.zeros(len(others), bool)
    for size in np.unique(sizes):
        width, pick = min(size, len(maps[x])), np.flatnonzero(sizes == size)
        fold = lambda m: np.bitwise_or.reduce(m.reshape(*m.shape[:-1], -1, width), axis=-2).view("uint64")  # noqa: E731, B023
        a, b = fold(maps[x]), fold(np.stack([maps[o] for o in others[pick]]))
        only_a, only_b = np.bitwise_count(a & ~b).sum(1).astype("int64"), np.bitwise_count(b & ~a).sum(1).astype("int64")
        na, nb = n[x], n[others[pick]]
        both = np.minimum(na - only_a, nb - only_b)
        out[pick] = 100 * both >= threshold * (na + nb - both)
    return others[out]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x[: 2 * REGISTERS] for x in column), "<u2").reshape(len(column), REGISTERS)


def _bitmaps(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, "uint8", offset=2 * REGISTERS) for x in column]


@tidy
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 80, text_hash: bool = False) -> DataFrame:
    """Link documents whose shingle sets have 100 * |A and B| >= threshold * |A or B|; group them by what links reach.

    Returns a row for each input row: key, n_shingles, component_id (the smallest key that its links reach,
    itself included) and kept (whether it is that one); with ``text_hash``, also xxhash64 of the text. Sets are
    compared by 64-bit hashes of their shingles.

    No link is lost whose documents share a band (README: odds); the rest of the method is exact.

    Null, empty and blank texts have no shingles and are linked with nothing; very long ones are hashed whole, their
    sets taking 8 bytes a word. Rows with equal sets are one node with the smallest of their keys, so repeated rows
    and groups of copies of any size cost an aggregate. Rows
    that repeat a key with another text are judged by their texts. A row with a null key is linked with nothing,
    has a null component and is kept. An empty table gives an empty result. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    least = threshold / 100 - SLACK * (threshold / 100 * (1 - threshold / 100) / REGISTERS) ** 0.5
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("th"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, th in zip(b["k"], b["t"], b["th"], strict=True):
                s = shingle_set(t, width)
                rows.append((k, th, len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes() + bitmap(s).tobytes()) if len(s) else (k, th, 0, None, None))
            yield pd.DataFrame(rows, columns=["k", "th", "n", "fp", "regs"]).astype({"k": b["k"].dtype})

    signed = written(slim.mapInPandas(sign, f"k {kind}, th long, n long, fp binary, regs binary"), ROWS_AT_ONCE)
    reps = signed.filter("n > 0 AND k IS NOT NULL").groupBy("fp").agg(F.min(F.struct("k", "th")).alias("one"), F.max("n").alias("n"), F.min("regs").alias("regs"))
    # size: the least size class; linked sets are in one class or in neighbouring ones
    reps = written(reps.select("fp", F.col("one.k").alias("rep"), F.col("one.th").alias("th"), "n", F.floor(F.log(F.col("n")) / math.log(100 / threshold)).cast("int").alias("size"), "regs"))

    # bands: the least of a band's members by a hash (of four orders) is what the others are compared with first
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("i")
    bands = reps.select("rep", "n", "regs", band).select("rep", "n", "i", F.xxhash64("i", F.expr(f"substring(regs, i * {2 * ROWS} + 1, {2 * ROWS})")).alias("band"), F.xxhash64("rep", F.col("i") % 4).alias("order"))
    shared = written(bands.groupBy("band").agg(F.count("*").alias("many"), F.min(F.struct("order", "rep", "n")).alias("p")).filter("many > 1").select("band", F.col("p.rep").alias("pivot"), F.col("p.n").alias("n_pivot")))
    members = written(bands.select("rep", "n", "i", "band").join(shared, "band"))

    # registers and bitmaps travel only for those that share a band
    banded = written(reps.select("rep", "n", "regs").join(written(members.select("rep").distinct()), "rep", "left_semi"))

    def beside(pairs: DataFrame, held: DataFrame) -> DataFrame:
        """The pairs as groups of rows of ``held``: one for the end that more pairs have (side 0), then one for each other end, at most about BLOCK of them. So what a hub of many pairs holds travels once for a block."""
        ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("deg"))
        for x in ("a", "b"):
            pairs = pairs.join(ends.select(F.col("rep").alias(x), F.col("deg").alias(f"deg_{x}")), x)
        swap = F.col("deg_b") > F.col("deg_a")
        pairs = written(pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("rep")))
        parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        spokes = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), F.lit(1).alias("side"), "rep")
        hubs = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("rep"))
        return written(spokes.unionByName(hubs)).join(held, "rep").repartition("hub", "part").sortWithinPartitions("hub", "part", "side")

    def starred(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, pd.DataFrame]]:
        """(the hub's row, some of the rows beside it)."""
        hub = None
        for b in batches:
            side = b["side"].to_numpy()
            cuts = [0, *np.flatnonzero(side == 0), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi and side[lo] == 0:
                    hub, lo = b.iloc[lo], lo + 1
                if lo < hi:
                    yield hub, b.iloc[lo:hi]

    def ordered(hub: pd.Series, rest: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": [min(hub["rep"], x) for x in rest["rep"]], "b": [max(hub["rep"], x) for x in rest["rep"]]})

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs that no bound rules out, with the estimate of their similarity."""
        for hub, p in starred(batches):
            n = np.array([hub["n"], *p["n"]], "int64")
            regs = np.frombuffer(hub["regs"][: 2 * REGISTERS], "<u2")
            j = estimate((_matrix(p["regs"]) == regs).sum(1), n[1:], n[0])
            at = may_link([np.frombuffer(hub["regs"], "uint8", offset=2 * REGISTERS), *_bitmaps(p["regs"])], n, 0, np.arange(1, len(n)), threshold) - 1
            if len(at):
                yield ordered(hub, p.iloc[at]).assign(j=j[at])

    sizes_allow = 100 * F.least("n", "n_pivot") >= threshold * F.greatest("n", "n_pivot")
    star = members.filter(F.col("rep") != F.col("pivot")).filter(sizes_allow).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    star = written(beside(written(star), banded).mapInPandas(possible, f"a {kind}, b {kind}, j double"), 4096)

    def sets_of(pairs: DataFrame) -> DataFrame:
        """rep, data: the full sets of the documents in ``pairs``, one row for each, however many rows repeat it."""
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(reps.select("rep", "th", "fp"), "rep")
        ends = written(ends.select(F.col("rep").alias("k"), "th", "fp"))
        asked, _ = split_by_keys(slim, ends, ["k", "th"])
        rows = asked.join(ends.hint("shuffle_hash"), ["k", "th"]).dropDuplicates(["k", "th", "fp"]).select(F.col("k").alias("rep"), "t", "fp")  # as the join has dealt them

        def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                sets = [shingle_set(t, width).tobytes() for t in b["t"]]
                ok = [xxhash.xxh3_128_digest(s) == bytes(w) for s, w in zip(sets, b["fp"], strict=True)]
                yield pd.DataFrame({"rep": b["rep"], "fp": b["fp"], "data": sets})[ok]

        return written(rows.mapInPandas(full, f"rep {kind}, fp binary, data binary"), ROWS_AT_ONCE)

    def confirmed(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs)

        def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for hub, p in starred(batches):
                s, ok = np.frombuffer(hub["data"], "uint64"), []
                for y in p["data"]:
                    t = np.frombuffer(y, "uint64")
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    ok.append(100 * both >= threshold * (len(s) + len(t) - both))
                if any(ok):
                    yield ordered(hub, p[ok])

        links = written(beside(pairs, sets.select("rep", "data")).mapInPandas(confirm, f"a {kind}, b {kind}").distinct(), ROWS_AT_ONCE)
        drop_written(sets)
        return links

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose ends are in different components."""
        for x in ("a", "b"):
            pairs = pairs.join(found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
        return pairs.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).drop("c_a", "c_b")

    links = confirmed(star.filter(F.col("j") >= least).select("a", "b"))
    found = connected_components(links)

    # bands whose members are in several components: those outside of the largest are compared with all others of like size
    placed = members.select("band", "i", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("band", "i", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = written(placed.join(reps.select("rep", "size"), "rep"))
    per = placed.groupBy("band", "comp").agg(F.count("*").alias("n"))
    open_bands = written(per.groupBy("band").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("main")).filter("comps > 1").select("band", "main"))
    opened = written(placed.join(open_bands, "band").select("band", "i", "rep", "comp", "size", (F.col("comp") != F.col("main")).alias("outside")))
    blocks = written(opened.groupBy("band", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"), F.ceil(F.count_if("outside") / BLOCK).cast("int").alias("nl")))

    def side(left: bool) -> DataFrame:
        """One side of the comparisons, with the key of each pair of blocks in which it takes part: block l of the outside members of a size with block b of all members of a size beside it."""
        near = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
        own, other = ("nl", "nb") if left else ("nb", "nl")
        x = (opened.filter("outside") if left else opened).join(blocks.select("band", "size", F.col(own).alias("n_own")), ["band", "size"]).withColumn("s2", near)
        x = x.join(blocks.select("band", F.col("size").alias("s2"), F.col(other).alias("n_other")).filter("n_other > 0"), ["band", "s2"])
        x = x.withColumn("mine", F.pmod(F.xxhash64("rep", F.lit(own)), F.col("n_own"))).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("n_other") - 1)))
        cell = ("size", "s2", "mine", "theirs") if left else ("s2", "size", "theirs", "mine")
        return x.select(F.xxhash64("band", *[F.col(c).cast("long") for c in cell]).alias("g"), F.lit(left).alias("left"), "i", "rep", "comp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by g; a pair of blocks has some hundred rows."""
        carry = None
        for b in batches:
            b = b if carry is None else pd.concat([carry, b], ignore_index=True)
            if not len(b):
                continue
            last = b["g"].iat[-1] == b["g"]
            carry = b[last]
            yield from compared(b[~last])
        if carry is not None:
            yield from compared(carry)

    def compared(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(b):
            return
        g, left, band, rep, comp, n, regs, maps = b["g"].to_numpy(), b["left"].to_numpy(), b["i"].to_numpy(), b["rep"].to_numpy(), b["comp"].to_numpy(), b["n"].to_numpy(), _matrix(b["regs"]), _bitmaps(b["regs"])
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
        xs, ys = [], []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            x, y = lo + np.flatnonzero(left[lo:hi]), lo + np.flatnonzero(~left[lo:hi])
            for i in x:
                o = y[(comp[y] != comp[i]) & (100 * np.minimum(n[y], n[i]) >= threshold * np.maximum(n[y], n[i]))]
                # a pair is judged in the first band that it shares, which is open as the pair is in two components
                same = regs[o, : BANDS * ROWS] == regs[i, : BANDS * ROWS]
                o = o[same.reshape(len(o), BANDS, ROWS).all(2).argmax(1) == band[i]]
                o = may_link(maps, n, i, o, threshold) if len(o) else o
                xs.append(np.full(len(o), i))
                ys.append(o)
        if xs:
            x, y = rep[np.concatenate(xs)], rep[np.concatenate(ys)]
            yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    dealt = side(True).unionByName(side(False)).join(banded, "rep").repartition("g").sortWithinPartitions("g")
    more = written(dealt.mapInPandas(compare, f"a {kind}, b {kind}").distinct().join(star.filter(F.col("j") >= least).select("a", "b"), ["a", "b"], "left_anti").unionByName(apart(star.filter(F.col("j") < least).select("a", "b"), found)).distinct(), 4096)
    drop_written(placed, open_bands, opened, blocks, members, banded, shared, star)
    if not more.isEmpty():
        links = links.unionByName(confirmed(more))
        found = connected_components(links)
    drop_written(more)

    node = reps.select("fp", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("comp"))
    out = signed.select("k", "th", "n", "fp").join(node, "fp", "left")
    component = F.when(F.col("k").isNotNull(), F.coalesce("comp", "k"))
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"), *[F.col("th").alias("text_hash")] * text_hash)


@tidy
def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near_duplicates(), the one of the smallest key, all columns as they are.

    Of rows that repeat key and text one stays, the least by a hash of all its columns (maps aside), except those
    without shingles or key, which all stay. Null, empty and very long texts as in near_duplicates(); columns with
    clashing names stay as they are; an empty table gives an empty result.
    """
    judged = written(near_duplicates(docs, key, text, width, threshold, text_hash=True).select(F.col(key).alias("_cl_k"), F.col("text_hash").alias("_cl_h"), "n_shingles", "kept"))
    own, on = docs.withColumns({"_cl_k": F.col(key), "_cl_h": F.xxhash64(text)}), ["_cl_k", "_cl_h"]
    # texts that no key asks for stay where they are
    gone = written(judged.filter("NOT kept").select(*on).distinct())
    maybe, left = split_by_keys(own, gone, on)
    left = left.unionByName(maybe.join(gone.hint("shuffle_hash"), on, "left_anti"))
    again = written(judged.filter("kept AND n_shingles > 0 AND _cl_k IS NOT NULL").groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    if not again.isEmpty():
        order = F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
        maybe, single = split_by_keys(left, again, on)
        once = maybe.join(again.hint("shuffle_hash"), on, "left_semi").groupBy(*on).agg(F.min_by(F.struct(*docs.columns), order).alias("_cl_row"))
        left = single.unionByName(maybe.join(again.hint("shuffle_hash"), on, "left_anti")).select(*docs.columns).unionByName(once.select("_cl_row.*"))
    return left.select(*docs.columns)
