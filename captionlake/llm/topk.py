"""Exact top-k search by distributed histogram selection.

Candidates are packed into blocks, queries into groups. Every block is scored in place against the groups of a wave,
whose bytes are bounded and which are broadcast. Rounds of global histograms of all scores narrow, for each query,
the interval that holds its k-th best score down to one integer; a last scoring keeps what is above, and breaks
ties at that score by id. Vectors are never shuffled after they are packed, only counts and results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

#: Candidate vectors in a block, queries in a group, bins of a round's histograms.
BLOCK, GROUP, BINS = 4096, 512, 1024
#: Bytes of the query vectors and histograms of a wave of groups (one group at least), which every task holds; pairs that a task reads at a time.
WAVE_BYTES, PAIRS_AT_ONCE = 64 << 20, 4
FAR = 1 << 62


def _matrix(data: bytes, dim: int) -> np.ndarray:
    """Rows of a block; of vectors without components, a byte each."""
    return np.frombuffer(data, "<i8").reshape(-1, dim) if dim else np.zeros((len(data), 0), "<i8")


def quantized_blocks(vectors: DataFrame, key: str, vector: str, scale: int, block: int = BLOCK) -> DataFrame:
    """Blocks (block, dim, ids, data, norm) of floor(scale * x) as long. Vectors that are null or hold null or non-finite components are left out."""

    def quantize(v) -> np.ndarray | None:
        if v is None:
            return None
        x = np.array([np.nan if e is None else e for e in v] if getattr(v, "dtype", None) == object else v, "float64")
        return np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype("<i8") if np.isfinite(x).all() else None

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, held = TaskContext.get().partitionId(), 0, {}

        def row(dim: int) -> tuple:
            nonlocal n
            ids, rows = zip(*held.pop(dim), strict=True)
            m = np.array(rows, "<i8").reshape(len(ids), dim)
            n += 1
            return (part << 32 | n, dim, np.array(ids, "<i8").tobytes(), m.tobytes() if dim else bytes(len(ids)), float(np.sqrt((m.astype("float64") ** 2).sum(1)).max(initial=0)))

        columns = ["block", "dim", "ids", "data", "norm"]
        for batch in batches:
            out = []
            for k, v in zip(batch["k"], batch["v"], strict=True):
                if (q := quantize(v)) is not None:
                    held.setdefault(len(q), []).append((k, q))
                    if len(held[len(q)]) == block:
                        out.append(row(len(q)))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if rest := [row(dim) for dim in list(held)]:
            yield pd.DataFrame(rest, columns=columns)

    slim = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).filter("k IS NOT NULL AND v IS NOT NULL")
    return slim.mapInPandas(pack, "block long, dim int, ids binary, data binary, norm double")


def _scores(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as long: exact in double where no sum can reach 2**53, else in 64-bit integers (which wrap)."""
    top = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, c.shape[1])
    return (c.astype("float64") @ q.T.astype("float64")).astype("int64") if top < 2.0**53 else c @ q.T


class _Group:
    """A group of queries and, where it meets a block, their scores."""

    def __init__(self, r):
        self.ids, self.lo, self.hi, self.width, self.need = (np.frombuffer(r[c], "<i8") for c in ("q_ids", "lo", "hi", "width", "need"))
        self.q = _matrix(r["q"], int(r["dim"]))

    def scores(self, r) -> tuple[np.ndarray, np.ndarray]:
        """Candidate ids and scores [candidate, query] of the block of a row; a query's own id scores -FAR."""
        ids = np.frombuffer(r["ids"], "<i8")
        s = _scores(_matrix(r["data"], int(r["dim"])), self.q)
        s[ids[:, None] == self.ids[None, :]] = -FAR
        return ids, s


@tidy
def exact_top_k(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK, group: int = GROUP, bins: int = BINS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """The k best-scoring other vectors of every query.

    ``is_query`` is a condition on the key column. Returns query_id, rank (from 1), vec_id and score: integer
    inner products of floor(scale * x), best first, ties to the smaller id. Queries with fewer candidates get
    all of them; those with none, no row.

    Vectors that are null, hold null or non-finite components, or have a null id take no part. Vectors of other
    lengths are no candidates. Rows that repeat an id are candidates each; as queries they are one, the
    bytewise smallest. Scores beyond 64 bits wrap. Other columns are not read; an empty table gives an empty
    result. Each task holds one block, a wave's groups and histograms (``wave_bytes``), and one pair's scores; more
    queries than a wave holds take more waves, each a pass over the blocks.
    """
    blocks = written(quantized_blocks(vectors, key, vector, scale, block))
    near = quantized_blocks(vectors.filter(is_query), key, vector, scale, group)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, r in b.iterrows():
                m = _matrix(r["data"], r["dim"])
                yield pd.DataFrame({"query_id": np.frombuffer(r["ids"], "<i8"), "dim": np.int32(r["dim"]), "data": [x.tobytes() or b"\0" for x in m], "own": np.sqrt((m.astype("float64") ** 2).sum(1))})

    bounds = written(blocks.groupBy("dim").agg(F.max("norm").alias("norm")))
    queries = near.mapInPandas(unpack, "query_id long, dim int, data binary, own double").groupBy("query_id").agg(F.min(F.struct("data", "dim", "own")).alias("x")).select("query_id", "x.*")
    queries = written(queries)
    size = queries.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n_groups = max(1, -(-size["n"] // group))
    per_wave = max(1, wave_bytes // (group * 8 * ((size["dim"] or 0) + bins + 6)))
    queries = written(queries.withColumn("grp", F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).cast("int")))
    reach = F.least(F.ceil(F.col("own") * F.col("norm")) + 1, F.lit(FAR // 2)).cast("long")
    state = written(queries.join(bounds, "dim").select(
        "query_id", (-reach).alias("lo"), (reach + 1).alias("hi"), F.ceil((2 * reach + 1) / bins).cast("long").alias("width"), F.lit(k).cast("long").alias("need")
    ))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        """A group of queries as one row."""
        long = lambda c: rows[c].to_numpy("<i8").tobytes()
        dim = rows["dim"].iloc[0]
        data = b"".join(rows["data"]) if dim else bytes(len(rows))
        return pd.DataFrame([(rows["grp"].iloc[0], dim, long("query_id"), data, long("lo"), long("hi"), long("width"), long("need"))], columns=["grp", "dim", "q_ids", "q", "lo", "hi", "width", "need"])

    def scored(fn, schema: str) -> DataFrame:
        """fn over each block with each group of its dimension, wave by wave; blocks stay where they are."""
        groups = written(queries.join(state, "query_id").groupBy("grp", "dim").applyInPandas(pack, "grp int, dim int, q_ids binary, q binary, lo binary, hi binary, width binary, need binary"))
        waves = [groups.filter((F.col("grp") >= g) & (F.col("grp") < g + per_wave)) for g in range(0, n_groups, per_wave)]
        return reduce(DataFrame.unionByName, [written(blocks.join(F.broadcast(w), "dim").mapInPandas(fn, schema), PAIRS_AT_ONCE) for w in waves])

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts by bin of all scores within each query's interval, added up over a task's blocks."""
        held: dict[tuple, tuple[_Group, np.ndarray]] = {}
        for b in batches:
            for r in b.to_dict("records"):
                at = (r["grp"], r["dim"])
                if at not in held:
                    g = _Group(r)
                    held[at] = g, np.zeros(len(g.ids) * bins, "int64")
                g, counts = held[at]
                _, s = g.scores(r)
                inside = (s >= g.lo) & (s < g.hi) & (g.width > 0)
                place = (s - g.lo) // np.maximum(g.width, 1) + np.arange(len(g.ids)) * bins
                counts += np.bincount(place[inside], minlength=len(counts))
        for g, counts in held.values():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"query_id": g.ids[at // bins], "bin": at % bins, "n": counts[at]})

    while (widest := state.agg(F.max("width").alias("w")).first()["w"]) and widest > 0:
        counts = scored(histogram, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.col("bin").desc())  # at most `bins` rows
        runs = counts.withColumn("upto", F.sum("n").over(w)).join(state.select("query_id", "need"), "query_id")
        found = runs.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select("query_id", "bin", (F.col("upto") - F.col("n")).alias("above"))
        seen = state.join(found, "query_id", "left")
        done, ready = F.col("width") <= 1, F.col("width") == 0
        # fewer candidates than k: everything qualifies
        state = written(seen.select(
            "query_id",
            F.when(ready, F.col("lo")).when(F.col("bin").isNull(), F.lit(-FAR + 1)).otherwise(F.col("lo") + F.col("bin") * F.col("width")).cast("long").alias("lo"),
            F.when(ready | F.col("bin").isNull(), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
            F.when(F.col("bin").isNull() | done, F.lit(0)).otherwise(F.ceil(F.col("width") / bins)).cast("long").alias("width"),
            (F.col("need") - F.coalesce(F.col("above"), F.lit(0))).alias("need"),
        ))

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What is above each query's k-th best score, and of the ties at it as many of the smallest ids as are needed."""
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                g = _Group(r)
                ids, s = g.scores(r)
                for j in np.flatnonzero((s >= g.lo).any(0)):
                    over, tie = np.flatnonzero(s[:, j] > g.lo[j]), np.flatnonzero(s[:, j] == g.lo[j])
                    pick = np.concatenate([over, tie[np.argsort(ids[tie], kind="stable")[: int(g.need[j])]]])
                    out.append(pd.DataFrame({"query_id": g.ids[j], "vec_id": ids[pick], "score": s[pick, j]}))
            if out:
                yield pd.concat(out)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = scored(select, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
