"""Nearest vectors by cosine, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.run import kept

#: Queries of a block, and bytes of query vectors that are broadcast at a time.
BLOCK, WAVE_BYTES = 256, 64 << 20


def cosine_top_k(vectors: DataFrame, is_query, k: int, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, vec_id, rank: for every query the k other vectors of highest cosine (to nine decimals; 0 for a vector of norm 0), ties to the smaller id.

    Queries are packed into blocks; waves of blocks of bounded bytes are broadcast to all vectors, which stay where
    they are, and each task gives the k best of its own rows for each query.
    """
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e")).filter("id IS NOT NULL AND e IS NOT NULL").withColumn("dim", F.size("e"))
    asked = v.filter(is_query if isinstance(is_query, str) else is_query(F.col("id")))
    size = asked.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    n_blocks = max(1, -(-size["n"] // block))
    per_wave = max(1, wave_bytes // (8 * block * max(1, size["dim"] or 1)))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows["b"].iloc[0], rows["dim"].iloc[0], rows["id"].to_numpy("<i8").tobytes(), np.stack(rows["e"]).astype("<f8").tobytes())], columns=["b", "dim", "ids", "data"])

    packed = kept(asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("b", "dim").applyInPandas(pack, "b int, dim int, ids binary, data binary"))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from (pack(rows.assign(b=0)).drop(columns="b") for _, rows in b.groupby("dim"))

    own = kept(v.mapInPandas(blocks, "dim int, ids binary, data binary"))

    def unit(data: bytes, dim: int) -> np.ndarray:
        m = np.frombuffer(data, "<f8").reshape(-1, dim)
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best of a task's vectors for each query of the wave."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_dict("records"):
                if not r["dim"]:
                    continue
                ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                c = np.round(unit(r["q"], r["dim"]) @ unit(r["data"], r["dim"]).T, 9)
                c[q_ids[:, None] == ids[None, :]] = -2
                for i, q in enumerate(q_ids.tolist()):
                    old = held.get(q, (np.empty(0, "int64"), np.empty(0)))
                    at_ids, at_c = np.concatenate([old[0], ids]), np.concatenate([old[1], c[i]])
                    at = np.lexsort((at_ids, -at_c))[:k]
                    held[q] = at_ids[at], at_c[at]
        for q, (ids, c) in held.items():
            yield pd.DataFrame({"query_id": q, "vec_id": ids, "c": c})[c > -2]

    out = None
    for first in range(0, n_blocks, per_wave):
        wave = packed.filter((F.col("b") >= first) & (F.col("b") < first + per_wave)).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q"))
        part = own.join(F.broadcast(wave), "dim").mapInPandas(best, "query_id long, vec_id long, c double")  # wave_bytes at most
        part = part if n_blocks <= per_wave else kept(part)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank")
