"""Packing token sequences by bounded-space online best fit.

Documents are tokenized where they are read; only the lengths and checksums of their pieces travel. Every
packing task keeps a fixed number of open bins in a bitset keyed by free space.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, vocabulary_path, written

#: Open bins of a packing task, and pieces that one task packs (about).
OPEN_BINS, TASK_PIECES = 512, 200_000
END_ID = 2
SPECIAL = {"<|endoftext|>": 50256}
_encoders: dict = {}


def _encoder(vocabulary: str):
    """The byte-level BPE in ``vocabulary`` (ranks), with the special token of its tokenizer file; one for each process."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[vocabulary]


def encode(text: str | None, vocabulary: str = "byte_bpe_50k.tiktoken") -> list[int]:
    """Ids of a text (null: none). Special strings are special tokens, as the tokenizers library takes them."""
    if not text:
        return []
    e = _encoder(vocabulary)
    return e.encode(text, allowed_special="all") if "<|endoftext|>" in text else e.encode_ordinary(text)


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """key, piece, start, length, ids_crc32: each document's ids and an end id, cut into pieces of ``limit`` of which the first may be shorter."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                ids = np.array([*encode(t, vocabulary), END_ID], "<u4")
                first = len(ids) % limit or limit
                for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), limit)], [*range(first, len(ids) + 1, limit)], strict=True)):
                    rows.append((k, piece, a, b - a, zlib.crc32(ids[a:b])))
            yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32"]).astype({"k": batch["k"].dtype})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(pieces, f"k {kind}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best fit with at most ``open_bins`` open bins. A bit of ``free`` is set where a bin has that free space."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free, self.bins, self.n_open, self.n = 0, [[] for _ in range(capacity + 1)], 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin of an item of 1 to ``capacity`` and its offset there."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1  # the least free space that is enough
            bin_id = self._take(space)
        else:
            if self.n_open >= self.open_bins:  # the fullest closes first
                self._take((self.free & -self.free).bit_length() - 1)
            space, bin_id = self.capacity, self.n
            self.n += 1
        if space > length:
            self.bins[space - length].append(bin_id)
            self.free |= 1 << (space - length)
            self.n_open += 1
        return bin_id, self.capacity - space

    def _take(self, space: int) -> int:
        bin_id = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return bin_id


@tidy
def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, vocabulary: str = "byte_bpe_50k.tiktoken", open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most ``limit`` tokens.

    Returns a row for each piece: key, piece, start, length, ids_crc32, sequence_id and offset. Full pieces are
    sequences of their own (ids below 0); the others are dealt evenly to packing tasks by their row, so that
    neither a hot key nor a group of copies meets in one task. Bins that a task leaves open are closed as they
    are: at most ``open_bins`` for each ``task_pieces`` pieces. ``vocabulary`` is a file of byte-pair ranks, by
    path or by name among the public tokenizers; every task reads it on its own machine.

    Null and empty texts are the end id alone. Null keys and repeated rows are kept as they are. A text of any
    length is tokenized whole. An empty table gives an empty result. Other columns are not read.
    """
    pieces = written(token_pieces(docs, key, text, limit, vocabulary)).withColumn("row", F.monotonically_increasing_id())
    full = pieces.filter(F.col("length") == limit).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    part = pieces.filter(F.col("length") < limit)
    n_tasks = max(1, -(-part.count() // task_pieces))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = BestFit(limit, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [bins.place(n) for n in batch["length"].tolist()]
            yield batch.assign(sequence_id=np.array([base + b for b, _ in at], "int64"), offset=np.array([o for _, o in at], "int64"))

    dealt = part.repartition(n_tasks, F.xxhash64("row")).sortWithinPartitions(F.xxhash64("row"))
    packed = dealt.mapInPandas(pack, full.schema)
    return full.unionByName(packed).select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
