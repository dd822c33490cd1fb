"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The pieces come from a public model file. Where that file ranks its pieces instead of weighing them, a
piece's log score is that of a Zipf law over the ranks. Characters without a piece fall back to byte pieces.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_path

MARK = "▁"  # stands for a space
NORMAL, BYTE = 1, 6
UNKNOWN_PENALTY = 10.0
#: Words whose segmentation a task remembers, and characters of the longest of them; a full memory is emptied.
CACHE_WORDS, CACHE_CHARS = 500_000, 64
#: Characters of text that are turned into rows of output at a time.
CHUNK_CHARS = 2_000_000


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of one protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id from a SentencePiece model file."""
    with open(path, "rb") as f:
        pieces = [dict(_fields(v)) for k, v in _fields(f.read()) if k == 1]
    return [(p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)) for p in pieces]


def is_ranked(pieces: list[tuple[str, float, int]]) -> bool:
    """Whether the file ranks its normal pieces: all scores are whole numbers, which logarithms aren't."""
    return all(s == int(s) for _, s, t in pieces if t == NORMAL)


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Replace ranks (the score of the n-th normal piece is -n) by log(1 / (rank H)), H the harmonic number."""
    ranked = sorted((-s, i) for i, (_, s, t) in enumerate(pieces) if t == NORMAL)
    h = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
    score = {i: -math.log(r) - h for r, (_, i) in enumerate(ranked, 1)}
    return [(p, score.get(i, s), t) for i, (p, s, t) in enumerate(pieces)]


class DoubleArray:
    """A trie over UTF-8 bytes in two arrays: the child of state s by byte b is base[s] + b, if check of that is s. value: piece id or -1."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, i in words.items():
            s = 0
            for b in word:
                if b not in children[s]:
                    children[s][b] = len(children)
                    children.append({})
                    ends.append(-1)
                s = children[s][b]
            ends[s] = i
        size = 2 * len(children) + 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        taken = bytearray(size)
        taken[0] = 1
        low, queue = 257, [(0, 0)]
        for node, s in queue:
            self.value[s] = ends[node]
            if not (keys := sorted(children[node])):
                continue
            while taken[low]:
                low += 1
            base = low - keys[0]
            while any(taken[base + b] for b in keys):
                base += 1
            if base + 512 > len(taken):
                more = len(taken)
                taken += bytearray(more)
                self.base += [0] * more
                self.check += [-1] * more
                self.value += [-1] * more
            self.base[s] = base
            for b in keys:
                taken[base + b] = 1
                self.check[base + b] = s
                queue.append((children[node][b], base + b))


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        normal = {p.encode(): i for i, (p, _, t) in enumerate(pieces) if t == NORMAL and p}
        self.trie = DoubleArray(normal)
        self.scores = [s for _, s, _ in pieces]
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = min((self.scores[i] for i in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.output = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t == NORMAL else b"" for p, _, t in pieces]
        # no piece goes on from another character to a mark, and none holds a line end: words are segmented alone
        self.words_alone = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in pieces if t == NORMAL)
        line = "" if any("\n" in p for p, _, t in pieces if t == NORMAL) else "\\n"
        self.units = re.compile(f" +[^ {line}]*|[^ {line}]+" + ("|\\n+" if line else ""))
        self.cache: dict[str, list[int]] = {}
        self.arrays: list[np.ndarray] | None = None

    def viterbi(self, unit: str) -> list[int]:
        """The best segmentation of a string; of equal ones that whose last piece is longest, and so on. A literal mark has no piece and falls back to bytes."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        data = unit.replace(MARK, "\0").replace(" ", MARK).encode()  # a zero byte is in no piece
        n, top = len(data), len(check)
        best, back = [-math.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -math.inf:
                continue
            first = data[i]
            width = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
            s, alone = 0, False
            for j in range(i, n):
                t = base[s] + data[j]
                if t >= top or check[t] != s:
                    break
                s = t
                if (v := value[s]) >= 0:
                    alone |= j + 1 - i == width
                    if (c := here + scores[v]) > best[j + 1]:
                        best[j + 1], back[j + 1] = c, (i, v)
            if not alone and (c := here + self.unknown) > best[i + width]:
                best[i + width], back[i + width] = c, (i, -1)
        ids: list[int] = []
        while n:
            i, v = back[n]
            if v >= 0:
                ids.append(v)
            else:
                raw = MARK.encode() if data[i:n] == b"\0" and "\0" not in unit else data[i:n]
                ids += [self.byte_id.get(b, 0) for b in reversed(raw)]
            n = i
        return ids[::-1]

    def viterbi_many(self, units: list[str]) -> list[list[int]]:
        """viterbi() of many short strings at once: all of them take each step of the trie and each step back together."""
        data = [u.replace(MARK, "\0").replace(" ", MARK).encode() for u in units]
        lens = np.array([len(d) for d in data])
        n, top = len(data), int(lens.max(initial=0))
        text = np.frombuffer(b"".join(d.ljust(top, b"\0") for d in data), "uint8").reshape(n, top).astype("int32")
        if self.arrays is None:
            self.arrays = [np.array(a, "int32") for a in (self.trie.base, self.trie.check, self.trie.value)] + [np.array(self.scores)]
        base, check, value, scores = self.arrays
        best = np.full((n, top + 5), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, top + 5), "int32"), np.full((n, top + 5), -1, "int32")
        for i in range(top):
            rows = np.flatnonzero((lens > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            first = text[rows, i]
            width = np.where(first < 128, 1, np.where(first < 224, 2, np.where(first < 240, 3, 4)))
            alone = np.zeros(len(rows), bool)
            at, s = np.arange(len(rows)), np.zeros(len(rows), "int32")
            for j in range(i, top):
                t = base[s] + text[rows[at], j]
                ok = (check[t] == s) & (lens[rows[at]] > j)
                at, s = at[ok], t[ok]
                if not len(at):
                    break
                v = value[s]
                hit = v >= 0
                k, v = at[hit], v[hit]
                alone[k[width[k] == j + 1 - i]] = True
                r = rows[k]
                c = best[r, i] + scores[v]
                up = c > best[r, j + 1]
                r = r[up]
                best[r, j + 1], start[r, j + 1], piece[r, j + 1] = c[up], i, v[up]
            r, w = rows[~alone], i + width[~alone]
            c = best[r, i] + self.unknown
            up = c > best[r, w]
            best[r[up], w[up]], start[r[up], w[up]], piece[r[up], w[up]] = c[up], i, -1
        at, odd, steps = lens.copy(), np.zeros(n, bool), []
        while (going := at > 0).any():
            v = np.where(going, piece[np.arange(n), at], -2)
            odd |= v == -1
            steps.append(v)
            at = np.where(going, start[np.arange(n), at], 0)
        found = np.array(steps[::-1], "int32").T.tolist() if steps else [[] for _ in units]
        return [self.viterbi(u) if o else [x for x in f if x >= 0] for u, o, f in zip(units, odd.tolist(), found, strict=True)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of texts; a space is put before each. Null and empty texts have none."""
        cache = self.cache
        if len(cache) >= CACHE_WORDS:
            cache.clear()
        units: list[list[str]] = []
        for text in texts:
            if not text:
                units.append([])
            elif "\0" in text and MARK in text:  # the stand-in of a literal mark is taken: marks are units of their own
                units.append([u for part in re.split(f"({MARK})", " " + text) if part for u in ([part] if part == MARK else self.units.findall(part) if self.words_alone else [part])])
            else:
                units.append(self.units.findall(" " + text) if self.words_alone else [" " + text])
        new = list({u for us in units for u in us} - cache.keys())
        long = {u: self.viterbi(u) for u in new if len(u) > CACHE_CHARS}
        short = sorted((u for u in new if len(u) <= CACHE_CHARS), key=len)
        for i in range(0, len(short), 8192):
            part = short[i : i + 8192]
            cache.update(zip(part, self.viterbi_many(part), strict=True))
        known = cache | long if long else cache
        out = []
        for us in units:
            ids: list[int] = []
            for u in us:
                ids += known[u]
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        """The text of ids: byte pieces are bytes, marks are spaces, and the space before the text goes. Bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")[1:]


_models: dict[str, Unigram] = {}


def model(name: str = "piece_bpe_32k.model") -> Unigram:
    """The model of a vocabulary file, by path or by name among the public tokenizers; one for each process. Log scores are those of the file, or of a Zipf law where it holds ranks."""
    if name not in _models:
        pieces = read_pieces(vocabulary_path(name))
        _models[name] = Unigram(zipf_scores(pieces) if is_ranked(pieces) else pieces)
    return _models[name]


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Encode every text and decode its ids again.

    Returns key, ids, n_tokens, n_byte_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_crc32
    (of the decoded text's UTF-8) and round_trip, whether the decoded text is the text. A task segments each
    word once while it remembers it; a word of any length is segmented in time linear in it.

    Null and empty texts have no ids and decode to the empty text. Null keys and repeated rows are kept. Other
    columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(vocabulary)
        is_byte = np.array([t == BYTE for _, _, t in m.pieces])
        for batch in batches:
            part, chars = [], 0
            for k, t in zip(batch["k"], batch["t"], strict=True):
                part.append((k, t))
                chars += len(t or "") + 100
                if chars > CHUNK_CHARS:
                    yield frame(coded(m, is_byte, part), batch)
                    part, chars = [], 0
            yield frame(coded(m, is_byte, part), batch)

    def coded(m: Unigram, is_byte: np.ndarray, part: list) -> list:
        rows = []
        for (k, t), out in zip(part, m.encode_many([t for _, t in part]), strict=True):
            ids, back = np.array(out, "<u4"), m.decode(out)
            rows.append((k, ids.astype("int32"), len(ids), int(is_byte[ids].sum()), zlib.crc32(ids), zlib.crc32(back.encode()), back == (t or "")))
        return rows

    def frame(rows: list, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["k", "ids", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_crc32", "round_trip"]).astype({"k": batch["k"].dtype})

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, ids array<int>, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
    return out.withColumnRenamed("k", key)
