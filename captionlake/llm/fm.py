"""A quality classifier: factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)), linear in the number of
features times the rank. It is fitted on a bounded sample of labelled rows and then broadcast: its size
depends on its parameters alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed words, rank of the interactions, labelled rows in the sample (about), and documents that are scored at a time.
BUCKETS, RANK, SAMPLE, CHUNK = 1024, 8, 6000, 256
EPOCHS, BATCH, RATE, DECAY, SEED = 25, 128, 0.02, 1e-4, 7
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words are hashed in slices of this many, so that a very long text needs no more memory.
SLICE = 200_000
#: Each statistic is also one of this many intervals of its range.
CUTS = 10


def _byte_classes() -> np.ndarray:
    """Rows: capital letters, small letters, digits, bytes beyond ASCII, line ends, blanks, sentence marks, other signs."""
    kinds = np.zeros((8, 256), "float32")
    for b in range(256):
        c = chr(b)
        k = 3 if b > 127 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c == "\n" else 5 if c.isspace() else 6 if c in ".,;:!?'\"()-" else 7
        kinds[k, b] = 1
    return kinds


CLASSES = _byte_classes()
N_STATS = 8 + 7
N_FEATURES = BUCKETS + N_STATS * (1 + CUTS)


def features(text: str | None) -> np.ndarray:
    """The feature vector of a whole text: square roots of hashed words' shares, statistics in 0 to 1, and their intervals."""
    data = (text or "").encode()
    x = np.zeros(N_FEATURES, "float32")
    words = data.translate(LOWER).split()
    n = len(words)
    counts = np.zeros(BUCKETS, "int64")
    for i in range(0, n, SLICE):
        part = words[i : i + SLICE]
        counts += np.bincount(np.fromiter(map(xxhash.xxh3_64_intdigest, part), "uint64", len(part)).astype("int64") & (BUCKETS - 1), minlength=BUCKETS)
    x[:BUCKETS] = np.sqrt(counts / max(n, 1))
    shares = CLASSES @ (np.bincount(np.frombuffer(data, "uint8"), minlength=256) / max(len(data), 1))
    lines = [s for s in data.split(b"\n") if s.strip()]
    rest = [
        min(1.0, np.log1p(n) / 12), min(1.0, np.log1p(len(data)) / 16), min(1.0, (len(data) / max(n, 1)) / 20), len(set(words)) / max(n, 1),
        1 - len(set(lines)) / max(len(lines), 1), min(1.0, n / max(len(lines), 1) / 100), counts.max() / max(n, 1),
    ]
    stats = np.array([*np.sqrt(shares), *rest], "float32")
    x[BUCKETS : BUCKETS + N_STATS] = stats
    place = np.minimum((stats * CUTS).astype(int), CUTS - 1)
    x[BUCKETS + N_STATS + np.arange(N_STATS) * CUTS + place] = 0.5
    return x


class Model:
    """w0, w [features], v [features, rank]."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.w0 + x @ self.w + 0.5 * (s * s - (x * x) @ (self.v * self.v)).sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x).astype("float64"), -30, 30))), 6)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Minimise the logistic loss by Adam; both classes weigh as they occur."""
    rng = np.random.default_rng(SEED)
    p = [np.zeros(1, "float32"), np.zeros(x.shape[1], "float32"), rng.normal(0, 0.05, (x.shape[1], RANK)).astype("float32")]
    m, u, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs if len(x) else 0):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            xb, yb = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
            s = xb @ p[2]
            x2 = xb * xb
            z = p[0] + xb @ p[1] + 0.5 * (s * s - x2 @ (p[2] * p[2])).sum(1)
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - yb) / len(yb)).astype("float32")
            grads = [e.sum(keepdims=True), xb.T @ e + DECAY * p[1], xb.T @ (e[:, None] * s) - (x2.T @ e)[:, None] * p[2] + DECAY * p[2]]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                u[k] = 0.999 * u[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(u[k] / (1 - 0.999**t)) + 1e-8)
    return Model(float(p[0][0]), p[1], p[2] if len(x) else 0 * p[2])


def is_held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def fit_on_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on ``sample`` labels at most, the least by a hash of their key, none of them held out.

    Null labels and unlabelled rows take no part; without any, all scores are 0.5. Where rows repeat a key, 2 * ``sample``
    rows at most take part, the least by key and features, so the model is the same for the same rows. Keys are of any
    type that can be ordered. Null, empty and very long texts are texts like any other; an empty table gives the model
    without labels.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~is_held_out(key)).select(F.col(key).alias("k"), F.col(label).cast("float").alias("y"))
    drawn = known.orderBy(F.xxhash64("k", F.lit("fit")), "k", "y").limit(sample)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), CHUNK):
                c = b.iloc[i : i + CHUNK]
                yield pd.DataFrame({"k": c["k"], "x": [features(t).astype("<f2").tobytes() for t in c["t"]], "y": c["y"]})

    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(drawn), "k")
    kind = docs.schema[key].dataType.simpleString()
    rows = joined.mapInPandas(vectors, f"k {kind}, x binary, y float").orderBy("k", "x", "y").limit(2 * sample).collect()
    x = np.array([np.frombuffer(r["x"], "<f2") for r in rows], "float32").reshape(len(rows), N_FEATURES)
    return fit(x, np.array([r["y"] for r in rows], "float32"))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a column score (0 to 1) from the text alone.

    Null and empty texts have the score of a text without words; very long ones are hashed whole, in slices. Repeated rows
    score alike and all stay. An existing column score is replaced. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))
    kept = docs.drop("score")

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*held.value)
        for t in texts:
            parts = [m.scores(np.array([features(s) for s in t.iloc[i : i + CHUNK]])) for i in range(0, len(t), CHUNK)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return kept.withColumn("score", run(F.col(text)))
