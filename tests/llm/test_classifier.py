"""The quality classifier a second time in plain Python, and its accuracy on held-out labels."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import pytest
import xxhash

from captionlake.llm import fm
from captionlake.llm.queries import QUERIES

from .helpers import odd_documents


def plain_features(text):
    data = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    words = low.split()
    n, x = len(words), {}
    counts = Counter(xxhash.xxh3_64_intdigest(w) % 1024 for w in words)
    for bucket, c in counts.items():
        x[bucket] = math.sqrt(c / n)
    kinds = Counter(
        "beyond" if b > 127 else "upper" if 65 <= b <= 90 else "lower" if 97 <= b <= 122 else "digit" if 48 <= b <= 57 else "line" if b == 10 else "blank" if chr(b).isspace() else "mark" if chr(b) in ".,;:!?'\"()-" else "other" for b in data
    )
    stats = [math.sqrt(kinds[k] / max(len(data), 1)) for k in ("upper", "lower", "digit", "beyond", "line", "blank", "mark", "other")]
    lines = [s for s in data.split(b"\n") if s.strip()]
    stats += [min(1, math.log1p(n) / 12), min(1, math.log1p(len(data)) / 16), min(1, len(data) / max(n, 1) / 20), len(set(words)) / max(n, 1), 1 - len(set(lines)) / max(len(lines), 1), min(1, n / max(len(lines), 1) / 100), max(counts.values(), default=0) / max(n, 1)]
    for i, s in enumerate(stats):
        x[1024 + i] = s
        x[1024 + 15 + 10 * i + min(int(s * 10 + 1e-6), 9)] = 0.5
    return {i: v for i, v in x.items() if v}


def near_edge(text):
    """Whether a statistic is so near the edge of an interval that rounding decides."""
    return any(abs(v * 10 - round(v * 10)) < 1e-4 for i, v in plain_features(text).items() if 1024 <= i < 1039)


@pytest.mark.parametrize("seed", [1, 2])
def test_features_again(seed):
    rng = random.Random(seed)
    texts = [r[1] for r in odd_documents(seed)] + ["".join(rng.choices("aB1 é\n.#\t", k=rng.randint(0, 200))) for _ in range(100)]
    for t in texts:
        got = fm.features(t)
        want = plain_features(t)
        if not near_edge(t):
            assert {i for i, v in enumerate(got) if v} == set(want)
        assert all(abs(got[i] - v) < 1e-4 for i, v in want.items() if i < 1039)


def test_the_score_is_the_sum_over_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    model = fm.Model(0.3, rng.normal(size=fm.N_FEATURES).astype("float32"), rng.normal(0, 0.3, (fm.N_FEATURES, fm.RANK)).astype("float32"))
    for t in ("a few words, of one line", "", "x\nx\n12 é"):
        x = {i: float(v) for i, v in enumerate(fm.features(t)) if v}
        z = model.w0 + sum(float(model.w[i]) * v for i, v in x.items()) + sum(float(model.v[i] @ model.v[j]) * x[i] * x[j] for i, j in combinations(x, 2))
        assert abs(float(model.logits(fm.features(t)[None])[0]) - z) < 1e-3


def test_accuracy_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    score = {r.doc_id: r.score for r in QUERIES["op8_quality_classifier"](spark, sf).collect()}
    rows = [(score[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None and r.doc_id in score and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = [s for s, q in rows if q], [s for s, q in rows if not q]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert len(rows) > 50 and auc >= 0.9, (len(rows), auc)
