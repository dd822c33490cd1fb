"""The index is built where texts are read: no posting is shuffled, and blocks lose none."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from captionlake.operators import index as I

ROWS = [(1, "abcabc \U00020000bc因緣"), (2, "a\0\0\0b"), (3, None), (4, ""), (5, "ab"), (6, "The the THE then"), (7, "因緣因緣x"), (8, "abc " * 3000), (9, "ab cd ab")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, t string")


def test_no_posting_is_shuffled(docs, tmp_path, monkeypatch):
    plans, real = [], DataFrameWriter.parquet

    def seen(self, path, *a, **k):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    I.TextIndex(docs.sparkSession, str(tmp_path / "i")).add(docs, "t")
    assert plans and not any("Exchange" in p for p in plans)


def test_a_row_holds_a_block_of_postings(spark, tmp_path):
    index = I.TextIndex(spark, str(tmp_path / "i"))
    index.add(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same words again").alias("t")), "t", files=1)
    rows = spark.read.parquet(f"{index.path}/postings")
    assert rows.filter("kind = 'token'").count() == 3 and rows.filter("kind = 'gram'").count() == len({"same words again"[i : i + 3] for i in range(14)})
    assert index.postings("token", ["again"]).filter("places = array(3)").count() == 500


@pytest.mark.parametrize("chars", [5, 1 << 21])
def test_postings_equal_to_brute_force(spark, docs, chars, tmp_path, monkeypatch):
    grams, words = {}, {}
    for k, t in ROWS:
        for i in range(len(t or "") - 2):
            grams.setdefault(t.lower()[i : i + 3], set()).add(k)
        for i, w in enumerate(I.query_tokens(t or ""), 1):
            words.setdefault(w, {}).setdefault(k, []).append(i)
    monkeypatch.setattr(I, "BLOCK_CHARS", chars)
    batches = lambda: I._postings(iter(docs.filter("t <> ''").select("doc_id", F.lower("t").alias("t"), I.tokens(F.col("t")).alias("words")).toArrow().to_batches()))
    got_grams, got_words = {}, {}
    for b in batches():
        for r in b.to_pylist():
            if r["kind"] == "gram":
                got_grams.setdefault(r["term"], set()).update(r["keys"])
            else:
                assert not got_words.get(r["term"], {}).keys() & set(r["keys"])
                got_words.setdefault(r["term"], {}).update(zip(r["keys"], r["places"], strict=True))
    assert got_grams == grams and got_words == words
    index = I.TextIndex(spark, str(tmp_path / "i"))
    index.add(docs, "t")
    index.add(docs, "t")  # done again: the same postings
    assert {(r.term, r.key, tuple(r.places)) for r in index.prefixed("").collect()} == {(w, k, tuple(p)) for w, at in words.items() for k, p in at.items()}


def test_long_texts_are_cut_into_overlapping_pieces():
    text = "abcdefgabxyz" * 7 + "\U0001f600q"
    want = sorted({tuple(map(ord, text[i : i + 3])) for i in range(len(text) - 2)})
    for piece in (1, 2, 10, 1000):
        g = I.distinct_grams(text, piece)
        assert [(x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF) for x in g.tolist()] == want
    assert I.distinct_grams("ab").dtype == np.int64 and not len(I.distinct_grams("ab"))
