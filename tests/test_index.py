"""The stored index: routes, pruning, appends and snippets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from captionlake.operators.index import BUCKETS, TextIndex, query_tokens, ranked, routed, search

ROWS = [(1, "今天講因緣具足的道理"), (2, "佛法在世間"), (3, "Dharma in the WORLD, AI翻譯"), (4, "緣因 world-wide"), (5, None), (6, ""), (7, "ab"), (8, "因緣生法；" * 500), (9, "word wor ld")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, t string").withColumn("len", F.lit(1))


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    out = TextIndex(spark, str(tmp_path_factory.mktemp("index")))
    out.add(docs, "t")
    return out


def brute(q, rows=ROWS):
    way, q = routed(q)
    if way == "gram":
        return {k for k, t in rows if t and q.lower() in t.lower()}
    han = lambda c: re.match("[㐀-鿿]", c)
    words = query_tokens(q)
    if words and all(map(han, words)):
        return {k for k, t in rows if t and "".join(words) in t}
    return {k for k, t in rows if t and words and all(any(x.startswith(w) if not han(w) else x == w for x in query_tokens(t)) for w in words)}


@pytest.mark.parametrize("q", ["因緣具足", "因 緣 具", "因緣", "緣因", "佛", "wo", "WORLD", "A翻", "ld, ai", "zz", "?!", "", "b", "in the world", "的道理今"])
def test_every_route_equals_a_scan(index, docs, q):
    assert {r.doc_id for r in search(index, docs, "t", q).collect()} == brute(q)


def test_routes():
    assert routed("因 緣 生") == ("gram", "因緣生") and routed(" 因緣 ") == ("token", "因緣") and routed("a  b") == ("token", "a b") and routed(" tion  the ") == ("gram", "tion the")


def test_only_the_folders_of_the_terms_are_read(index):
    rows = index.postings("gram", ["因緣具", "緣具足"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S).group(1)
    assert "kind" in filters and "bucket" in filters and "PushedFilters: [" in plan and "In(term" in plan
    folders = {r.b for r in index.spark.read.parquet(f"{index.path}/postings").filter("kind = 'gram' AND term IN ('因緣具', '緣具足')").select(F.col("bucket").alias("b")).distinct().collect()}
    named = re.search(r"bucket#?\d* IN \(([\d,]+)\)|\(bucket#\d+ = (\d+)\)", filters)
    assert {int(x) for x in (named.group(1) or named.group(2)).split(",")} == folders and len(folders) <= 2 < BUCKETS
    assert rows.select("term").distinct().count() == 2


def test_appends_and_documents_that_are_not_indexed_yet(spark, docs, tmp_path):
    part = TextIndex(spark, str(tmp_path / "i"))
    part.add(docs.filter("doc_id % 3 = 0"), "t")
    for q in ("因緣具足", "因緣", "wor", "world"):
        assert {r.doc_id for r in search(part, docs, "t", q).collect()} >= brute(q, [r for r in ROWS if r[0] % 3 == 0])
    part.add(docs.filter("doc_id % 3 = 1"), "t")
    part.add(docs.filter("doc_id % 3 = 1"), "t")  # an append that is done twice changes nothing
    part.add(docs.filter("doc_id % 3 = 2"), "t", files=2)
    for q in ("因緣具足", "因緣", "wo", "world"):
        got = [r.doc_id for r in search(part, docs, "t", q).collect()]
        assert sorted(got) == sorted(brute(q))


def test_an_append_that_fails_half_way_is_not_seen(spark, docs, tmp_path, monkeypatch):
    half = TextIndex(spark, str(tmp_path / "i"))
    half.add(docs.filter("doc_id = 1"), "t")
    from pyspark.sql.readwriter import DataFrameWriter

    real = DataFrameWriter.parquet

    def broken(self, path, *a, **k):
        if path.endswith("lengths"):
            raise OSError("lost")
        return real(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        half.add(docs.filter("doc_id = 8"), "t")
    monkeypatch.undo()
    assert sorted(r.doc_id for r in search(half, docs, "t", "因緣生").distinct().collect()) == [8]  # by looking through it
    half.add(docs.filter("doc_id = 8"), "t")
    assert [r.doc_id for r in search(half, docs, "t", "因緣生").collect()] == [8]


def test_current_rows_only(index, docs):
    assert {r.doc_id for r in search(index, docs, "t", "因緣", F.col("doc_id") < 8).collect()} == {1}


def test_snippets(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "Beta", "gamma", "delta"], k=40)) + (" needle" if i == 3 else "")) for i in range(20)]
    docs, index = spark.createDataFrame(rows, "doc_id long, t string"), TextIndex(spark, str(tmp_path / "i"))
    index.add(docs, "t")
    (r,) = ranked(index, docs, "t", ["needle"], 5).collect()
    assert r.doc_id == 3 and r.snippet.startswith("… ") and r.snippet.endswith("[needle]") and len(r.snippet.split()) == 17
    assert ranked(index, docs, "t", ["absent"], 5).count() == 0
