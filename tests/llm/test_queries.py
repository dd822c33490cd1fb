"""The registered queries over the smallest tables, whole results against brute force; those with SQL against it."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from captionlake.llm import fm, pii
from captionlake.llm.queries import ORACLES, QUERIES

from .test_documents import brute_components, brute_repeats, brute_shards

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations", "benchmark"):
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(plain([r[c] for c in columns])) for r in df.collect()) == sorted(repr(plain([r[i] for i in at])) for r in want.fetchall())


def test_op2(spark, docs):
    got, map_ = {r.doc_id: r for r in QUERIES["op2_pii_surrogates"](spark, SF).collect()}, {}
    assert set(got) == {r.doc_id for r in docs}
    for r in docs:
        new = got[r.doc_id]
        if not new.entities:
            assert new.text == r.text
            continue
        rest, at = new.text, 0
        for e in new.entities:  # what is between the surrogates stands in the text, in order
            cut = rest.index(e.new)
            at = r.text.index(rest[:cut], at) + cut
            rest = rest[cut + len(e.new):]
            map_.setdefault((e.kind, e.new.lower()), set()).add(r.doc_id)
        assert r.text.endswith(rest)
    assert map_


def test_op3(spark, docs):
    got = QUERIES["op3_unigram_encoding"](spark, SF).collect()
    text = {r.doc_id: r.text for r in docs}
    assert len(got) == len(docs) and all(r.round_trip and r.decoded_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)


def test_op6(spark, docs):
    got = QUERIES["op6_sampled_splitters"](spark, SF).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == brute_shards([(r.doc_id, r.text) for r in docs], 16)


def test_op8(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fm.fit_on_labels(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = {r.doc_id: r for r in QUERIES["op8_quality_classifier"](spark, SF).collect()}
    for r in docs:
        score = float(model.scores(fm.features(r.text)[None])[0])
        x = got[r.doc_id]
        assert abs(x.score - score) < 1e-4 and x.predicted == int(x.score >= 0.7) and x.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op9(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference, want, bins = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter(), defaultdict(list)
    for r in docs:
        ids = [*reference.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for piece, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : first if piece == 0 else a + 1024]
            want[r.doc_id, piece, a, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got = QUERIES["op9_best_fit_packing"](spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
    least = -(-sum(r.length for r in got) // 1024)
    assert len(bins) <= 1.06 * least + 1 and all(sum(n for _, n in p) <= 1024 for p in bins.values())


def test_op10(spark, docs):
    got = QUERIES["op10_suffix_array_dedup"](spark, SF).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r.doc_id, *x) for r, x in zip(docs, brute_repeats([r.text for r in docs]), strict=True))


def test_pipeline(spark, docs):
    """Each stage on what the one before kept."""
    import corpus_pipeline as P

    now = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(P.STAGES)
    model = fm.fit_on_labels(now, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = P.written(stages["quality classifier"](spark, now, SF))
    rows = kept.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs if float(model.scores(fm.features(r.text)[None])[0]) >= P.LEAST_SCORE}
    single = P.written(stages["near dedup"](spark, kept, SF))
    near = single.collect()
    assert sorted(r.doc_id for r in near) == sorted(k for k, n, c in brute_components([(r.doc_id, r.text) for r in rows], 5, 80) if k == c)
    cut = P.written(stages["repeated passages"](spark, single, SF))
    want = {r.doc_id: x for r, x in zip(near, brute_repeats([r.text for r in near]), strict=True)}
    left = cut.collect()
    assert all(len((r.text or "").encode()) >= want[r.doc_id][0] - want[r.doc_id][1] for r in left) and {r.doc_id for r in left} == set(want)
    assert all(r.text == next(x.text for x in near if x.doc_id == r.doc_id) for r in left if want[r.doc_id][1] == 0)
    safe = P.written(stages["personal data"](spark, cut, SF))
    direct = {r.doc_id: r.text for r in pii.replace_entities(cut, P.PII_KEY).collect()}
    assert {r.doc_id: r.text for r in safe.collect()} == direct
    packed = stages["packing"](spark, safe, SF).collect()
    assert {r.doc_id for r in packed} == set(direct)
