"""Term matching, line breaking and sinks that fail half-way."""

import random
import re

import pytest
from pyspark.sql import functions as F

from captionlake.functions.sequences import NARROWER, NOT_FIRST, NOT_LAST, break_lines
from captionlake.operators.terms import matched, missing_locked, prompt_terms
from captionlake.sources import sinks as K


@pytest.mark.parametrize("most_chars", [1 << 20, 12])
def test_terms_are_leftmost_and_longest(spark, most_chars):
    rng = random.Random(1)
    terms = sorted({"".join(rng.choices("ab天", k=rng.randint(1, 5))) for _ in range(30)})
    lines = [(i // 7, i, "".join(rng.choices("ab天c", k=rng.randint(0, 25)))) for i in range(60)] + [(9, 60, None), (9, 61, "")]
    pattern = re.compile("|".join(map(re.escape, sorted((t for t in terms if len(t) > 1), key=len, reverse=True))))
    want = {i: pattern.findall(t or "") for _, i, t in lines}
    found = matched(spark.createDataFrame(lines, "s int, i int, t string"), spark.createDataFrame([(t,) for t in terms], "term string"), ["s", "i"], "t", "term", most_chars)
    got = prompt_terms(found, ["s"], "i").collect()
    assert {r.i: list(r.found) for r in got} == want
    for r in got:
        before = [x for s, i, _ in lines if s == r.s and r.i - 4 <= i < r.i for x in want[i]]
        assert list(r.prompt) == list(dict.fromkeys(want[r.i] + before))[:40]


def test_locked_terms_count_as_whole_words(spark):
    found = spark.createDataFrame([(1, ["禪", "佛"], "the zenith"), (2, ["禪"], "A ZEN-garden"), (3, ["佛", "x"], None), (4, ["c++"], "use c++ now")], "i int, found array<string>, en string")
    terms = spark.createDataFrame([("禪", "Zen", True), ("佛", "Buddha", False), ("x", "y", True), ("c++", "C++", True)], "term string, target string, locked boolean")
    assert {(r.i, r.term) for r in missing_locked(found, terms, ["i"], "en").collect()} == {(1, "禪"), (3, "x")}


def test_lines_break_as_the_rules_say(spark):
    texts = ["今日は東京へ行きました。明日は京都です", "価格は1,250円です", "「あ」「い」「う」", "コンピューターを使う", "{漢字|かんじ}を読みます", "abc defgh いろは", "ああああああああ", "", None, "、、、、", "「「「「", "3時間で10kmを走りましょう"]
    rng = random.Random(2)
    texts += ["".join(rng.choices("あ。、「」はがコンab1２年です", k=rng.randint(1, 30))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for width in (3, 8):
        for r in df.withColumn("l", break_lines(width, 99)(F.col("t"))).collect():
            if not r.t:
                assert not r.l
                continue
            assert "".join(r.l) == r.t
            for a, b in zip(r.l, r.l[1:]):
                assert a[-1] not in NOT_LAST and b[0] not in NOT_FIRST
                assert not (a[-1].isdecimal() and b[0].isdecimal()) and not (a[-1] in "コン" and b[0] in "コン")
    out = {r.t: r.l for r in df.withColumn("l", break_lines(8, 99)(F.col("t"))).collect()}
    assert out["今日は東京へ行きました。明日は京都です"] == ["今日は東京へ", "行きました。", "明日は京都です"]
    assert out["{漢字|かんじ}を読みます"] == ["{漢字|かんじ}を読みます"] and out["コンピューターを使う"] == ["コンピューターを", "使う"] and NARROWER == 2.0
    two = df.filter("i = 0").withColumn("l", break_lines(8, 2)(F.col("t"))).first().l
    assert two == ["行きました。", "明日は京都です"]


def test_a_snapshot_is_seen_only_if_it_is_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    first = K.write_snapshot(spark.range(3), root, "one")
    assert first[0] == 3 and K.read_snapshot(spark, root).count() == 3
    with pytest.raises(ValueError):
        K.write_snapshot(spark.range(5), root, "two", expected=(6, "0:0"))
    assert K.read_snapshot(spark, root).count() == 3
    monkeypatch.setattr(K, "_pointers", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        K.write_snapshot(spark.range(5), root, "two")
    monkeypatch.undo()
    assert K.read_snapshot(spark, root).count() == 3
    K.write_snapshot(spark.range(5), root, "two", expected=K.digest(spark.range(5).repartition(3)))
    assert K.read_snapshot(spark, root).count() == 5 and K.digest(spark.range(5)) != K.digest(spark.range(1, 6))


def test_dead_letters_are_replayed_oldest_first(spark, tmp_path):
    path, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    sink = K.batch_sink(path, dead, lambda df: F.col("a") > 2)
    for i, rows in enumerate([[(1,), (3,)], [(2,), (None,)], [(9,)]]):
        sink(spark.createDataFrame(rows, "a int"), i)
    sink(spark.createDataFrame([(1,), (3,)], "a int"), 0)  # a batch that runs again
    assert sorted(r.a for r in spark.read.parquet(path).collect()) == [1, 2]
    seen = []

    def write(df):
        rows = [r.a for r in df.collect()]
        if 9 in rows and len(seen) < 3:
            seen.append("failed")
            raise OSError("lost")
        seen.append(rows)

    assert K.replay(spark, dead, "a int", write) == 2 and seen == [[3], [None], "failed"]
    assert K.replay(spark, dead, "a int", write) == 1 and seen[-1] == [9]
    assert K.replay(spark, dead, "a int", write) == 0


def test_digests_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_bytes(b"abc")
    assert [tuple(r) for r in K.file_digests(spark, str(tmp_path)).collect()] == [("a.txt", 3, hashlib.sha256(b"abc").hexdigest())]
