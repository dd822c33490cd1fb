"""Readers, sinks and text functions on small fixtures."""

import gzip
import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from captionlake.functions import sequences as Q
from captionlake.functions import text as X
from captionlake.functions.dictionary import entry_keys, query_keys
from captionlake.sources import readers as R
from captionlake.sources import sinks as K


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_tolerant_reader_counts_bad_lines(spark, tmp_path):
    rows = R.tolerant_jsonl(spark, put(tmp_path, "a.jsonl", '{"a": 1}\nnot json\n{"a": 2}\n'), "a int").cache()
    assert R.bad_lines(rows).first().asDict() == {"bad": 1, "lines": 3}


def test_strict_reader_refuses_repeated_keys(spark, tmp_path):
    assert R.strict_jsonl(spark, put(tmp_path, "a.jsonl", '{"id": "x"}\n{"id": "y"}\n'), "id string", "id").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        R.strict_jsonl(spark, put(tmp_path, "b.jsonl", '{"id": "x"}\n{"id": "x"}\n'), "id string", "id").collect()


def test_glossary_forms(spark, tmp_path):
    rows = [{"zh": "甲", "en": "first", "status": "active"}, {"zh": "乙", "en": "second", "status": "off"}]
    want = [("甲", "first")]
    for name, text, kind in (("a.json", json.dumps(rows), "json"), ("b.json", json.dumps({"terms": rows}), "json"), ("c.csv", "zh,en,status\n甲,first,active\n乙,second,off\n", "csv")):
        assert [tuple(r) for r in R.glossary(spark, put(tmp_path, name, text), kind).collect()] == want


def test_phrase_pack_keeps_the_first_of_equal_keys(spark, tmp_path):
    got = R.phrase_pack(spark, put(tmp_path, "a.tsv", "Abc\tone\tx\nabc \ttwo\ty\n" + "z" * 300 + "\tl\tm\n")).collect()
    assert [(r.key, r.en) for r in got] == [("abc", "one")]


def test_cedict_lines(spark, tmp_path):
    got = R.cedict(spark, put(tmp_path, "a.u8", "# comment\n漢字 汉字 [han4 zi4] /Chinese character/word/\nbroken line\n")).collect()
    assert [(r.word, r.pronunciation, r.en, r.rejected) for r in got] == [("漢字", "han4 zi4", ["Chinese character", "word"], False), (None, None, None, True)]


def test_word_csv_and_log_tail(spark, tmp_path):
    head = "word,phonetic,definition,translation,pos,tag,exchange\n"
    assert [r.rejected for r in R.word_csv(spark, put(tmp_path, "a.csv", head + 'go,x,"to\nmove",走,v,,\n,,,,,,\n')).collect()] == [False, True]
    log = "".join(f'12:0{i} TIMING {{"ms": {i}}}\nnoise\n' for i in range(5))
    assert [r.ms for r in R.log_tail(spark, put(tmp_path, "a.log", log), "TIMING", "ms int", 2).collect()] == [3, 4]


def test_cues_recover_at_blank_lines(spark, tmp_path):
    text = "WEBVTT\n\n1\n00:00:01,000 --> 00:00:02,500\nhello\nworld\n\nrubbish\n\n01:02.003 --> 01:03.000\nend\n"
    got = R.cues(spark, put(tmp_path, "a.srt", text)).orderBy("number").collect()
    assert [(r.t0, r.t1, r.text) for r in got] == [(1000, 2500, "hello\nworld"), (62003, 63000, "end")]


def test_wave_info(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
        w.writeframes(struct.pack("<4h", 16384, -16384, 16384, -16384) * 4000)
    put(tmp_path, "b.wav", "no audio")
    got = {r.file[-5:]: r for r in R.wave_info(spark, str(tmp_path)).collect()}
    assert (got["a.wav"].seconds, got["a.wav"].rms) == (1.0, 0.5) and got["b.wav"].rate is None


def test_upsert_keeps_the_greatest_version(spark):
    a = spark.createDataFrame([(1, 2, "old"), (2, 5, "stays")], "id int, v int, t string")
    b = spark.createDataFrame([(1, 2, "new"), (2, 4, "late"), (3, 1, "added")], "id int, v int, t string")
    assert sorted((r.id, r.t) for r in K.upsert(a, b, ["id"], "v").collect()) == [(1, "new"), (2, "stays"), (3, "added")]


def test_snapshots_and_exports(spark, tmp_path):
    root = str(tmp_path / "s")
    K.write_snapshot(spark.range(3), root, "one")
    K.write_snapshot(spark.range(5), root, "two")
    assert K.read_snapshot(spark, root).count() == 5
    K.write_jsonl(spark.range(100), str(tmp_path / "j"), ["id"])
    lines = [json.loads(x)["id"] for p in sorted((tmp_path / "j").glob("part*")) for x in gzip.open(p, "rt")]
    assert lines == list(range(100))
    good, bad = K.split_bad(spark.createDataFrame([(1,), (None,), (3,)], "a int"), F.col("a") > 2)
    assert good.count() == 1 and bad.count() == 2
    K.guarded_csv(spark.createDataFrame([("=1+1", 1), ("ok", 2)], "a string, b int"), str(tmp_path / "c"))
    assert sorted(r.a for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["'=1+1", "ok"]


def test_text_functions(spark):
    assert one(spark, "ＡＢＣ Straße ", X.nfkc_fold) == "abc strasse"
    assert one(spark, "你好, World!", X.memory_key) == "你好world"
    assert one(spark, "因缘，净 学ＡＢ! ﬁ", X.translation_key) == "因緣淨學abfi" and len(X.SIMPLIFIED) == len(X.TRADITIONAL)
    assert one(spark, "你a", X.display_width) == 1.5 and one(spark, "你a", X.half_width) == 1.5
    assert one(spark, "我爱AI", X.space_han) == "我 爱 AI"
    assert one(spark, "3723004", lambda c: X.timecode(c.cast("long"))) == "01:02:03,004"
    assert one(spark, "01:02:03,004", X.timecode_ms) == 3723004 and one(spark, "01:62:03,004", X.timecode_ms) is None
    assert one(spark, "<p>a &amp; b<script>x</script></p><!-- c -->", X.visible_text) == "a & b"
    assert one(spark, "kitten", lambda c: X.edit_rate(c, F.lit("sitting"))) == 0.5


def test_sequence_functions(spark):
    assert one(spark, "abcd", lambda c: Q.match_ratio(c, F.lit("bcde"))) == 0.75
    assert one(spark, "colour of colourful", Q.rewrite({"colour": "color", "colourful": "vivid"})) == "color of vivid"
    assert one(spark, "ab", Q.rewrite({"a": "b", "b": "a"})) == "ab"
    guarded = Q.rewrite({"設課": "Q", "課程": "R", "空中": "S"})
    assert one(spark, "建設課程，設課，課程，天空中", guarded) == "建設課程，Q，R，天空中"
    assert one(spark, "the then with", lambda c: Q.longest_first(c, ["the", "then", "with"])) == ["then", "with", "the"]
    assert one(spark, "x" + "ha" * 6, Q.has_loop) and not one(spark, "no loop here", Q.has_loop)


def test_dictionary_keys(spark):
    row = spark.sql("SELECT 'Run' AS w, 'runs' AS a, array('to run fast', 'a race') AS g")
    assert row.select(entry_keys(F.col("w"), F.col("a"), F.col("g")).alias("k")).first()["k"] == ["run", "runs", "to run fast", "fast", "a race", "race"]
    assert one(spark, "go 你好吗", query_keys) == ["go", "你好吗", "你好", "好吗", "你", "好", "吗"]


def test_guarded_aliases_are_told(spark):
    aliases, guards = {"設課": "Q", "設課程": "R", "天空": "T", "海": "U"}, ("建設課程", "天空")
    rows = [(0, "建設課程與海"), (1, "開設課程"), (2, "天空天空建設課"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: (r.g, r.r) for r in df.select("i", Q.guarded(aliases, guards)("t").alias("g"), Q.rewrite(aliases, guards=guards)("t").alias("r")).collect()}
    assert got == {0: (["R"], "建設課程與U"), 1: ([], "開R"), 2: (["T"], "天空天空建Q"), 3: ([], ""), 4: (None, None)}
