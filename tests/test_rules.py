"""Rules of captions, glossaries and jobs on hand-made rows and against brute force."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from captionlake.functions import captions as C
from captionlake.operators import folds
from captionlake.operators import glossary as G


def values(spark, column, rows, schema):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_english_replies(spark):
    good = ["A line.", " Of course, we begin. ", "two\nlines", '{"translation": "x", "en": "y"}', '{"current": "", "en": " y "}', "say 漢字 twice", "a \"quoted\" word", "x" * 400]
    bad = ["", None, "Here is the translation: a", "a\nOutput: b", "a\n\nb", "a\n note: b", "'a'", "```x", "[1]", '{"en": 5}', '{"en"', "字漢", "a <think> b", "<|end|>", "go /no_think", "a\u0007b", "a\u2028b", "x" * 401]
    got = values(spark, C.english_reply(F.col("r"), F.lit("短"), F.array(F.lit("the 漢字 way"))), good + bad, "r string")
    assert got == ["A line.", "Of course, we begin.", "two\nlines", "x", "y", "say 漢字 twice", "a \"quoted\" word", "x" * 400] + [None] * len(bad)
    assert values(spark, C.plain_english(F.col("r")), ["漢字", "\"", "a"], "r string") == [False, True, True]


def test_japanese_replies(spark):
    rows = [("これは線です。", "這是線。"), ("短線", "長條"), ("這是，線", "這是線"), ("英語の 行", None), ("plain", "這"), ("一二三四五六七八九", "甲乙"), ("行\nです", "x"), ("一二三四五六七", "一二三四五六七八"), (None, "x")]
    got = values(spark, C.japanese_reply(F.col("r"), F.col("s")), rows, "r string, s string")
    assert got == ["これは線です。", "短線", None, "英語の 行", None, None, None, None, None]


def test_typography_matches_brute_force(spark):
    japanese = lambda c: any(p in unicodedata.name(c, "") for p in ("CJK UNIFIED", "CJK COMPATIBILITY", "HIRAGANA", "KATAKANA"))

    def brute(t):
        t = re.sub(r"\{([^{}|]+)\|[^{}|]+\}", r"\1", t)
        safe = {i for p in (r"[A-Za-z0-9]+(?:[,.?!:;][A-Za-z0-9]+)*", r"(?:[A-Za-z]\.){2,}") for m in re.finditer(p, t) for i in range(*m.span())}
        marks = sum(c in ",.?!:;" and i not in safe for i, c in enumerate(t)) if any(map(japanese, t)) else 0
        left, bad = "", 0
        for c in t:
            if c in "「『（":
                left += c
            elif c in "」』）":
                if left and "「」『』（）".find(left[-1]) + 1 == "「」『』（）".find(c):
                    left = left[:-1]
                else:
                    bad += 1
        residue = sum(c in C.CHINESE_GLYPHS for c in t) + sum(t[i] == "，" and japanese(t[i - 1]) and japanese(t[i + 1]) for i in range(1, len(t) - 1))
        doubled = sum(t[i : i + 2] in ("。。", "、、") for i in range(len(t)))
        width = sum(1.0 if unicodedata.east_asian_width(c) in "WF" else 0.5 for c in t)
        return marks, bad + len(left), residue, doubled, int(t.lstrip().startswith(("、", "。"))), int(width > 16)

    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "e.g.", "B.", "3", ",", ".", " ", "，", "。", "、", "漢", "か", "ア", "这", "「", "」", "『", "』", "（", "）", "{", "|", "}", "!"], k=rng.randint(0, 20))) for _ in range(300)] + ["", "xe.g.,a"]
    got = values(spark, F.struct(*C.typography(F.col("t")).values()), texts, "t string")
    assert [tuple(g) for g in got] == [brute(t) for t in texts]


def test_phrases_join_to_the_text(spark):
    def brute(t):
        out = [""]
        for c in t:
            out[-1] += c
            if c in C.PHRASE_END or len(out[-1]) == 12:
                out.append("")
        return [p for p in out if p]

    rng = random.Random(4)
    texts = ["".join(rng.choices("あいう、。\n!」", weights=[9, 9, 9, 1, 1, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(100)]
    assert values(spark, C.phrases(F.col("t")), texts, "t string") == [brute(t) for t in texts]
    terms = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(r).alias("reading")) for t, r in (("字", "じ"), (" 字", "あざ"), ("漢", ""), ("", "x"), ("無", "む"))])
    assert values(spark, C.readings_in(F.col("t"), terms), ["漢字"], "t string") == [[("字", "じ")]]


def test_glossary_lines(spark):
    texts = [("a", "# c\n\n 詞 |別名| |x= word = more \n全＝full\nno separator\n=empty\nlong=" + "y" * 90), ("b", "\n".join(f"t{i}=w" for i in range(45))), ("c", None), ("d", "a=b\u2028c=d"), ("e", "a|=b"), ("f", "a = b\n\nc|d = e")]
    df = spark.createDataFrame(texts, "id string, text string")
    lenient = [tuple(r) for r in G.lenient_terms(df, "id", "text").orderBy("id", "line").collect()]
    assert [r for r in lenient if r[0] != "b"] == [
        ("a", 3, "詞", "word = more", ["別名", "x"]), ("a", 4, "全", "full", []), ("a", 7, "long", "y" * 80, []), ("d", 1, "a", "b", []), ("d", 2, "c", "d", []),
        ("e", 1, "a", "b", []), ("f", 1, "a", "b", []), ("f", 3, "c", "e", ["d"]),
    ]
    assert [r[1] for r in lenient if r[0] == "b"] == list(range(1, 41))
    strict = [(r.id, r.line, r.term if r.reason is None else None, r.reason) for r in G.strict_terms(df, "id", "text").orderBy("id", "line", "reason").collect()]
    assert strict == [
        ("a", 3, None, "empty_alias"), ("a", 5, None, "no_separator"), ("a", 6, None, "empty_side"), ("a", 7, None, "long_target"), ("b", 41, None, "too_many"), ("c", 0, None, "no_terms"),
        ("d", 0, None, "hidden_break"), ("e", 1, None, "empty_alias"), ("f", 1, "a", None), ("f", 3, "c", None),
    ]


def test_glossary_sets(spark):
    rows = [(1, "Learning", ["ML", "x"]), (2, "learning", ["zz"]), (3, "deep", ["ml", "learning", "開始", "earn"]), (4, "net", None)]
    got = {tuple(r) for r in G.set_violations(spark.createDataFrame(rows, "id long, term string, aliases array<string>")).collect()}
    assert got == {(2, "duplicate", None), (1, "short_alias", "x"), (3, "stop_alias", "開始"), (3, "alias_is_term", "learning"), (3, "alias_in_term", "earn"), (1, "alias_owners", "ml"), (3, "alias_owners", "ml")}


def test_glossaries_are_judged_apart_and_by_folded_characters(spark):
    rows = [
        ("a", 1, "學社", ["学社会"]), ("a", 2, "学社", None), ("a", 3, "ＡＩ core", ["ai", "ＡＩ"]), ("b", 4, "ai", ["學社"]), ("b", 5, "x1", ["AI"]), ("b", 6, "ﬁx", ["fix"]),
        *[("c", 10 + i, f"t{i}", ["t"]) for i in range(4)], (None, 99, "n", ["n"]),
    ]
    got = {tuple(r) for r in G.set_violations(spark.createDataFrame(rows, "room string, id long, term string, aliases array<string>"), "room", 3).select("room", "id", "rule", "alias").collect()}
    # the ligature would become two characters, so it stays
    assert got == {("a", 2, "duplicate", None), ("b", 5, "alias_is_term", "ai"), ("c", 13, "too_many", None)}
    inside = spark.createDataFrame([(1, "ＡＩ core", ["x2"]), (2, "net", ["CORE"])], "id long, term string, aliases array<string>")
    assert {tuple(r) for r in G.set_violations(inside).collect()} == {(2, "alias_in_term", "core")}
    assert G.set_violations(inside.limit(0), None, 3).count() == 0


def test_job_leases(spark):
    rows = [
        (1, 0, 1, "claim", 1), (1, 5, 2, "claim", 2), (1, 9, 3, "beat", 1), (1, 15, 4, "finish", 2), (1, 18, 5, "finish", 1), (1, 99, 6, "claim", 1),  # done by its holder
        (2, 0, 7, "claim", 1), (2, 30, 8, "beat", 1), (2, 31, 9, "claim", 2), (2, 60, 10, "claim", 2), (2, 90, 11, "cancel", 0),  # three leases ran out
        (3, 0, 12, "claim", 1), (3, 2, 13, "defer", 1), (3, 3, 14, "claim", 1), (3, 4, 15, "cancel", 0), (3, 5, 16, "finish", 1), (4, 0, 17, "cancel", 0), (None, 0, 18, "claim", 1),
    ]
    df = spark.createDataFrame(rows, "key long, at long, id long, kind string, owner long")
    got = sorted((tuple(r) for r in folds.leases(df, 10, 2).collect()), key=repr)
    assert got == sorted([(1, "done", 1, 0, 3), (2, "failed", 2, 2, 3), (3, "cancelled", 1, 0, 0), (4, "cancelled", 0, 0, 0), (None, "running", 1, 0, 0)], key=repr)
