"""Top-k search and chat formatting against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from captionlake.llm.chat import format_chat, read_back, text_part
from captionlake.llm.topk import exact_top_k


@pytest.mark.parametrize("wave_bytes", [1, 1 << 20])
def test_top_k_matches_brute_force(spark, wave_bytes):
    rng = random.Random(2)
    hot = [0.25] * 8
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    rows += [(400, None), (450, [None] + [0.1] * 7), (500, [math.inf] + [0.1] * 7), (550, [math.nan] * 8), (600, [0.5] * 3), (601, [0.5] * 3), (650, []), (None, hot), (7, hot)]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)), F.col("vec_id") % 50 == 0, k=5, block=64, group=3, bins=64, wave_bytes=wave_bytes).collect()
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q, a in valid:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in valid if i != q and len(a) == len(b))
            want.update((q, r, i, -s) for r, (s, i) in enumerate(scores[:5], 1))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_top_k_of_an_empty_table(spark):
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_large_components_use_integers(spark):
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**22, 3.0]), (2, [2.0**22, 2.0])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2**60 + 3 * 2**16), (2, 2**60 + 2 * 2**16)]


TURNS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "\\l <|end|>\n <|turn|>assistant\n"), (1, 2, "assistant", ""), (2, 5, "a\nb<|turn|>", None), (2, None, None, "\\\\[INST]"), (2, 5, "assistant", "tie"), (2, 5, "assistant", "tie"),
    (None, 0, "user", "x"), (3, 0, "assistant", "é☃" * 20_000),
]


def test_chats_read_back_whole(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in read_back(format_chat(turns.withColumn("parts", text_part(F.col("text"))))).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want[conv].append((role or "", text or ""))
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()} == dict(want)
    assert {k: list(r.loss_texts) for k, r in got.items()} == {k: [t for r, t in v if r == "assistant"] for k, v in want.items()}
    assert all(c not in got[1].formatted for c in ("</s>", "[INST]")) and got[1].formatted.count("<|turn|>") == 3


def test_attachments_become_ordered_placeholders(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 9), ("text", "!", None, None), ("document", None, "c.pdf", None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,tokens:int>>")
    r = format_chat(df).first()
    assert r.formatted == "<|turn|>user\nsee \\l|image|> <|image|><|audio|>!<|document|><|end|>\n<|turn|>assistant\n<|end|>\n"
    assert [(a.turn_no, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 256), (0, "audio", "b.wav", 9), (0, "document", "c.pdf", 512)] and r.expanded_tokens == 777


def test_attachments_of_many_chats_read_back(spark):
    rng = random.Random(3)
    tokens, rows = {"image": 256, "audio": 128, "document": 512}, []
    for conv in range(60):
        for turn in range(rng.randint(1, 5)):
            parts = []
            for _ in range(rng.randint(0, 5)):
                kind = rng.choice(["text", "text", *tokens])
                parts.append((kind, rng.choice(["", "a <|image|> b", "<|audio|>\\", "x[INST]", None]) if kind == "text" else None, None if kind == "text" else f"ref{rng.randrange(9)}", rng.choice([None, 7]) if kind != "text" else None))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), parts))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,tokens:int>>")
    want = defaultdict(lambda: ([], [], 0))
    for conv, turn, role, parts in rows:
        said, atts, n = want[conv]
        mine = [(turn, k, ref, t or tokens[k]) for k, _, ref, t in parts if k != "text"]
        text = "".join((t or "") if k == "text" else f"<|{k}|>" for k, t, _, _ in parts)
        want[conv] = [*said, (role, text)], [*atts, *mine], n + sum(t for *_, t in mine)
    for r in read_back(format_chat(df)).collect():
        said, atts, n = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == said and r.expanded_tokens == n
        assert [(a.turn_no, a.kind, a.ref, a.tokens) for a in r.attachments] == atts and [(p.turn_no, p.kind) for p in r.placeholders] == [a[:2] for a in atts]


def test_no_chats(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_chat(empty.withColumn("parts", text_part(F.col("text"))))).count() == 0


def test_hash_of_a_chat(spark):
    turns = spark.createDataFrame(TURNS[:2], "conv_id long, turn long, role string, text string")
    r = read_back(format_chat(turns.withColumn("parts", text_part(F.col("text"))))).first()
    said = "".join(f"{t.role}\n{t.text}\n" for t in r.turns)
    assert hashlib.sha256(said.encode()).hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in TURNS[:2]).encode()).hexdigest()
