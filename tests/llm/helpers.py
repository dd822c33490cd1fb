"""Documents with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def odd_documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([3, 60, 120])), "en", f"src{i % 3}", 0) for i in range(n)]
    long = prose(rng, 6000)
    near = prose(rng, 100).split()
    for i in range(12):
        words = list(near)
        words[i * 7 % 100] = f"edit{i}"
        rows.append((100 + i, " ".join(words), "de", "src0", 0))
    passage = prose(rng, 60)
    for i in range(5):
        rows.append((200 + i, f"{prose(rng, 40)} {passage} {prose(rng, 40)}", "fr", None, 0))
    rows += [(300, None, "en", "src0", None), (301, "", None, "src0", 0), (302, " \n\t ", "en", None, 0), (303, long, "en", "src0", 0), (304, long, "en", "src1", 0), (None, prose(rng, 80), "en", "src0", 0)]
    rows += [(305, "one two", "en", "src0", 0), (306, "ONE two", "en", "src0", 0), (307, "é☃▁x\0y" * 90, "en", "src0", 0)]
    rows += [rows[0], rows[0], (1, rows[2][1], "en", "src0", 0)]
    return rows


def documents(spark, rows=None):
    """The rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("size", "shard", "k", "n", "rep", "score", "kept", "spans", "entities", "slot", "n_removed", "length", "row", "d", "t")})
