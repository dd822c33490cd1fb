"""The exact fuzzy join against all pairs."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from captionlake.operators.fuzzy import common_length, fuzzy_matches, least_shared, marked, prefix_length


def brute(queries, memory, least, k):
    rows, seen = set(), {}
    for q, a in queries:
        hits = []
        for m, b in memory:
            if a and b and a != b and 2 * min(len(a), len(b)) >= least * (len(a) + len(b)):
                if (a, b) not in seen:
                    seen[a, b] = SequenceMatcher(None, a, b, autojunk=False).ratio()
                if seen[a, b] >= least and seen[a, b] < 1:
                    hits.append((-seen[a, b], m))
        rows |= {(q, i, m, -r) for i, (r, m) in enumerate(sorted(hits)[:k], 1)}
    return rows


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text) + 1)
        text = rng.choice([text[:i] + rng.choice("abc é天") + text[i:], text[:i] + text[i + 1 :], text[:i] + "x" + text[i + 1 :]])
    return text


@pytest.mark.parametrize("least", [0.8, 0.86, 0.95])
def test_no_match_is_lost(spark, least):
    rng = random.Random(2)
    base = ["".join(rng.choices("abcdefg é天", k=rng.choice([1, 2, 3, 4, 5, 9, 17, 33, 70, 400]))) for _ in range(40)]
    memory = [(i, t) for i, t in enumerate([*base, *base[:9], *(edited(rng, t, rng.randint(1, 6)) for t in base for _ in range(4)), None, "", "a" * 700, "a" * 690])]
    queries = [(100 + i, edited(rng, t, rng.randint(0, 5))) for i, t in enumerate(base)] + [(900, None), (901, ""), (902, "abcd"), (903, "abxcd"), (904, memory[0][1]), (905, memory[0][1])]
    memory.append((5000, "abcd"))
    got = fuzzy_matches(spark.createDataFrame(queries, "q long, t string"), spark.createDataFrame(memory, "m long, t string"), "q", "m", "t", least, 3).collect()
    assert {(r.q, r["rank"], r.m, r.ratio) for r in got} == brute(queries, memory, least, 3) and len(got) > 20


def test_recall_on_part_names(spark):
    p = [(r.p_partkey, r.p_name) for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_partkey", "p_name").collect()]
    df = spark.createDataFrame(p, "k long, t string")
    got = {(r.q, r["rank"], r.m, r.ratio) for r in fuzzy_matches(df.withColumnRenamed("k", "q"), df.withColumnRenamed("k", "m"), "q", "m", "t").collect()}
    by = defaultdict(list)  # all pairs whose letters allow the ratio
    for k, t in p:
        by[len(t)].append((k, t))
    rng = random.Random(3)
    some = rng.sample(p, 60)
    assert {x for x in got if x[0] in dict(some)} == brute(some, p, 0.86, 3)


def test_bounds_hold():
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choices("abc", k=rng.randint(1, 25)))
        b = edited(rng, a, rng.randint(0, 4))
        r = SequenceMatcher(None, a, b, autojunk=False).ratio()
        if b and 0.8 <= r < 1:
            left = marked(b)
            shared = sum(1 for g in marked(a) if g in left and not left.remove(g))
            assert shared >= least_shared(len(a) + len(b), 0.8) and 2 * common_length(a, b) >= r * (len(a) + len(b)) - 1e-9
            assert prefix_length(len(a), 0.8) >= len(a) + 2 - least_shared(len(a) + len(b), 0.8) + 1
    assert common_length("kitten", "sitting") == 4


def test_low_ratios_are_refused(spark):
    with pytest.raises(ValueError):
        fuzzy_matches(spark.createDataFrame([(1, "a")], "q long, t string"), spark.createDataFrame([(1, "a")], "m long, t string"), "q", "m", "t", 0.5)
