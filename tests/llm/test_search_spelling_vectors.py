"""Ranked search, spelling variants and the projection forest against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from captionlake.llm.forest import near_vectors, trees_needed
from captionlake.llm.spelling import neighbours, observed_words, spelling_variants, word_hashes
from captionlake.llm.wand import cut_blocks, lexical_index, ranked_search, terms

from .helpers import documents, odd_documents

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute_search(docs, items, k):
    found = [(d, Counter(w), len(w)) for d, t in docs if (w := brute_terms(t))]
    n_docs, n_words = len(found), sum(n for *_, n in found)
    df = Counter(w for _, tf, _ in found for w in tf)
    out = []
    for item, text in items:
        scores = []
        for d, tf, n in found:
            m = 100 - 75 + (75 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 8 * m)) for w in brute_terms(text) if w in tf)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_terms_are_those_of_the_pattern():
    for t in (None, "", " ", "A_b-C9", "É☃x\0y Ünï 10%", "a b", "1.5e3\x7f~z"):
        assert [w.decode() for w in terms(t)] == brute_terms(t)


@pytest.mark.parametrize(("shard_docs", "wave_words"), [(7, 30), (4096, 1 << 20)])
def test_ranked_search_matches_brute_force(spark, shard_docs, wave_words):
    rows = odd_documents(3, 150)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices((rng.choice(rows)[1] or "x").split() or ["x"], k=rng.randint(1, 30)))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "nowhere_at_all"), (33, "a a a A b"), (34, rows[5][1]), (None, "a"), (35, "one"), (35, "two")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    got = ranked_search(documents(spark, rows), frame, k=5, shard_docs=shard_docs, wave_words=wave_words).collect()
    want = brute_search([(r[0], r[1]) for r in rows], [x for x in items if x[0] is not None and x[1] is not None and x != (35, "two")], 5)
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == Counter(want)


def test_a_stored_index_is_searched_and_empty_tables_give_nothing(spark):
    docs, items = documents(spark), spark.createDataFrame([(1, "edit3 edit4")], "item_id long, text string")
    stored = lexical_index(docs, shard_docs=16)
    assert ranked_search(docs, items, index=stored).collect() == ranked_search(docs, items).collect() != []
    assert ranked_search(docs.limit(0), items).count() == ranked_search(docs, items.limit(0)).count() == 0


def test_blocks_are_the_best_cut():
    rng = np.random.default_rng(5)
    lists = [rng.integers(1, 1000, n) for n in (1, 2, 5, 40, 90)]

    def loss(s, ends, fee):
        return sum(s[a:b].max() * (b - a) + fee for a, b in zip([0, *ends], ends, strict=False))

    for s, ends in zip(lists, cut_blocks(lists, most=16, price=3), strict=True):
        fee, best = 3 * s.mean(), [0.0]
        for i in range(1, len(s) + 1):
            best.append(min(best[j] + s[j:i].max() * (i - j) + fee for j in range(max(0, i - 16), i)))
        assert ends[-1] == len(s) and np.diff([0, *ends]).max() <= 16 and abs(loss(s, list(ends), fee) - best[-1]) < 1e-6


def brute_words(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(AZ)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    rows, form = {}, {}
    for w in n:
        near = [x for x in n if abs(len(x) - len(w)) <= 1 and one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        rows[w] = (form[w], len(near))
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, rows[w][0], root, n[w], rows[w][1], n[form[w]] if form[w] is not None else None))
    return out


def test_words_of_texts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["Straße", "strasse", "Élan", "élan", "aaaaa", "naïve", "x×y÷z", "abcdef", "ABCDEF"], k=200)), "en", "s", 0) for i in range(40)]
    rows += [(None, "abcdef abcdeg abcdeg", "en", "s", 0), (50, None, "en", "s", 0), (51, "", "en", "s", 0), (52, "abcdeh " * 5000, "en", "s", 0), rows[0], rows[0]]
    got = {r.word: r.n for r in observed_words(documents(spark, rows)).collect()}
    assert got == brute_words([(r[0], r[1]) for r in rows]) and len(got) >= 8


@pytest.mark.parametrize("wave_words", [1 << 24, 60])
def test_spelling_variants_match_brute_force(spark, wave_words):
    rng = random.Random(7)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 5))): rng.choice([1, 2, 3, 4, 8, 9, 40]) for _ in range(250)} | {"": 5, "x" * 300: 2, "x" * 299: 9, "a😀b": 2, "a😁b": 7}
    rows = [*words.items(), (None, 3), ("void", None), ("twice", 2), ("twice", 3)]
    words["twice"] = 5
    df = spark.createDataFrame(rows, "word string, n long").withColumn("near", F.lit(0))
    got = spelling_variants(df, wave_words=wave_words).collect()
    assert Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == Counter(brute_variants(words))
    assert spelling_variants(df.limit(0)).count() == 0


def test_a_neighbourhood_has_each_string_once():
    alphabet = np.array([ord(c) for c in "abc"], "int64")
    for w in ("", "a", "aab", "abca"):
        got = [s for _, s in neighbours([w], alphabet, lambda h: np.ones(h.shape, bool))]
        want = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abc"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abc"}
        assert sorted(got) == sorted(want - {w})
        hashes = []
        list(neighbours([w], alphabet, lambda h: (hashes.append(h.ravel()), np.zeros(h.shape, bool))[1]))
        every = set(np.concatenate(hashes).tolist())
        assert all(int(word_hashes([s])[0]) in every for s in want - {w} if s)


def brute_links(rows, least=0.9):
    ok = [(k, np.array(v, "float64") / max(map(abs, v))) for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = defaultdict(set), {k: k for k, _ in rows if k is not None}
    for i, (a, x) in enumerate(ok):
        for b, y in ok[:i]:
            if a != b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[a].add(b)
                links[b].add(a)
    moved = True
    while moved:
        moved = False
        for a, others in links.items():
            low = min([up[a], *(up[b] for b in others)])
            for x in (a, *others):
                if up[x] != low:
                    up[x], moved = low, True
    return Counter((k, len(links[k]), up.get(k), k is None or up[k] == k) for k, _ in rows)


def odd_vectors(seed=8, dim=16):
    rng = random.Random(seed)
    near = lambda v, e: [x + rng.gauss(0, e) for x in v]
    one = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(200)]
    rows += [near(one[0], 0.05) for _ in range(150)] + [near(one[1], 0.3) for _ in range(90)] + [near(v, 0.1) for v in one for _ in range(3)]
    rows += [one[2]] * 40 + [[2 * x for x in one[2]]] * 3 + [[1e-200 * x for x in one[3]], [1e200 * x for x in one[3]]]
    rows += [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [1.0, 2.0], [1.0, 2.1], [-0.0, 1.0], [0.0, 1.0]]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True)) + [(None, one[2])]


@pytest.mark.parametrize(("leaf", "block"), [(2048, 2048), (40, 30)])
def test_forest_matches_brute_force(spark, leaf, block):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("node", "data", "fp", "component", "k", "n")})
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df, leaf=leaf, sample=400, block=block).collect())
    assert got == brute_links(rows)


def test_forest_of_few_vectors(spark):
    df = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>")
    assert near_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in near_vectors(df.filter("embedding IS NULL")).collect()] == [(r.vec_id, 0, r.vec_id, True) for r in df.filter("embedding IS NULL").collect()]
    one = df.filter("size(embedding) = 16").limit(1).collect()[0]
    twice = spark.createDataFrame([one, one], df.schema)
    assert [tuple(r) for r in near_vectors(twice).collect()] == [(one.vec_id, 0, one.vec_id, True)] * 2


def test_forest_finds_pairs_that_are_just_similar_enough(spark):
    """Pairs of cosine 0.9 to 0.91 that alone connect their ends: the recall that the number of trees is chosen for."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        v, w = rng.standard_normal((2, 32))
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        c = rng.uniform(0.9, 0.91)
        rows += [(2 * i, v.tolist()), (2 * i + 1, (c * v + math.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist())]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=100, sample=1000)
    linked = got.filter("n_links > 0").count()
    assert linked >= 0.97 * 3000 and trees_needed(3000, 0.9, 100) > trees_needed(300, 0.9, 100) >= 4
