"""Folds and text rules against brute force."""

import random
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from captionlake.functions import sequences as Q
from captionlake.functions import text as X
from captionlake.operators import folds

DAY = 86_400


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_lines_are_carried_within_their_limits(spark):
    rows = [(1, 1, 11, "one", True), (1, 2, 12, "two.", True), (1, 3, 13, "three", True), (1, 4, 14, "four", False), (1, 5, 15, "five", True), (1, 6, 16, "six", False), (1, 7, 17, "x" * 60, True), (1, 8, 18, "y" * 30, True), (1, 9, 19, "nine", False), (2, 1, 21, "a", True), (2, 4, 22, "b", False), (None, 1, 31, "n", False)]
    df = spark.createDataFrame(rows, "key long, seq long, id long, text string, stale boolean")
    assert rows_of(folds.carry_lines(df), "key", "id", "text", "carried") == sorted([
        (1, 14, "one，two.four", [11, 12]), (1, 16, "five，six", [15]), (1, 19, "x" * 60 + "，nine", [17]), (2, 22, "b", []), (None, 31, "n", []),
    ], key=repr)


def test_trigger_over_midnight(spark):
    at = DAY - 1000
    rows = [(1, at, 1, "a"), (1, at + 3600, 2, "b"), (1, at + 4000, 3, "c"), (1, at + 8000, 4, "d"), (1, at + 11000, 5, "e"), (1, at + 40_000, 6, "a"), (1, at + 43_600, 7, "b"), (2, at, 8, "z")]
    got = folds.windowed_trigger(spark.createDataFrame(rows, "key long, at long, id long, text string"), 3600, 6 * 3600, 2 * 3600, DAY)
    # 2 fires; 3 and 4 span an hour but cool down until 5; 7 has the texts of 2
    assert rows_of(got, "key", "id", "n") == [(1, 2, 2), (1, 5, 3)]


def test_repeats_and_throttle_over_midnight(spark):
    at = DAY - 10
    rows = [(1, at, 1, "a"), (1, at + 20, 2, "a"), (1, at + 31, 3, "a"), (1, at + 32, 4, "b"), (1, at + 33, 5, "a"), (1, at + 70, 6, "a")]
    df = spark.createDataFrame(rows, "key long, at long, id long, text string")
    assert [i for _, i in rows_of(folds.mute_repeats(df, 30), "key", "id")] == [1, 3, 4, 5, 6]
    assert [i for _, i in rows_of(folds.throttle(df, 30), "key", "id")] == [1, 4, 6]


def test_queue_and_admission_match_brute_force(spark):
    rng = random.Random(5)
    rows = sorted((key, rng.randrange(1000), i, rng.randrange(1, 60)) for i, key in enumerate(rng.choices(range(4), k=200)))
    per = defaultdict(list)
    for key, due, i, cost in rows:
        per[key].append((due, i, cost))
    want = []
    for key, jobs in per.items():
        free, ends, lags, most = [0, 0], [], [], 0
        for due, _, cost in jobs:
            w = free.index(min(free))
            free[w] = max(free[w], due) + cost
            ends.append(free[w])
            lags.append(free[w] - due)
            most = max(most, sum(e > due for e in ends))
        want.append((key, len(jobs), max(ends), lags[-1], max(lags), most))
    df = spark.createDataFrame(rows, "key long, due long, id long, cost long")
    assert rows_of(folds.queue(df, 2), "key", "jobs", "done", "lag", "max_lag", "max_backlog") == sorted(want, key=repr)
    admitted, want = defaultdict(list), []
    for key, due, i, _ in rows:
        ok = sum(due - t < 60 for t in admitted[key]) < 3
        admitted[key] += [due] * ok
        want.append((key, i, ok))
    assert rows_of(folds.admit(df.withColumnRenamed("due", "at").drop("cost"), 60, 3), "key", "id", "admitted") == sorted(want, key=repr)


def test_loops_are_found_anywhere(spark):
    texts = ["", "aaaaaa", "aaaaa", "ab ab ab", "abc" * 2 + "xyz" * 9, "ababab" + "q" * 3 + "the quick brown fox jumps", "x\ny" * 5, "hahaha!" + "well then this goes on", None]

    def brute(t):
        t = re.sub(r"\s", "", t or "")
        return any(len(m[0]) >= max(6, 0.4 * len(t)) for n in range(1, 13) for m in re.finditer(rf"(?s)(.{{{n}}})\1{{2,}}", t))

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", Q.has_loop(F.col("text")).alias("loop"))
    assert [r.loop for r in df.orderBy("id").collect()] == [brute(t) for t in texts]


def test_redaction_matches_brute_force(spark):
    texts = [
        "see https://a.b/c?token=1 and http://x.y/z, mail a.b@c.org or ａ＠ｂ．ｃｏｍ", "ID A123456789 and A1234567890; call 0912-345-678, 02-2345-6789 or +1 (415) 555-0100", "short 050-12 +1 22 33 44 stays", "Anna Lee met Ann", "", None,
        "090-1234-5678 0800 1234567", "no hits ｆｕｌｌ　ｗｉｄｔｈ",
    ]

    def brute(t):
        s = unicodedata.normalize("NFKC", t)
        counts = {}
        for name, pattern, keep in (("url", X.URL, lambda m: re.search(X.URL_SECRET, m)), ("email", X.EMAIL, None), ("id", X.TW_ID, None), ("phone", X.PHONE, lambda m: sum(c.isdigit() for c in m) >= 8), ("name", "Anna", None)):
            counts[name] = 0

            def one(m):
                if keep is not None and not keep(m[0]):  # noqa: B023
                    return m[0]
                counts[name] += 1  # noqa: B023
                return f"[{name.upper()}]"  # noqa: B023

            s = re.sub(pattern, one, s)
        return (s if sum(counts.values()) else t, *counts.values())

    text, counts = X.redact(F.col("text"), names=["Anna", "A"])
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", text.alias("t"), *[c.alias(k) for k, c in counts.items()]).orderBy("id").collect()
    for t, r in zip(texts, got, strict=True):
        if t is not None:
            assert (r.t, r.url, r.email, r.id, r.phone, r.name) == brute(t) or tuple(r)[1:] == brute(t), t
    assert got[5].t is None


def test_stems_of_the_published_examples():
    from captionlake.functions.stems import porter

    want = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit conformabli conform vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll studies studi study studi running run".split()
    assert {w: porter(w) for w in want[::2]} == dict(zip(want[::2], want[1::2]))


def test_containment_in_waves_finds_the_same(spark):
    from captionlake.operators.joins import containment

    rng = random.Random(8)
    texts = spark.createDataFrame([(i, "".join(rng.choices("abc", k=rng.randint(0, 30)))) for i in range(60)] + [(60, None)], "id int, text string")
    terms = spark.createDataFrame([("".join(rng.choices("abc", k=rng.randint(1, 10))),) for _ in range(60)] + [("",), (None,)], "term string").distinct()
    want = sorted((r.id, t.term) for r in texts.collect() for t in terms.collect() if r.text and t.term and t.term in r.text)
    for most in (1 << 20, 40):
        assert [tuple(r) for r in rows_of(containment(texts, terms, "text", "term", most).select("id", "term"), "id", "term")] == sorted(want, key=repr)


def test_dictionary_keys(spark):
    from captionlake.functions import dictionary as D

    df = spark.createDataFrame([("Bank", None, ["a river bank/the shore", "x" * 161], ["banks", " Banked "], "The bank's 因緣生 is, ok")], "word string, alt string, glosses array<string>, forms array<string>, s string")
    r = df.select(D.entry_keys(F.col("word"), F.col("alt"), F.col("glosses"), F.col("forms")).alias("e"), D.query_keys(F.col("s")).alias("q")).first()
    assert r.e == ["bank", "a river bank", "river", "the shore", "shore", "banks", "banked"]
    assert r.q == ["the", "bank's", "is", "ok", "因緣生", "因緣", "緣生", "因", "緣", "生"]


def test_nearest_vectors_in_waves(spark):
    from captionlake.operators.vectors import cosine_top_k

    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)] + [(100, [0.0] * 4), (120, None), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    valid = [(i, v) for i, v in rows if i is not None and v is not None]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)), 9) if norm(a) * norm(b) else 0.0
    want = [(q, i, n) for q, a in valid if q % 20 == 0 for n, (_, i) in enumerate(sorted((-cos(a, b), i) for i, b in valid if i != q)[:3], 1)]
    assert rows_of(cosine_top_k(df, lambda i: i % 20 == 0, 3, block=2, wave_bytes=1), "query_id", "vec_id", "rank") == sorted(want, key=repr)


def brute_utterances(levels, g, floor=0.008, ratio=3.0):
    """Over the whole list of frames, with the noise floor of each moment."""
    noise, floors = floor, []
    for x in levels:
        floors.append(max(floor, noise * ratio))  # by which this frame is judged
        if x < noise:
            noise = max(0.7 * noise + 0.3 * x, 1e-4)
        elif x < floors[-1]:
            noise = max(0.995 * noise + 0.005 * x, 1e-4)
    after = [*floors[1:], max(floor, noise * ratio)]  # what holds once a frame has been heard
    out, base, spoken, carried = [], 0, [], False

    def emit(end, reason, i):
        nonlocal base, spoken, carried
        out.append((max(base, spoken[0] - g["before"]), min(i + 1, end + (0 if reason == "hard" else g["behind"])), reason))
        base, carried = end, reason in ("soft", "hard")
        spoken = [j for j in range(end, i + 1) if levels[j] >= after[i]]

    for i, x in enumerate(levels):
        if x >= floors[i]:
            spoken.append(i)
        if not spoken:
            base = max(base, i + 1 - g["before"])
            continue
        voiced, quiet, n = spoken[-1] + 1 - spoken[0], i - spoken[-1], i + 1 - spoken[0]
        if (quiet >= g["silence"] and voiced >= (g["lone"] if carried else g["least"])) or (quiet >= g["lone_silence"] and voiced >= g["lone"]):
            emit(spoken[-1] + 1, "pause", i)
        elif quiet >= g["lone_silence"]:
            spoken, carried = [], False
            base = max(base, i + 1 - g["before"])
        elif n >= g["soft"] and quiet >= g["soft_silence"]:
            emit(spoken[-1] + 1, "soft", i)
        elif n >= g["hard"]:
            late = list(range(max(spoken[0] + g["least"], i + 1 - g["back"]), i + 1))
            emit(min(late, key=lambda j: (levels[j], -j)) + 1, "hard", i)
    if spoken:
        emit(spoken[-1] + 1, "flush", len(levels) - 1)
    return out


def test_utterances_end_by_pauses_and_cuts(spark):
    rng, rows, want, reasons = random.Random(12), [], set(), set()
    limits = folds.ENDPOINTS | {"soft": 25, "hard": 40, "back": 10}
    for key in range(12):
        levels, speaking = [], False
        while len(levels) < 700:
            speaking = not speaking
            n = rng.choice([2, 5, 20, 90] if speaking else [1, 3, 7, 15, 40])
            levels += [rng.uniform(0.03, 0.5) if speaking and rng.random() > 0.05 * (key % 4) else rng.choice([0.0, 0.001, 0.002, 0.007]) for _ in range(n)]
        rows += [(key, i, i, x) for i, x in enumerate(levels)]
        found = brute_utterances(levels, limits)
        want |= {(key, *x) for x in found}
        reasons |= {x[-1] for x in found}
    got = folds.utterances(spark.createDataFrame(rows, "key long, at long, id long, level double"), limits).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and reasons >= {"pause", "soft", "hard"}


def test_a_client_shows_what_its_events_leave(spark):
    rows = [
        ("caption", 1, 5, 1, 0, 1, "one"), ("draft", 1, 5, 0, 0, 0, "no: a caption stands"), ("caption", 1, 5, 1, 0, 1, "no: the same version"), ("caption", 1, 5, 2, 0, 1, "one, corrected"),
        ("draft", 2, 1, 0, 0, 0, "draft after finals, by their ord"), ("caption", None, 1, 1, 0, 0, "no id"), ("caption", 3, None, 1, 0, 0, "no seq"), ("deleted", 4, None, 0, 0, 0, None), ("caption", 4, 9, 9, 0, 0, "no: deleted"),
        ("caption", 5, 4, 1, 0, 1, "five"), ("expired", 5, None, 0, 0, 0, None), ("caption", 5, 6, 1, 0, 1, "five again"),
    ]
    schema = "key long, at long, id long, kind string, caption long, seq long, version long, epoch long, ord long, text string"
    frame = lambda rows: spark.createDataFrame([(7, i, i, *r) for i, r in enumerate(rows)], schema)
    shown = lambda rows, most=80: [(r.caption, r.text, r.draft) for r in folds.client_view(frame(rows), most).orderBy("place").collect()]
    assert shown(rows) == [(2, "draft after finals, by their ord", True), (1, "one, corrected", False), (5, "five again", False)]
    assert shown([*rows, ("caption", 2, 8, 1, 0, 1, "two")]) == [(1, "one, corrected", False), (5, "five again", False), (2, "two", False)]
    late = [*rows, ("cleared", None, None, 0, 3, 0, None), ("caption", 8, 1, 1, 2, 0, "no: an old epoch"), ("caption", 1, 1, 9, 3, 0, "no: cleared"), ("caption", 9, 1, 1, 3, 0, "nine")]
    assert shown(late) == [(9, "nine", False)]
    many = [("caption", i, i, 1, 0, 0, str(i)) for i in range(10)] + [("caption", 7, 70, 2, 0, 0, "7 stays in its place of arrival"), ("caption", 20, 0, 1, 0, 0, "20")]
    assert [x[0] for x in shown(many, 4)] == [20, 8, 9, 7]


def metric_rows():
    rng = random.Random(8)
    out, at = [], 0
    for i in range(600):
        at += rng.randrange(3)
        room = min(int(rng.expovariate(0.4)), 9)
        out.append((rng.randrange(2), at, i, room, at // (40 + room), rng.choice(["sample", "sample", "timeout", "silent", "empty", "error"]), rng.randrange(100)))
    return out


METRICS = "key long, at long, id long, room long, session long, kind string, amount long"


def brute_sessions(rows, most, last):
    """Lives of sessions, told by who was touched between two touches of a room."""
    out = []
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        for room in {r[3] for r in mine}:
            at = [i for i, r in enumerate(mine) if r[3] == room]
            life = []
            for i, after in zip(at, [*at[1:], None], strict=True):
                life.append(mine[i])
                others = {r[3] for r in mine[i + 1 : after]} - {room}
                ended = "evicted" if len(others) >= most else "live" if after is None else "replaced" if mine[after][4] != mine[i][4] else None
                if ended:
                    kept = [r[6] for r in life if r[5] == "sample"][-last:]
                    out.append((key, room, mine[i][4], ended, len(kept), sum(kept), max(kept, default=None), *[sum(r[5] == k for r in life) for k in ("timeout", "silent", "empty", "error")]))
                    life = []
    return sorted(out, key=repr)


def test_sessions_are_metered_within_bounds(spark):
    rows = metric_rows()
    df = spark.createDataFrame([*rows, (0, 5, 9000, None, 1, "sample", 1), (0, 5, 9001, 1, None, "error", 1), (0, 5, 9002, 77, 1, "sample", None)], METRICS)
    for most, last in ((3, 2), (6, 4096), (32, 1)):
        got = sorted((tuple(r) for r in folds.metered(df, most, last).collect()), key=repr)
        assert got == brute_sessions(rows, most, last)
    assert {r[3] for r in brute_sessions(rows, 6, 9)} == {"evicted", "live", "replaced"}
    assert folds.metered(df.limit(0)).count() == 0
