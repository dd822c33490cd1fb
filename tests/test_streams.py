"""Streams against batch folds, over splits into micro-batches; timers and restarts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from captionlake.operators import folds
from captionlake.streaming.run import run_now
from captionlake.streaming.state import folded, gate_states, gated, resequenced

LINES = "key long, at long, seq long, id long, text string, stale boolean"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, k long"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_of(spark, rows, schema, path, batches):
    """The rows in as many files, one for each micro-batch, in order."""
    step = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def lines(n=300, seed=1):
    rng = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at += rng.choice([0, 1, 5, 40])
        out.append((rng.randrange(4), at, at // 20, i, rng.choice(["a", "b", "c d", ""]), rng.random() < 0.4))
    return out


RULES = {
    "throttle": folds.throttling(30), "mute": folds.muting(60), "admit": folds.admitting(50, 2), "trigger": folds.triggering(60, 300, 100, 2000, 6, 3), "carry": (["at", "id"], *folds.carrying()[1:]),
}


@pytest.mark.parametrize("name", list(RULES))
def test_a_stream_equals_the_fold_for_any_batches(spark, tmp_path, name):
    rows, rule = lines(), RULES[name]
    want = Counter(map(str, folds.ordered_fold(spark.createDataFrame(rows, LINES), ["key"], *rule).collect()))
    assert len(want) > 5
    stream = stream_of(spark, rows, LINES, str(tmp_path / "s"), 3)
    assert Counter(map(str, run_now(folded(stream, rule)).drop("batch").collect())) == want


def brute_sequence(rows, wait, cap, watermark):
    out, state = [], {}
    for e, ts, user, _, k in sorted(rows, key=lambda r: (r[1], r[0])):
        s, now = state.setdefault(user, {"next": 0, "held": {}, "due": 0}), ts
        while s["due"] and s["due"] <= now:
            settle(s, user, out, wait, cap, True, None)
        if k < s["next"]:
            out.append((user, k, e, "retry"))
        else:
            s["held"][k] = e
            settle(s, user, out, wait, cap, False, now)
    for user, s in state.items():
        while s["due"] and s["due"] <= watermark:
            settle(s, user, out, wait, cap, True, None)
    return Counter(out)


def settle(s, user, out, wait, cap, give_up, now):
    first = s["next"]
    while s["held"]:
        if s["next"] in s["held"]:
            out.append((user, s["next"], s["held"].pop(s["next"]), "released"))
            give_up = False
        elif give_up or len(s["held"]) > cap:
            out.append((user, s["next"], None, "missing"))
        else:
            break
        s["next"] += 1
    s["due"] = 0 if not s["held"] else s["due"] if s["due"] and first == s["next"] else (s["due"] if now is None else now) + wait


def test_holes_time_out_by_event_time(spark, tmp_path):
    from datetime import datetime, timedelta

    rng, rows = random.Random(2), []
    for i in range(240):
        user = i % 3
        k = i // 3 + rng.choice([0, 0, 0, 1, 2, -1, 6])
        if k >= 0 and rng.random() > 0.2:
            rows.append((i, i * 400, user, "x", k))
    rows.append((900, 240 * 400 + 60_000, 7, "x", 0))  # moves the watermark on
    begin = datetime(2024, 1, 1)
    frame = [(e, begin + timedelta(milliseconds=ts), u, t, k) for e, ts, u, t, k in rows]
    stream = stream_of(spark, frame, EVENTS, str(tmp_path / "s"), 3).withWatermark("ts", "1 second")
    got = Counter((r.user_id, r.k, r.event_id, r.status) for r in run_now(resequenced(stream, 4000, 3)).collect())
    want = brute_sequence(rows, 4000, 3, 240 * 400 + 59_000)
    assert got == want and {s for *_, s in want} == {"released", "missing", "retry"}


def gate_rows():
    from datetime import datetime, timedelta

    rng = random.Random(3)
    return [(i, datetime(2024, 1, 1) + timedelta(seconds=i), rng.randrange(5), rng.choice(["view", "view", "view", "error"]) if i % 9 == 0 else "view", rng.randrange(40)) for i in range(200)]


def test_a_stream_goes_on_from_a_table_of_states(spark, tmp_path):
    rows = gate_rows()
    whole = {(r.user_id, r.event_id, r.version, r.cursor) for r in run_now(gated(stream_of(spark, rows, EVENTS, str(tmp_path / "all"), 2))).collect()}
    first = run_now(gated(stream_of(spark, rows[:110], EVENTS, str(tmp_path / "one"), 2))).drop("batch")
    typed = first.join(spark.createDataFrame(rows, EVENTS).select("event_id", "event_type"), "event_id")
    rest = run_now(gated(stream_of(spark, rows[110:], EVENTS, str(tmp_path / "two"), 2), gate_states(typed)))
    assert {(r.user_id, r.event_id, r.version, r.cursor) for r in first.unionByName(rest.drop("batch")).collect()} == whole and len(whole) > 15


def test_a_stream_goes_on_from_the_state_of_a_stopped_one(spark, tmp_path):
    """States are read from the stopped stream's checkpoint by the state data source."""
    rows = gate_rows()
    whole = {(r.user_id, r.event_id) for r in run_now(gated(stream_of(spark, rows, EVENTS, str(tmp_path / "all"), 1))).collect()}
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    q = gated(stream_of(spark, rows[:90], EVENTS, str(tmp_path / "one"), 2)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    states = spark.read.format("statestore").option("stateVarName", "gate").load(checkpoint).select("key.user_id", "value.*")
    rest = run_now(gated(stream_of(spark, rows[90:], EVENTS, str(tmp_path / "two"), 1), states))
    got = {(r.user_id, r.event_id) for r in spark.read.parquet(out).collect()} | {(r.user_id, r.event_id) for r in rest.collect()}
    assert got == whole


def test_held_numbers_go_on_too(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), 1, "x", k) for i, k in enumerate([1, 2])]
    initial = spark.createDataFrame([(1, 0, 4, 77), (1, 0, 3, 76), (2, 5, None, None)], "user_id long, next long, k long, event_id long")
    more = [*rows, (9, datetime(2024, 1, 2), 1, "x", 0), (10, datetime(2024, 1, 2), 2, "x", 5), (11, datetime(2024, 1, 2), 2, "x", 2)]
    got = run_now(resequenced(stream_of(spark, more, EVENTS, str(tmp_path / "s"), 1), None, 100, initial)).collect()
    assert {(r.user_id, r.k, r.event_id, r.status) for r in got} == {(1, 0, 9, "released"), (1, 1, 0, "released"), (1, 2, 1, "released"), (1, 3, 76, "released"), (1, 4, 77, "released"), (2, 5, 10, "released"), (2, 2, 11, "retry")}


def test_metered_sessions_as_a_stream(spark, tmp_path):
    from .test_folds import METRICS, brute_sessions, metric_rows

    rows = metric_rows()
    want = Counter(r for r in brute_sessions(rows, 4, 3) if r[3] != "live")
    stream = stream_of(spark, rows, METRICS, str(tmp_path / "s"), 3)
    assert Counter(tuple(r) for r in run_now(folded(stream, folds.metering(4, 3))).drop("batch").collect()) == want and len(want) > 20


@pytest.fixture
def plain_batches(spark):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.mark.parametrize("ttl", [None, 1500])
def test_states_live_as_long_as_they_are_told(spark, tmp_path, ttl, plain_batches):
    import time
    from datetime import datetime

    out, checkpoint, path = (str(tmp_path / x) for x in ("out", "checkpoint", "in"))
    for i, version in enumerate([5, 3]):
        stream = stream_of(spark, [(i, datetime(2024, 1, 1), 1, "view", version)], EVENTS, path, 1)
        gated(stream, ttl_ms=ttl).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        time.sleep(2.5)
    got = {(r.event_id, r.version, r.cursor) for r in spark.read.parquet(out).collect()}
    assert got == ({(0, 5, 1)} if ttl is None else {(0, 5, 1), (1, 3, 1)})
