"""Folds over each key's rows in order, for rules whose next step hangs on the last decision."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable, step: Callable, end: Callable | None = None) -> DataFrame:
    """step(state, row) -> rows of output, over each key's rows in ``order``; start() is a key's first state, end(state, key) gives last rows.

    Keys are dealt and sorted by Spark; rows stream through a task, which holds a batch and one state, so neither a
    long nor a hot key is gathered, and no period cuts a key. States must be bounded by their rules. Nulls are a key.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, begun = None, None, False
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                k = tuple(None if pd.isna(x) else x for x in (getattr(r, c) for c in keys))
                if not begun or k != key:
                    if begun and end:
                        out += end(state, key)
                    key, state, begun = k, start(), True
                out += step(state, r)
            if out:
                yield pd.DataFrame(out, columns=names)
        if begun and end and (out := end(state, key)):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


#: Marks after which two lines are joined as they are; others are joined by a comma.
PAUSES, COMMA = "，。！？；、,.!?;", "，"


#: A fold as what ordered_fold() and streams take: order, schema, start, step.
Fold = tuple[list[str], str, Callable, Callable]


def carry_lines(df: DataFrame, most: int = 2, chars: int = 80, reach: int = 2) -> DataFrame:
    """carrying() over a table."""
    return ordered_fold(df, ["key"], *carrying(most, chars, reach))


def carrying(most: int = 2, chars: int = 80, reach: int = 2) -> Fold:
    """Stale lines (key, seq, id, text, stale) ride along with the next line of their key: ``most`` of them, ``chars`` characters in all, and no more than ``reach`` numbers ahead. Others are skipped. Returns key, id, text, carried."""

    def join(a: str, b: str) -> str:
        return f"{a}{b}" if not a or a.endswith(tuple(PAUSES)) else f"{a}{COMMA}{b}"

    def step(state: dict, r) -> list:
        held = state.get("held")
        near = held is not None and held["seq"] < r.seq <= held["seq"] + reach
        if r.stale:
            if not near:
                state["held"] = {"seq": r.seq, "text": r.text, "ids": [r.id]}
            elif len(held["ids"]) < most and len(join(held["text"], r.text)) <= chars:
                state["held"] = {"seq": r.seq, "text": join(held["text"], r.text), "ids": [*held["ids"], r.id]}
            return []
        if held is not None and held["seq"] < r.seq:
            del state["held"]
        return [(r.key, r.id, join(held["text"], r.text), held["ids"])] if near and held["text"] else [(r.key, r.id, r.text, [])]

    return ["seq", "id"], "key long, id long, text string, carried array<long>", dict, step


def windowed_trigger(df: DataFrame, least: int, longest: int, cool_down: int, memory: int, lines: int = 24) -> DataFrame:
    """triggering() over a table."""
    return ordered_fold(df, ["key"], *triggering(least, longest, cool_down, memory, lines))


def triggering(least: int, longest: int, cool_down: int, memory: int, lines: int = 24, kept: int = 64) -> Fold:
    """Fire on lines (key, at, id, text) whose pending span reaches ``least``.

    A line that comes again takes the place of the old one; a time before the pending lines clears them. Pending lines reach back
    ``longest`` at most, a key is quiet for ``cool_down`` after firing, and the same ids, or texts without regard to case and
    spaces, don't fire again within ``memory`` (the last ``kept`` of each are remembered). Returns key, id (of the line that fires), n.
    """

    def step(state: dict, r) -> list:
        pending = state.setdefault("pending", [])
        line = (r.at, r.id, r.text)
        again = [i for i, x in enumerate(pending) if x[1] == r.id]
        if again:
            pending[again[0]] = line
        else:
            if pending and r.at < pending[0][0]:
                pending.clear()
            pending.append(line)
        while len(pending) > 1 and pending[-1][0] - pending[0][0] > longest:
            pending.pop(0)
        if pending[-1][0] - pending[0][0] < least or r.at - state.get("fired", -(1 << 62)) < cool_down:
            return []
        said = pending[-lines:]
        state["pending"] = []
        marks = {"ids": tuple(sorted(i for _, i, _ in said)), "texts": tuple(" ".join((t or "").split()).casefold() for _, _, t in said)}
        seen = {kind: {m: at for m, at in state.get("seen", {}).get(kind, {}).items() if r.at - at < memory} for kind in marks}
        state["seen"] = seen
        if any(m in seen[kind] for kind, m in marks.items()):
            return []
        for kind, m in marks.items():
            seen[kind] = dict([*seen[kind].items(), (m, r.at)][-kept:])
        state["fired"] = r.at
        return [(r.key, r.id, len(said))]

    return ["at", "id"], "key long, id long, n long", dict, step


def mute_repeats(df: DataFrame, within: int) -> DataFrame:
    """muting() over a table."""
    return ordered_fold(df, ["key"], *muting(within))


def muting(within: int) -> Fold:
    """Lines (key, at, id, text) without those whose text is that of the last line said, less than ``within`` ago. Returns key, id."""

    def step(state: dict, r) -> list:
        if state.get("text") == r.text and r.at - state["at"] < within:
            return []
        state["text"], state["at"] = r.text, r.at
        return [(r.key, r.id)]

    return ["at", "id"], "key long, id long", dict, step


def throttle(df: DataFrame, gap: int) -> DataFrame:
    """throttling() over a table."""
    return ordered_fold(df, ["key"], *throttling(gap))


def throttling(gap: int) -> Fold:
    """Updates (key, at, id, text) that differ from the last one sent and come ``gap`` after it or later. Returns key, id."""

    def step(state: dict, r) -> list:
        if not r.text or state.get("text") == r.text or ("at" in state and r.at - state["at"] < gap):
            return []
        state["text"], state["at"] = r.text, r.at
        return [(r.key, r.id)]

    return ["at", "id"], "key long, id long", dict, step


def admit(df: DataFrame, window: int, limit: int) -> DataFrame:
    """admitting() over a table."""
    # of hits at one instant at most ``limit`` can be admitted, the first by id: the others needn't pass through the key's one fold
    first = Window.partitionBy("key", "at").orderBy("id")
    ranked = df.select("key", "at", "id").withColumn("_n", F.row_number().over(first))
    out = ordered_fold(ranked.filter(F.col("_n") <= limit).drop("_n"), ["key"], *admitting(window, limit))
    return out.unionByName(ranked.filter(F.col("_n") > limit).select("key", "id", F.lit(False).alias("admitted")))


def admitting(window: int, limit: int) -> Fold:
    """Whether each hit (key, at, id) is admitted: fewer than ``limit`` hits were within the window before. Refused hits don't count. Returns key, id, admitted."""

    def step(state: list, r) -> list:
        while state and r.at - state[0] >= window:
            state.pop(0)
        ok = len(state) < limit
        if ok:
            state.append(r.at)
        return [(r.key, r.id, ok)]

    return ["at", "id"], "key long, id long, admitted boolean", list, step


def queue(df: DataFrame, workers: int) -> DataFrame:
    """Jobs (key, due, id, cost) on ``workers`` parallel workers: a job starts when it is due and a worker is free. Returns key, jobs, done, lag (of the last job), max_lag, max_backlog (jobs waiting or running as one comes)."""
    import heapq

    def step(state: dict, r) -> list:
        free, running = state.setdefault("free", [0] * workers), state.setdefault("running", [])
        while running and running[0] <= r.due:
            heapq.heappop(running)
        done = max(r.due, heapq.heappop(free)) + r.cost
        heapq.heappush(free, done)
        heapq.heappush(running, done)
        state["jobs"], state["done"], state["lag"] = state.get("jobs", 0) + 1, max(done, state.get("done", 0)), done - r.due
        state["max_lag"], state["most"] = max(state.get("max_lag", 0), done - r.due), max(state.get("most", 0), len(running))
        return []

    def end(state: dict, key: tuple) -> list:
        return [(key[0], state["jobs"], state["done"], state["lag"], state["max_lag"], state["most"])]

    return ordered_fold(df, ["key"], ["due", "id"], "key long, jobs long, done long, lag long, max_lag long, max_backlog long", dict, step, end)


def leases(df: DataFrame, lease: int, attempts: int, delay: int = 0) -> DataFrame:
    """Jobs (key, at, id, kind, owner) under leases: claim (by an owner, of a queued job), beat and finish (by the lease's holder), retry, defer and cancel.

    Before each event an expired lease is taken back: the job is queued again while it has attempts left, else it failed, or is cancelled where that was
    asked for. retry spends an attempt, defer gives it back, and either way the job can't be claimed for ``delay``; a job that was asked to cancel is cancelled by defer; a beat extends the lease. Events that don't fit the state change nothing, and
    ended jobs stay. Returns key, state, attempt, recovered, refused.
    """

    def recover(s: dict, now: int) -> None:
        if s["state"] in ("running", "cancel_requested") and s["until"] < now:
            spent = s["attempt"] >= attempts
            s["state"] = "cancelled" if s["state"] == "cancel_requested" else "failed" if spent else "queued"
            s["recovered"] += 1

    def start() -> dict:
        return {"state": "queued", "attempt": 0, "until": 0, "after": -(1 << 62), "owner": None, "recovered": 0, "refused": 0}

    def step(s: dict, r) -> list:
        recover(s, r.at)
        before, mine = s["state"], r.owner == s["owner"]
        if r.kind == "claim" and before == "queued" and r.at >= s["after"]:
            s.update(state="running", attempt=s["attempt"] + 1, owner=r.owner, until=r.at + lease)
        elif r.kind == "beat" and before in ("running", "cancel_requested") and mine:
            s["until"] = r.at + lease
        elif r.kind == "finish" and before in ("running", "cancel_requested") and mine:
            s["state"] = "done" if before == "running" else "cancelled"
        elif r.kind == "retry" and before == "running":
            s.update(state="queued" if s["attempt"] < attempts else "failed", after=r.at + delay)
        elif r.kind == "defer" and before == "running":
            s.update(state="queued", attempt=s["attempt"] - 1, after=r.at + delay)
        elif r.kind == "defer" and before == "cancel_requested":
            s["state"] = "cancelled"
        elif r.kind == "cancel" and before in ("queued", "running"):
            s["state"] = "cancelled" if before == "queued" else "cancel_requested"
        else:
            s["refused"] += 1
        return []

    def end(s: dict, key: tuple) -> list:
        return [(key[0], s["state"], s["attempt"], s["recovered"], s["refused"])]

    return ordered_fold(df, ["key"], ["at", "id"], "key long, state string, attempt long, recovered long, refused long", start, step, end)


#: How a noise floor falls and rises, and its least value.
NOISE_FALL, NOISE_RISE, LEAST_NOISE = (0.7, 0.3), (0.995, 0.005), 1e-4
#: The limits of utterances, in frames: speech of a whole utterance and of a lone word at least, silence that ends them, length from which a shorter silence
#: ends one, greatest length, how far back a cut is looked for, and frames that are added before and behind.
ENDPOINTS = {"least": 8, "lone": 3, "silence": 6, "lone_silence": 12, "soft": 60, "soft_silence": 2, "hard": 120, "back": 20, "before": 3, "behind": 2}


def endpointing(limits: dict[str, int] = ENDPOINTS, floor: float = 0.008, ratio: float = 3.0) -> Fold:
    """Utterances of frames (key, at, id, level): key, first, last (frame numbers of the key from 0, last not included), reason.

    A frame is speech if its level reaches ``floor`` and ``ratio`` times a noise floor that follows the quieter frames. An utterance ends after a
    pause; after soft frames a short silence does; after hard ones it is cut at its quietest late frame. What is behind a cut is carried to the next
    utterance, which may then be short. A short sound without more is forgotten. The end of the frames flushes (as ``end`` of the fold). State is
    the frames since the last cut, at most hard ones and those before.
    """
    g = limits

    def start() -> dict:
        return {"noise": floor, "base": 0, "levels": [], "begin": None, "heard": None, "carried": False}

    def loud(s: dict, level: float) -> bool:
        return level >= max(floor, s["noise"] * ratio)

    def ending(s: dict, i: int) -> tuple[int, str] | None:
        """Where and why an utterance ends at frame i; a sound that was too short is forgotten."""
        begin, heard = s["begin"], s["heard"]
        spoken, quiet, whole = heard + 1 - begin, i - heard, i + 1 - begin
        if quiet >= g["silence"] and spoken >= (g["lone"] if s["carried"] else g["least"]):
            return heard + 1, "pause"
        if quiet >= g["lone_silence"]:
            if spoken >= g["lone"]:
                return heard + 1, "pause"
            s.update(begin=None, heard=None, carried=False)
        elif whole >= g["soft"] and quiet >= g["soft_silence"]:
            return heard + 1, "soft"
        elif whole >= g["hard"]:
            late = range(max(begin + g["least"], i + 1 - g["back"]), i + 1)
            return min(late, key=lambda j: (s["levels"][j - s["base"]], -j), default=i) + 1, "hard"
        return None

    def cut(s: dict, key, end: int, reason: str) -> tuple:
        last = min(s["base"] + len(s["levels"]), end + (0 if reason == "hard" else g["behind"]))
        out = (key, max(s["base"], s["begin"] - g["before"]), last, reason)
        s["levels"], s["base"] = s["levels"][end - s["base"] :], end
        rest = [end + j for j, level in enumerate(s["levels"]) if loud(s, level)]
        s.update(begin=rest[0] if rest else None, heard=rest[-1] if rest else None, carried=reason in ("soft", "hard"))
        return out

    def step(s: dict, r) -> list:
        s["levels"].append(r.level)
        i, noise = s["base"] + len(s["levels"]) - 1, s["noise"]
        if loud(s, r.level):
            s["begin"], s["heard"] = i if s["begin"] is None else s["begin"], i
        if r.level < noise:
            s["noise"] = max(NOISE_FALL[0] * noise + NOISE_FALL[1] * r.level, LEAST_NOISE)
        elif not loud(s, r.level):
            s["noise"] = max(NOISE_RISE[0] * noise + NOISE_RISE[1] * r.level, LEAST_NOISE)
        found = ending(s, i) if s["begin"] is not None else None
        if found:
            return [cut(s, r.key, *found)]
        if s["begin"] is None and len(s["levels"]) > g["before"]:
            s["base"] += len(s["levels"]) - g["before"]
            s["levels"] = s["levels"][len(s["levels"]) - g["before"] :]
        return []

    return ["at", "id"], "key long, first long, last long, reason string", start, step


def utterances(df: DataFrame, limits: dict[str, int] = ENDPOINTS, floor: float = 0.008, ratio: float = 3.0) -> DataFrame:
    """endpointing() over a table, with the flush at the end of each key's frames."""
    order, schema, start, step = endpointing(limits, floor, ratio)

    def end(s: dict, key: tuple) -> list:
        if s["begin"] is None:
            return []
        last = s["heard"] + 1
        return [(key[0], max(s["base"], s["begin"] - limits["before"]), min(s["base"] + len(s["levels"]), last + limits["behind"]), "flush")]

    return ordered_fold(df, ["key"], order, schema, start, step, end)


#: Captions that a client shows at most.
SHOWN = 80


def client_view(df: DataFrame, most: int = SHOWN) -> DataFrame:
    """What a client shows after its events (key, at, id, kind, caption, seq, version, epoch, ord, text): key, place (from 1), caption, seq, version, draft, text.

    kind: caption, draft, deleted, expired, cleared. A clear drops all captions for good and raises the floor of epochs, below which later
    events are ignored; a deleted caption stays away, an expired one may come back. A caption replaces an older version in its place, and any
    draft; a draft never replaces a caption, and takes the greatest ord among captions where it has none. Beyond ``most`` the one that came first goes.
    Places follow ord, seq and the event. A null caption, or a caption without seq, does nothing. State is ``most`` captions and the deleted ids.
    """

    def start() -> dict:
        return {"shown": {}, "gone": set(), "floor": 0}

    def put(s: dict, caption, row: tuple) -> None:
        s["shown"][caption] = row
        while len(s["shown"]) > most:
            del s["shown"][next(iter(s["shown"]))]

    def step(s: dict, r) -> list:
        shown = s["shown"]
        if r.kind == "cleared":
            s["gone"].update(shown)
            shown.clear()
            s["floor"] = max(s["floor"], r.epoch)
        elif r.kind == "expired":
            shown.pop(r.caption, None)
        elif pd.isna(r.caption) or (s["floor"] and r.epoch < s["floor"]):
            pass
        elif r.kind == "deleted":
            s["gone"].add(r.caption)
            shown.pop(r.caption, None)
        elif r.caption not in s["gone"] and not pd.isna(r.seq):
            old = shown.get(r.caption)  # (ord, seq, event, version, draft, text)
            if r.kind == "draft":
                if old is None or old[4]:
                    put(s, r.caption, (r.ord or max((x[0] for x in shown.values() if not x[4]), default=0), r.seq, r.id, 0, True, r.text))
            elif old is None or old[4] or old[3] < r.version:
                put(s, r.caption, (r.ord, r.seq, r.id, r.version, False, r.text))
        return []

    def end(s: dict, key: tuple) -> list:
        rows = sorted(s["shown"].items(), key=lambda x: x[1][:3])
        return [(key[0], i, caption, x[1], x[3], x[4], x[5]) for i, (caption, x) in enumerate(rows, 1)]

    return ordered_fold(df, ["key"], ["at", "id"], "key long, place int, caption long, seq long, version long, draft boolean, text string", start, step, end)


def bounded_queue(df: DataFrame, most: int) -> DataFrame:
    """A queue of ``most`` that drops its oldest: puts and takes (key, at, id, put) in order. Returns key, waiting (ids, oldest first), dropped, taken; a take of an empty queue takes nothing."""

    def step(s: dict, r) -> list:
        if r.put:
            s["queue"].append(r.id)
            if len(s["queue"]) > most:
                s["queue"].pop(0)
                s["dropped"] += 1
        elif s["queue"]:
            s["queue"].pop(0)
            s["taken"] += 1
        return []

    def end(s: dict, key: tuple) -> list:
        return [(key[0], s["queue"], s["dropped"], s["taken"])]

    return ordered_fold(df, ["key"], ["at", "id"], "key long, waiting array<long>, dropped long, taken long", lambda: {"queue": [], "dropped": 0, "taken": 0}, step, end)


#: Rooms that a host meters at a time, samples of a session that it keeps.
METERED, SAMPLES = 32, 4096


def metering(most: int = METERED, last: int = SAMPLES) -> Fold:
    """Metrics of live sessions: rows (key, at, id, room, session, kind, amount) of a host, the key; kind is timeout, silent, empty, error or sample.

    A room has one session at a time: another replaces it. A host keeps the ``most`` rooms touched last, and of a session its counts
    and its ``last`` samples. A session that is replaced or evicted gives a row (key, room, session, ended, n, total, high, timeouts,
    silent, empty, errors; n, total and high are those of the samples kept); one that comes back begins anew. Any kind of row touches its room.
    """
    counted = ("timeout", "silent", "empty", "error")

    def step(s: dict, r) -> list:
        out, rooms = [], s["rooms"]
        live = rooms.pop(r.room, None)
        if live and live["session"] != r.session:
            out.append(metered_row(r.key, r.room, live, "replaced"))
            live = None
        live = live or {"session": r.session, "samples": deque(maxlen=last), "counts": dict.fromkeys(counted, 0)}
        rooms[r.room] = live
        if r.kind in counted:
            live["counts"][r.kind] += 1
        else:
            live["samples"].append(r.amount)
        if len(rooms) > most:
            oldest = next(iter(rooms))
            out.append(metered_row(r.key, oldest, rooms.pop(oldest), "evicted"))
        return out

    return ["at", "id"], "key long, room long, session long, ended string, n long, total long, high long, timeouts long, silent long, empty long, errors long", lambda: {"rooms": {}}, step


def metered_row(key, room, live: dict, ended: str) -> tuple:
    kept = live["samples"]
    return (key, room, live["session"], ended, len(kept), sum(kept), max(kept, default=None), *live["counts"].values())


def metered(df: DataFrame, most: int = METERED, last: int = SAMPLES) -> DataFrame:
    """metering() over a table; sessions that are live at its end give a row too (ended: live). Rows without a room or session, and samples without an amount, don't count."""

    def end(s: dict, key: tuple) -> list:
        return [metered_row(key[0], room, live, "live") for room, live in s["rooms"].items()]

    rows = df.filter("room IS NOT NULL AND session IS NOT NULL AND (kind <> 'sample' OR amount IS NOT NULL)")
    return ordered_fold(rows.withColumn("amount", F.coalesce("amount", F.lit(0).cast("long"))), ["key"], *metering(most, last), end)
