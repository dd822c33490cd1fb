"""SQL of folds whose next step hangs on the last decision: a recursion over each key's rows, for tests and oracles."""

from __future__ import annotations


def recursion(rows: str, first: str, step: str, out: str) -> str:
    """``rows``: SQL of key, n (1, 2, ... in order) and the row's columns; ``first`` and ``step``: the columns of state s after the first and each further row e; ``out``: what is selected from s."""
    return f"WITH RECURSIVE e AS ({rows}), s AS (SELECT e.key, e.n, {first} FROM e WHERE n = 1 UNION ALL SELECT e.key, e.n, {step} FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1) {out}"


LINES = """SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec, id) AS n FROM (SELECT {key} AS key, {at} AS sec, event_id AS id, event_type AS text, value, {seq} AS seq FROM events)"""
SECONDS, MICROS = "CAST(floor(epoch(ts)) AS BIGINT)", "epoch_us(ts)"


def muting(within: int) -> str:
    same = f"(e.text = s.text AND e.sec - s.last < {within})"
    return recursion(LINES.format(key="user_id", at=SECONDS, seq=0), "id, text, sec AS last, true AS said", f"e.id, CASE WHEN {same} THEN s.text ELSE e.text END, CASE WHEN {same} THEN s.last ELSE e.sec END, NOT {same}", "SELECT key, id FROM s WHERE said")


def throttling(gap: int, at: str) -> str:
    held = f"(e.text = s.text OR e.sec - s.last < {gap})"
    return recursion(LINES.format(key="user_id", at=at, seq=0), "id, text, sec AS last, true AS sent", f"e.id, CASE WHEN {held} THEN s.text ELSE e.text END, CASE WHEN {held} THEN s.last ELSE e.sec END, NOT {held}", "SELECT key, id FROM s WHERE sent")


def admitting(window: int, limit: int, key: str) -> str:
    live = f"list_filter(s.times, lambda x: e.sec - x < {window})"
    return recursion(LINES.format(key=key, at=SECONDS, seq=0), "id, [sec] AS times, true AS admitted", f"e.id, CASE WHEN len({live}) < {limit} THEN list_append({live}, e.sec) ELSE {live} END, len({live}) < {limit}", "SELECT key, id, admitted FROM s")


def carrying(seq: str, stale: str) -> str:
    """Two lines and 80 characters at most, two numbers ahead."""
    near = "(s.held IS NOT NULL AND s.held < e.seq AND e.seq <= s.held + 2)"
    fits = f"({near} AND len(s.ids) < 2 AND length(s.t || '，' || e.text) <= 80)"
    older = "(s.held IS NOT NULL AND s.held < e.seq)"
    return recursion(
        LINES.format(key="user_id", at=SECONDS, seq=seq).replace("value, ", f"{stale} AS stale, "),
        "id, stale, CASE WHEN stale THEN seq END AS held, CASE WHEN stale THEN text END AS t, CASE WHEN stale THEN [id] ELSE []::BIGINT[] END AS ids, text AS said, []::BIGINT[] AS carried",
        f"""e.id, e.stale, CASE WHEN e.stale THEN CASE WHEN {fits} OR NOT {near} THEN e.seq ELSE s.held END WHEN {older} THEN NULL ELSE s.held END,
CASE WHEN e.stale THEN CASE WHEN {fits} THEN s.t || '，' || e.text WHEN {near} THEN s.t ELSE e.text END WHEN {older} THEN NULL ELSE s.t END,
CASE WHEN e.stale THEN CASE WHEN {fits} THEN list_append(s.ids, e.id) WHEN {near} THEN s.ids ELSE [e.id] END WHEN {older} THEN [] ELSE s.ids END,
CASE WHEN {near} THEN s.t || '，' || e.text ELSE e.text END, CASE WHEN {near} THEN s.ids ELSE [] END""",
        "SELECT key, id, said AS text, carried FROM s WHERE NOT stale",
    )


REINFORCED = """WITH RECURSIVE e AS (SELECT user_id, k % 10 AS unit, event_type, row_number() OVER (PARTITION BY user_id, k % 10 ORDER BY ts, event_id) AS n FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
s AS (SELECT user_id, unit, n, CASE WHEN event_type = 'error' THEN 1 ELSE 4 END AS quality FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.unit, e.n, CASE WHEN s.quality <= 1 THEN s.quality WHEN e.event_type = 'error' THEN 1 WHEN s.quality >= 3 THEN least(s.quality + 1, 5) ELSE s.quality END FROM s JOIN e ON e.user_id = s.user_id AND e.unit = s.unit AND e.n = s.n + 1)
SELECT user_id, unit, CAST(arg_max(quality, n) AS INTEGER) AS quality, CAST(max(n) AS INTEGER) AS uses FROM s GROUP BY 1, 2"""

#: Events as steps of proposals: kind, text, actor, seen and override follow from an event's type and number.
STEPS = """SELECT user_id AS key, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, k % 3 AS text, seen, k % 5 = 0 AS override,
  CASE WHEN event_type = 'error' THEN k // 2 % 2 ELSE k % 2 END AS actor,
  CASE event_type WHEN 'view' THEN 'propose' WHEN 'click' THEN 'amend' WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'edit' ELSE CASE WHEN k % 2 = 0 THEN 'reject' ELSE 'withdraw' END END AS kind
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 AS seen FROM events)"""
_PROPOSED = "(e.kind = 'propose' AND (s.item IS NULL OR e.text <> s.txt))"
_SEEN = "(s.item IS NOT NULL AND e.seen = s.rev)"
_APPROVED = f"(e.kind = 'approve' AND {_SEEN} AND (s.base = s.sig OR e.override))"
_ENDED = "(s.item IS NOT NULL AND (e.kind = 'reject' OR (e.kind = 'withdraw' AND e.actor = s.author)))"
STAGED = f"""WITH RECURSIVE e AS ({STEPS}),
s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS sig, CAST(NULL AS BIGINT) AS item, CAST(NULL AS BIGINT) AS txt, CAST(NULL AS BIGINT) AS author, CAST(NULL AS BIGINT) AS base, CAST(0 AS BIGINT) AS rev,
    CAST(NULL AS VARCHAR) AS act, CAST(NULL AS BIGINT) AS who, CAST(NULL AS BIGINT) AS old FROM e
  UNION ALL SELECT e.key, e.n, e.id, s.sig + CASE WHEN e.kind = 'edit' OR {_APPROVED} THEN 1 ELSE 0 END,
    CASE WHEN {_PROPOSED} THEN e.id WHEN {_APPROVED} OR {_ENDED} THEN NULL ELSE s.item END,
    CASE WHEN {_PROPOSED} THEN e.text ELSE s.txt END, CASE WHEN {_PROPOSED} THEN e.actor ELSE s.author END, CASE WHEN {_PROPOSED} THEN s.sig ELSE s.base END,
    CASE WHEN {_PROPOSED} THEN 1 WHEN e.kind = 'amend' AND {_SEEN} THEN s.rev + 1 ELSE s.rev END,
    CASE WHEN {_PROPOSED} THEN 'create' WHEN e.kind = 'amend' AND {_SEEN} THEN 'amend' WHEN {_APPROVED} THEN CASE WHEN s.base <> s.sig THEN 'override' ELSE 'approve' END WHEN {_ENDED} THEN e.kind END,
    CASE WHEN {_PROPOSED} THEN e.id ELSE s.item END, CASE WHEN {_PROPOSED} THEN s.item END
  FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
SELECT key, who AS item, id AS event, act AS what, 'audit' AS "row" FROM s WHERE act IS NOT NULL
UNION ALL SELECT key, old, id, 'supersede', 'audit' FROM s WHERE old IS NOT NULL UNION ALL SELECT key, old, id, 'superseded', 'state' FROM s WHERE old IS NOT NULL
UNION ALL SELECT key, who, id, CASE act WHEN 'reject' THEN 'rejected' WHEN 'withdraw' THEN 'withdrawn' ELSE 'approved' END, 'state' FROM s WHERE act IN ('approve', 'override', 'reject', 'withdraw')
UNION ALL SELECT key, item, NULL, 'pending', 'state' FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1) WHERE item IS NOT NULL"""


def queued(most: int) -> str:
    """Views are put, clicks take, and the oldest goes beyond ``most``."""
    rows = LINES.format(key="user_id", at=SECONDS, seq=0) + " WHERE text IN ('view', 'click')"
    added = "list_append(s.queue, e.id)"
    return recursion(
        rows, "CASE WHEN text = 'view' THEN [id] ELSE []::BIGINT[] END AS queue, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS taken",
        f"CASE WHEN e.text = 'view' THEN CASE WHEN len(s.queue) = {most} THEN {added}[2:] ELSE {added} END ELSE s.queue[2:] END, s.dropped + CASE WHEN e.text = 'view' AND len(s.queue) = {most} THEN 1 ELSE 0 END, s.taken + CASE WHEN e.text = 'click' AND len(s.queue) > 0 THEN 1 ELSE 0 END",
        "SELECT key, queue AS waiting, dropped, taken FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1",
    )


def leased(lease: int, attempts: int, delay: int) -> str:
    """Jobs of users: views claim, clicks beat, purchases finish, errors ask for another try (for k divisible by 3: later), signups cancel; two owners."""
    live, mine, fails = "st IN ('running', 'cancel_requested')", "coalesce(own = owner, false)", f"attempt >= {attempts}"
    return f"""WITH RECURSIVE e AS (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec, k % 2 AS own, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n,
  CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 'defer' ELSE 'retry' END WHEN 'signup' THEN 'cancel' ELSE 'beat' END AS kind
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, 'queued' AS st, CAST(0 AS BIGINT) AS attempt, CAST(0 AS BIGINT) AS until, CAST(-1 AS BIGINT) AS hold, CAST(NULL AS BIGINT) AS owner, CAST(0 AS BIGINT) AS recovered, CAST(0 AS BIGINT) AS refused FROM e
  UNION ALL SELECT key, n, to_state, CASE WHEN kind = 'claim' AND fits THEN attempt + 1 WHEN kind = 'defer' AND fits AND st = 'running' THEN attempt - 1 ELSE attempt END,
    CASE WHEN kind IN ('claim', 'beat') AND fits THEN sec + {lease} ELSE until END, CASE WHEN kind IN ('retry', 'defer') AND fits THEN sec + {delay} ELSE hold END,
    CASE WHEN kind = 'claim' AND fits THEN own ELSE owner END, recovered + CAST(rec AS BIGINT), refused + CAST(NOT fits AS BIGINT)
  FROM (SELECT *, CASE WHEN NOT fits OR kind = 'beat' THEN st WHEN kind = 'claim' THEN 'running' WHEN kind = 'finish' THEN CASE st WHEN 'running' THEN 'done' ELSE 'cancelled' END WHEN kind = 'retry' THEN CASE WHEN {fails} THEN 'failed' ELSE 'queued' END
      WHEN kind = 'defer' THEN CASE st WHEN 'running' THEN 'queued' ELSE 'cancelled' END ELSE CASE st WHEN 'queued' THEN 'cancelled' ELSE 'cancel_requested' END END AS to_state
    FROM (SELECT *, CASE kind WHEN 'claim' THEN st = 'queued' AND sec >= hold WHEN 'retry' THEN st = 'running' WHEN 'cancel' THEN st IN ('queued', 'running') WHEN 'defer' THEN {live} ELSE {live} AND {mine} END AS fits
      FROM (SELECT e.key, e.n, e.sec, e.own, e.kind, s.attempt, s.until, s.hold, s.owner, s.recovered, s.refused, s.st IN ('running', 'cancel_requested') AND s.until < e.sec AS rec,
          CASE WHEN s.st IN ('running', 'cancel_requested') AND s.until < e.sec THEN CASE WHEN s.st = 'cancel_requested' THEN 'cancelled' WHEN s.attempt >= {attempts} THEN 'failed' ELSE 'queued' END ELSE s.st END AS st
        FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1))))
SELECT key, st AS state, attempt, recovered, refused FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1"""
