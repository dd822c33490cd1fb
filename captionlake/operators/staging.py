"""Proposals to change a target: one pending item for each target, decided under two locks, with an audit row for every step."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .folds import ordered_fold

SCHEMA = "key long, item long, event long, what string, row string"


def stage(events: DataFrame) -> DataFrame:
    """Fold each target's events (key, at, id, kind, text, actor, seen, override) into audit rows and state rows, in one pass.

    propose makes a pending item whose base is the target's signature of that moment; an equal pending proposal stays as it
    is, another is superseded. amend and approve must have seen the item's revision; approve also needs the target to be as
    it was (or override, which the audit tells). reject ends the pending item, withdraw does if its author asks. edit changes the target, as approve does. Events
    that don't fit change nothing and leave no row. Returns key, item (the id of its proposal), event, what and row: audit
    (create, supersede, amend, approve, override, reject, withdraw) or state (superseded, approved, rejected, withdrawn, and pending for what is left, without an event).
    """

    def step(s: dict, r) -> list:
        item = s["item"]
        row = lambda what, kind="audit", of=None: (r.key, item["id"] if of is None else of, r.id, what, kind)
        if r.kind == "edit":
            s["sig"] += 1
        elif r.kind == "propose":
            if item and item["text"] == r.text:
                return []
            gone = [row("supersede"), row("superseded", "state")] if item else []
            s["item"] = {"id": r.id, "text": r.text, "author": r.actor, "base": s["sig"], "rev": 1}
            return [*gone, row("create", of=r.id)]
        elif not item:
            return []
        elif r.kind in ("amend", "approve") and r.seen != item["rev"]:
            return []
        elif r.kind == "amend":
            item["rev"] += 1
            return [row("amend")]
        elif r.kind == "approve":
            changed = item["base"] != s["sig"]
            if changed and not r.override:
                return []
            s["sig"], s["item"] = s["sig"] + 1, None
            return [row("override" if changed else "approve"), row("approved", "state")]
        elif r.kind == "reject" or (r.kind == "withdraw" and r.actor == item["author"]):
            s["item"] = None
            return [row(r.kind), row("rejected" if r.kind == "reject" else "withdrawn", "state")]
        return []

    def end(s: dict, key: tuple) -> list:
        return [(key[0], s["item"]["id"], None, "pending", "state")] if s["item"] else []

    return ordered_fold(events, ["key"], ["at", "id"], SCHEMA, lambda: {"sig": 0, "item": None}, step, end)
