"""Bounded JSON payloads: rows of bounded plans, rendered on the driver under a hard number of characters."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import orient

# Characters of an estimated token, and the least, default and most tokens of an orientation.
CHARS, LEAST, DEFAULT, MOST = 4, 400, 800, 1200


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def fitted(build: Callable[[], dict], drops: list[tuple[str, Callable[[], bool]]], tokens: int, shrink: str) -> str:
    """The payload, with parts dropped in order until it fits; then its list `shrink` cut from the end; then a bare envelope.

    build: the payload of what is still there. drops: (category, function that drops one part and says whether it did).
    """
    room, gone = CHARS * tokens, {}

    def written(payload: dict, reason: str | None = None) -> str:
        note = {"budget_tokens": tokens, "estimated_tokens": 0, "complete": not gone and not reason}
        if gone and not reason:
            note["dropped"] = dict(gone)
        elif gone:
            note["dropped"] = dict(gone)
            note["reason"] = reason
        elif reason:
            note["reason"] = reason
        whole = {**payload, "truncation": note}
        note["estimated_tokens"] = -(-len(compact(whole)) // CHARS)
        return compact(whole)

    waiting = list(drops)
    text = written(build())
    while len(text) > room and waiting:
        category, drop = waiting.pop(0)
        if drop():
            gone[category] = gone.get(category, 0) + 1
            text = written(build())
    if len(text) <= room:
        return text
    entries = list(build().get(shrink, []))
    while True:
        text = written({shrink: entries}, "hard-cap")
        if len(text) <= room:
            return text
        if not entries:
            return compact({"truncation": {"budget_tokens": tokens, "complete": False, "reason": "hard-cap"}})
        entries.pop()


def orientation(found: orient.Found, top: DataFrame, tokens: int = DEFAULT) -> str:
    """Matches, weak matches, crowded and unmatched terms; paths are written once, in a table by first use."""
    tokens = min(MOST, max(LEAST, tokens))
    rows = sorted(top.collect(), key=lambda r: r["place"])  # MATCHES + WEAK rows at most
    state = {"matches": rows[: orient.MATCHES], "weak": rows[orient.MATCHES :], "crowded": {t: found.totals[t] for t in found.crowded}, "unmatched": list(found.unmatched)}

    def build() -> dict:
        files: dict[str, int] = {}
        show = lambda r: {"n": r["name"], "k": r["kind"], "f": files.setdefault(r["file_path"], len(files)), "l": r["start_line"], "t": r["terms"], **({"in": min(orient.CENTRAL, r["trusted"])} if r["trusted"] else {}), **({"ep": True} if r["entry"] else {})}
        payload = {"matches": [show(r) for r in state["matches"]], "weak": [show(r) for r in state["weak"]]}
        payload["files"] = list(files)
        if state["crowded"]:
            payload["crowded_terms"] = state["crowded"]
        if state["unmatched"]:
            payload["unmatched_terms"] = state["unmatched"]
        return {k: v for k, v in payload.items() if v or k == "matches"}

    def pop(name: str, least: int = 0) -> Callable[[], bool]:
        return lambda: len(state[name]) > least and bool(state[name].pop())

    drops = [("weak", pop("weak"))] * orient.WEAK + [("crowded_terms", lambda: bool(state["crowded"]) and not state["crowded"].clear())] + [("matches", pop("matches", 3))] * orient.MATCHES
    return fitted(build, drops, tokens, "matches")
