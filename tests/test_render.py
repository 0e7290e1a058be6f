import json

from codeloom.plans import render


def test_payload_fits_and_counts_what_was_dropped():
    state = {"matches": [{"n": "x" * 40} for _ in range(30)], "weak": [{"n": "y" * 40} for _ in range(10)]}
    drops = [("weak", lambda: bool(state["weak"] and state["weak"].pop()))] * 10 + [("matches", lambda: len(state["matches"]) > 3 and bool(state["matches"].pop()))] * 30
    text = render.fitted(lambda: dict(state), drops, 200, "matches")
    payload = json.loads(text)
    assert len(text) <= 800 and not payload["truncation"]["complete"] and payload["truncation"]["dropped"]["weak"] == 10
    assert payload["truncation"]["estimated_tokens"] <= 200


def test_nothing_is_dropped_where_all_fits():
    payload = json.loads(render.fitted(lambda: {"matches": [1]}, [], 400, "matches"))
    assert payload["matches"] == [1] and payload["truncation"]["complete"]


def test_hard_cap_shrinks_and_then_leaves_the_envelope():
    big = {"matches": ["ü" * 50] * 100}
    text = render.fitted(lambda: big, [], 100, "matches")
    assert len(text) <= 400 and json.loads(text)["truncation"]["reason"] == "hard-cap"
    assert json.loads(render.fitted(lambda: big, [], 10, "matches"))["truncation"]["complete"] is False
