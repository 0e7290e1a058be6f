import hashlib
import random

from codeloom.llm import fingerprint as fp


def phrases(text):
    """The set of phrases by the definition."""
    found, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in found:
            end += 1
        if end <= len(text):
            found.add(text[at:end])
        at = end
    return found


def test_sketch_is_that_of_the_phrase_set():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 300)))
        p = fp.Parse()
        p.feed(t)
        assert len(p.made) == len(phrases(t))
        assert len(p.sketch()) == min(fp.KEPT, len(phrases(t)))


def test_going_back_equals_parsing_anew():
    rng = random.Random(2)
    for _ in range(100):
        a, b, c = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 80))) for _ in range(3))
        p = fp.Parse()
        p.feed(a)
        state = p.state()
        p.feed(b)
        assert fp.hexed(p.sketch()) == fp.fingerprint(a + b)
        p.back(state)
        p.feed(c)
        assert fp.hexed(p.sketch()) == fp.fingerprint(a + c)


def plainly(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(ordered):
        t, other = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + other[:half]
        out[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), fp.fingerprint(t), fp.fingerprint(changed))
    return out


def test_every_document_meets_its_successor(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcdefg é\n") for _ in range(rng.randint(0, 400)))) for i in rng.sample(range(-500, 5000), 150)] + [(9999, None), (10_000, "")]
    got = fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    want = plainly(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == want[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in got if r["n_chars"] > 200]
    assert sum(r["near_edited"] for r in long) > sum(r["near_next"] for r in long)


def test_odd_tables(spark):
    schema = "doc_id long, text string, range string"
    assert fp.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    alone = fp.compare_with_next(spark.createDataFrame([(1, "abcdef", "x")], schema)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1 and alone[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    same = fp.compare_with_next(spark.createDataFrame([(1, "abab", "x"), (1, "abab", "x"), (None, None, None), (None, "x", None)], schema)).collect()
    assert len(same) == 4 and len({r["fingerprint"] for r in same if r["doc_id"] == 1}) == 1
    assert fp.fingerprints(spark.createDataFrame([(1, None, "x")], schema)).first()["fingerprint"] == ""
