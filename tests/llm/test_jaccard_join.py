import random
import re

import pytest

from codeloom.llm import jaccard_join
from codeloom.llm.components import components
from codeloom.llm.shingles import shingle_set


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    """id -> (size, smallest id reachable), by comparing all pairs."""
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b) or i == j:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, groups, alone, passage_share):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(60)]
    texts = []
    for size, length, edits in groups:
        base = [word() for _ in range(length)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(alone):
        own = [word() for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(own + passage if rng.random() < passage_share else own))
    texts += ["", "   ", None, "one two", "One TWO", "one two three"] + texts[:3]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("crowded", "levels", "seed"), [(64, 6, 1), (5, 6, 2), (5, 1, 3), (3, 2, 4)])
def test_equals_all_pairs(spark, monkeypatch, crowded, levels, seed):
    monkeypatch.setattr(jaccard_join, "CROWDED", crowded)
    monkeypatch.setattr(jaccard_join, "LEVELS", levels)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = corpus(seed, [(25, 60, 3), (20, 200, 12), (3, 20, 1), (2, 400, 20)], 60, 0.5)
    got = jaccard_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string, node long, n long"
    rows = [(1, "a b c d e f", 1, 1), (1, "x y z", 1, 1), (2, "x y z", None, None), (None, "x y z", 0, 0), (3, None, 0, 0), (3, None, 0, 0)]
    got = sorted((tuple(r) for r in jaccard_join.join_classes(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 1, 1), (2, 1, 1), (None, 1, None), (3, 0, 3), (3, 0, 3)], key=str)
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "node", "n"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3", "3", "None"]
    assert jaccard_join.join_classes(spark.createDataFrame([], schema)).count() == 0


def test_sets_equal_their_definition():
    rng = random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("abA \t\x0b\x0c\x1c\x85é\n") for _ in range(rng.randint(0, 60)))
        assert len(shingle_set(t)) == len(plain_set(t))


@pytest.mark.parametrize("local", [1000, 0])
def test_components_of_a_path_and_a_star(spark, local):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (5, 3), (41, 41)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), local).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50)) and got[100] == 100
    assert len(got) == 92
    assert components(spark.createDataFrame([], "a long, b long"), local).count() == 0


def test_components_of_random_links_by_one_task_and_by_stars(spark):
    rng = random.Random(2)
    links = [(rng.randrange(-150, 150) * 3, rng.randrange(-150, 150) * 3) for _ in range(140)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = {n: r for n, r in root.items() if any(n in x and x[0] != x[1] for x in links)}
    df = spark.createDataFrame(links, "a long, b long")
    for local in (1000, 0):
        assert {r["node"]: r["root"] for r in components(df, local).collect()} == want


def test_every_pair_at_the_border_links(spark):
    texts = {}
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(100)]
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(words[:79])
    links = jaccard_join.near_links(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))[1]
    assert {(max(r), min(r)) for r in links.select("a", "b").collect()} == {(2 * k + 1, 2 * k) for k in range(40)}


def test_crowded_template_loses_no_link(spark):
    """A template of 300 shingles in 80 documents that differ, and documents of 400 that hold it: likeness 0.75 exactly."""
    template = [f"t{i}" for i in range(304)]
    texts = [" ".join(template)]
    texts += [" ".join(template + [f"m{k}x{i}" for i in range(101 + k % 3)]) for k in range(80)]
    texts += [" ".join(template + [f"z{k}x{i}" for i in range(100)]) for k in range(3)]
    rows = list(enumerate(texts))
    got = jaccard_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(rows)
    assert [x[2] for x in want[-3:]] == [0, 0, 0]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_large_groups_with_shipped_bounds(spark):
    rows = corpus(9, [(150, 80, 4), (90, 60, 9), (100, 150, 60)], 120, 0.9)
    got = jaccard_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_clashing_columns_and_empty_texts_of_one_id(spark):
    rows = [(5, "a b c d e f g", 1, 2), (2, "a b c d e f g", 3, 4), (5, "", 5, 6), (7, None, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, region long, `set` long")
    assert sorted(tuple(r) for r in jaccard_join.join_classes(docs).collect()) == [(2, 3, 2), (5, 0, 2), (5, 3, 2), (7, 0, 7)]


def test_repeated_shingles_equal_a_plain_count(spark, monkeypatch):
    from codeloom.llm import repeats

    monkeypatch.setattr(repeats, "PACK", 400)
    rows = corpus(3, [(6, 40, 3), (2, 90, 5)], 40, 0.4)
    got = {r["id"]: (r["n_shingles"], r["repeated"]) for r in repeats.repeated_shingles(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text").collect()}
    sets = {i: plain_set(t) for i, t in rows}
    for i, s in sets.items():
        least = sum(any(x in o for o in sets.values() if o != s) for x in s)
        assert got[i][0] == len(s) and least <= got[i][1] <= len(s)
        if not any(o == s for j, o in sets.items() if j != i):
            assert got[i][1] == least


def test_pairs_of_a_large_group_follow_its_rows(spark, monkeypatch):
    """A group of near copies beside documents that hold its text without linking: few pairs are measured, no link is lost."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(400)}"
        rows.append((k, " ".join(copy)))
    rows += [(300 + k, " ".join(base + [f"y{k % 3}z{i}" for i in range(55 + k % 5)])) for k in range(40)]
    asked, measured = [], jaccard_join._measured
    monkeypatch.setattr(jaccard_join, "_measured", lambda pairs, sets: (asked.append(pairs.count()), measured(pairs, sets))[1])
    got = jaccard_join.join_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert sum(asked) < len(rows) * (len(rows) - 1) // 2 // 5


def test_a_pack_takes_little_memory():
    import tracemalloc

    import numpy as np

    from codeloom.llm import repeats

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64)) for _ in range(repeats.PACK // 2000)]
    tracemalloc.start()
    try:
        repeats._pack_rows(list(range(len(sets))), sets, 51)
        assert tracemalloc.get_traced_memory()[1] < 256e6
    finally:
        tracemalloc.stop()
