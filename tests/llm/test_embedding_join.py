import numpy as np
import pytest

from codeloom.llm import embedding_join as ej


def brute(rows):
    """id -> (links, smallest id reachable) by comparing all pairs in double precision."""
    units = [(i, ej._unit(v), label) for i, v, label in rows]
    n, parent = [0] * len(rows), {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, x, a) in enumerate(units):
        for q, (j, y, b) in enumerate(units[:p]):
            if x is not None and y is not None and a is not None and a == b and len(x) == len(y) and x @ y >= ej.LEAST:
                n[p] += 1
                n[q] += 1
                s, t = sorted((find(i), find(j)))
                parent[t] = s
    return sorted((i, n[k], find(i), i == find(i)) for k, (i, _, _) in enumerate(rows))


def near(rng, base, cosine):
    """A vector at a given cosine from a base vector."""
    b = base / np.linalg.norm(base)
    o = rng.standard_normal(len(b))
    o -= (o @ b) * b
    return cosine * b + np.sqrt(1 - cosine**2) * o / np.linalg.norm(o)


def made(seed, dim):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(60):
        base = rng.standard_normal(dim)
        rows.append(base)
        for _ in range(rng.integers(0, 4)):
            rows.append(near(rng, base, rng.uniform(0.94, 1.0)) * rng.uniform(0.1, 5))
    base = rng.standard_normal(dim)
    rows += [near(rng, base, rng.uniform(0.96, 1.0)) for _ in range(90)] + [base] * 5
    return [(i, [float(np.float32(c)) for c in v], int(i % 7 != 0)) for i, v in enumerate(rows)]


@pytest.mark.parametrize(("crowded", "block"), [(64, 512), (4, 8)])
def test_recall_and_precision_against_all_pairs(spark, monkeypatch, crowded, block):
    monkeypatch.setattr(ej, "CROWDED", crowded)
    monkeypatch.setattr(ej, "BLOCK", block)
    rows = made(3, 64)
    want = {r[0]: r for r in brute(rows)}
    got = {r[0]: tuple(r) for r in ej.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert set(got) == set(want)
    links = sum(r[1] for r in want.values())
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in got.values()) >= 0.97 * links
    assert sum(got[i][2] == want[i][2] for i in want) >= 0.97 * len(want)


def test_recall_on_the_border():
    rng = np.random.default_rng(9)
    base = [rng.standard_normal(64) for _ in range(3000)]
    rotation = ej.learn(np.stack([b / np.linalg.norm(b) for b in base]))
    x = np.stack([b / np.linalg.norm(b) for b in base])
    for cosine, least in ((0.93, 0.9), (0.95, 0.95), (0.97, 0.99)):
        y = np.stack([near(rng, b, cosine) for b in base])
        (cx, mx), (cy, my) = rotation.codes(x), rotation.codes(y)
        found = ej.first_bucket(cx, mx, cy, my) >= 0
        recall = found.mean()
        print(cosine, recall)
        assert recall >= least


def test_odd_rows(spark):
    v = [1.0] * 8
    rows = [(1, v, 1), (1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0] * 8, 1), (7, [1.0] * 7 + [float("nan")], 1), (8, [1.0] * 7 + [None], 1), (None, v, 1), (9, [1.0] * 3, 1), (10, [2.0] * 8, 1), (11, [], 1), (12, [1e300] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in ej.near_duplicates(df).collect()), key=str)
    together = [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (12, 4, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11, None)]
    assert got == sorted(together + alone, key=str)
    assert ej.near_duplicates(df.limit(0)).count() == 0


def test_a_pair_links_alike_in_small_and_crowded_buckets(spark):
    """The rule for a pair is the bucket it shares and its cosine, however many others are in the bucket."""
    rng = np.random.default_rng(4)
    pairs = [(b := rng.standard_normal(32), near(rng, b, 0.94)) for _ in range(60)]
    rows = [(2 * k + i, [float(c) for c in v], 1) for k, p in enumerate(pairs) for i, v in enumerate(p)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    held = ej.CROWDED
    got = []
    try:
        for crowded in (held, 1):  # all buckets small, all buckets crowded
            ej.CROWDED = crowded
            got.append(sorted(tuple(r) for r in ej.near_duplicates(df).collect()))
    finally:
        ej.CROWDED = held
    assert got[0] == got[1] and sum(r[1] for r in got[0]) >= 100
