import numpy as np

from codeloom.llm import quality


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n)) + "."


def test_held_out_accuracy_and_clean_documents_stay(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        good = i % 5 != 0
        t = words(rng, 40 + i % 50)
        if not good:
            t = [t.upper().replace(" ", "!! "), t.replace(" ", "$$$ "), "Spam " * 60, t.replace(" ", " | ")][i // 10 % 4]
        rows.append((i, t, f"h{i % 7}", "en", "extra"))
        if i % 2:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_path string")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == 600
    assert all(got[i] == (i % 5 != 0) for i in range(0, 600, 2))
    kept = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), only_kept=True)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())


def test_nulls_empty_tables_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "", "h", "en"), (None, "", "h", "en"), (2, "word " * 10, "h", None)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in quality.judge(docs, none).collect()] == [True] * 4
    assert quality.judge(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, odd).count() == 4


def test_sparse_sites_shrink_to_their_parents(spark):
    rates = spark.createDataFrame([("a", "x", 1000, 900.0, 1001, 900.2), ("a", "y", 1, 0.2, 1001, 900.2), ("b", "x", 1000, 100.0, 1000, 100.0)], "_host string, _path string, n_path long, s_path double, n_host long, s_host double")
    rate, host, path = quality.strengths(rates)
    assert 0.49 < rate < 0.51 and host < 20 and quality.LEAST_STRENGTH <= path <= quality.MOST_STRENGTH


def test_posteriors_equal_a_plain_computation(spark):
    rng = np.random.default_rng(3)
    rows = [(i, words(rng, 30) if i % 3 else "$$$ !! " * 20, f"h{i % 4}", f"p{i % 3 * (i % 2)}") for i in range(60)]
    rows += [(60, "", None, "p0"), (61, None, "lonely", None), (1, rows[1][1], "h1", "p1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rate, host_strength, path_strength = quality.strengths(quality.site_rates(docs, model))
    e = [float(model.evidence(np.array([quality.features(t or "")]))[0]) for _, t, _, _ in rows]
    own = [1 / (1 + np.exp(-x)) for x in e]
    want = []
    for i, (key, _, h, p) in enumerate(rows):
        of_host = [own[j] for j, r in enumerate(rows) if r[2] == h and j != i]
        of_path = [own[j] for j, r in enumerate(rows) if r[2:] == (h, p) and j != i]
        host = (sum(of_host) + host_strength * rate) / (len(of_host) + host_strength)
        path = min(max((sum(of_path) + path_strength * host) / (len(of_path) + path_strength), 1e-3), 1 - 1e-3)
        want.append((key, path, 1 / (1 + np.exp(-e[i] - np.log(path / (1 - path))))))
    got = sorted((r["doc_id"], r["prior"], r["posterior"]) for r in quality.judge(docs, labels).collect())
    assert [g[0] for g in got] == sorted(w[0] for w in want)
    np.testing.assert_allclose([g[1:] for g in got], [w[1:] for w in sorted(want)], rtol=1e-6)


def test_columns_with_dots_in_their_names(spark):
    docs = spark.createDataFrame([(1, "a word", "h", "en", "x", None), (2, None, "h", None, "y", 3)], "doc_id long, text string, source string, lang string, `a.b` string, `c d.` int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.judge(docs, labels, only_kept=True)
    assert kept.schema.names == docs.schema.names and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))
