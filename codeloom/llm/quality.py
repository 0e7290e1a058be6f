"""Operator 6: document quality by hierarchical empirical Bayes.

A logistic classifier, fitted on a bounded sample of labelled rows, gives each document evidence: the log-likelihood
ratio of good against bad. Hosts and paths below them have posterior rates of good documents, counted softly over all
documents by grouped aggregation. A path shrinks towards its host and a host towards the global rate, by Beta priors
whose strengths come from how much hosts and paths differ; sparse sites thus fall back on their parents. A document's
posterior adds its evidence to the prior of its path, from which its own share is taken out.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, cut, ready

#: At most so many labelled rows are fitted, chosen by the hash of their ids.
SAMPLE = 20_000
#: A document is kept unless its posterior is below this.
THRESHOLD = 0.5
#: Bounds of the strengths of priors, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0

#: At most so many paths of hosts (some 100 bytes each) are broadcast.
BROADCAST_SITES = 200_000

FEATURES = ("symbols", "exclamations", "upper", "digits", "repeats", "distinct_shortfall", "spaces_shortfall")

_SYMBOL, _BANG, _UPPER, _DIGIT, _SPACE = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = _SYMBOL
_CLASS[ord("!")] = _BANG
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
for _c in b" \t\n\x0b\x0c\r":
    _CLASS[_c] = _SPACE


def features(text: str) -> list[float]:
    """Shares of a text, each between 0 and 1; all 0 for the empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_CLASS[raw], minlength=6) / len(raw)
    words = text.split()
    repeats = sum(map(operator.eq, words, words[1:])) / max(1, len(words))
    # A text of distinct words has about n ** 0.75 of them or more.
    few = max(0.0, 1 - len(set(words)) / max(1.0, len(words) ** 0.75))
    return [n[_SYMBOL], n[_BANG], n[_UPPER], n[_DIGIT], repeats, few, max(0.0, 0.1 - n[_SPACE]) * 10 if len(words) > 3 else 0.0]


class Model:
    """Logistic regression on square roots of shares; the intercept is that of equal classes, so the logit is evidence."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def evidence(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.sqrt(rows) @ self.weights + self.bias, -30, 30)


def fit(rows: np.ndarray, good: np.ndarray, ridge: float = 1e-5, steps: int = 60) -> Model:
    """Newton's method with classes weighted to be equal. Without both classes every text has evidence 0."""
    n1 = float(good.sum())
    n0 = len(good) - n1
    if not n0 or not n1:
        return Model(np.zeros(len(FEATURES)), 0.0)
    x = np.hstack([np.sqrt(rows), np.ones((len(rows), 1))])
    weight = np.where(good > 0, 0.5 / n1, 0.5 / n0)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - good)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return Model(w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits the classifier on at most `sample` labelled rows; rows with a null id or label are left out, null texts count as empty.

    Where rows of the documents repeat an id, at most ten times as many are fitted, chosen by the hash of their features.
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("good"))
    some = some.orderBy(F.xxhash64("id"), "good").limit(sample)
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("d") == F.col("id")).select("text", "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(b.column(0)[i].as_py() or "") for i in range(b.num_rows)], pa.list_(pa.float64())), b.column(1)], ["x", "good"])

    found = rows.mapInArrow(run, "x array<double>, good double").orderBy(F.xxhash64("x"), "x", "good").limit(10 * sample).collect()
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r["good"] for r in found], float))


def site_rates(docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang", text_col: str = "text") -> DataFrame:
    """_host, _path, and for each: documents, soft count of good ones; and the priors' figures. One row a path of a host."""
    sites = docs.select(F.col(host_col).cast("string").alias("_host"), F.col(path_col).cast("string").alias("_path"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = model.evidence(np.array([features(b.column(2)[i].as_py() or "") for i in range(b.num_rows)], float).reshape(b.num_rows, -1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-e)))], ["_host", "_path", "p"])

    scored = sites.mapInArrow(run, "_host string, _path string, p double")
    paths = scored.groupBy("_host", "_path").agg(F.count("*").alias("n_path"), F.sum("p").alias("s_path"))
    hosts = paths.groupBy(F.col("_host").alias("_h")).agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    return paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")


def strengths(rates: DataFrame) -> tuple[float, float, float]:
    """(global rate, strength of a host's prior, strength of a path's prior) by moments, as sums over the sites."""
    hosts = rates.groupBy("_host").agg(F.first("n_host").alias("n"), F.first("s_host").alias("s"))
    one = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not one["n"]:
        return 0.5, LEAST_STRENGTH, LEAST_STRENGTH
    rate = min(max(one["s"] / one["n"], 1e-3), 1 - 1e-3)
    two = rates.agg(F.sum(F.col("s_path") * F.col("s_path") / F.col("n_path")).alias("q"), F.count("*").alias("k"), F.sum(F.col("n_path") * F.col("n_path") / F.col("n_host")).alias("nn")).first()

    def strength(between: float, groups: int, spread: float) -> float:
        """between: sum of squares between groups; spread: documents in all less those that their sizes make up for."""
        noise = rate * (1 - rate)
        variance = (between - max(0, groups) * noise) / spread if spread > 0 else 0.0
        return float(np.clip(noise / variance - 1, LEAST_STRENGTH, MOST_STRENGTH)) if variance > 0 else MOST_STRENGTH

    total = one["n"]
    host = strength(one["q"] - one["s"] ** 2 / total, one["k"] - 1, total - one["nn"] / total)
    path = strength(two["q"] - one["q"], two["k"] - one["k"], total - two["nn"])
    return rate, host, path


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, only_kept: bool = False) -> DataFrame:
    """id, evidence, prior, posterior, kept of every row; with only_kept the rows themselves, all columns, that are kept.

    The level below the host is `path_col`. `documents` have no addresses, so their language serves as the path there.

    Null host or path is a site of its own; null and empty texts have the evidence of a text without features; a site
    with this document alone has its parent's rate. Equal rows are judged equally, one by one. Tables without rows or
    without labels of both classes give evidence 0, so that all rows are kept unless the threshold is above the rate.
    """
    ready(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    rates = cut(site_rates(docs, model, host_col, path_col, text_col))  # one pass over the texts serves all that follows
    rate, host_strength, path_strength = strengths(rates)
    figures = rates.select(F.col("_host").alias("_q_host"), F.col("_path").alias("_q_path"), F.array(*[F.col(c).cast("double") for c in ("n_path", "s_path", "n_host", "s_host")]).alias("_q_figures"))
    few = figures.count() <= BROADCAST_SITES  # beyond, the join shuffles, and Spark splits a host that very many rows share
    met = docs.join(F.broadcast(figures) if few else figures, docs[host_col].cast("string").eqNullSafe(F.col("_q_host")) & docs[path_col].cast("string").eqNullSafe(F.col("_q_path")), "left")
    names, width, text_at, id_at = docs.columns, len(docs.columns), docs.columns.index(text_col), docs.columns.index(id_col)
    rows = met.select(*[docs[f"`{c}`"] for c in docs.columns], "_q_figures")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            e = model.evidence(np.array([features(b.column(text_at)[i].as_py() or "") for i in range(n)], float).reshape(n, -1))
            own = 1 / (1 + np.exp(-e))
            f = np.array([x or [1.0, own[i], 1.0, own[i]] for i, x in enumerate(b.column(width).to_pylist())], float)
            host = (f[:, 3] - own + host_strength * rate) / (f[:, 2] - 1 + host_strength)
            path = np.clip((f[:, 1] - own + path_strength * host) / (f[:, 0] - 1 + path_strength), 1e-3, 1 - 1e-3)
            posterior = 1 / (1 + np.exp(-(e + np.log(path / (1 - path)))))
            kept = posterior >= threshold
            if only_kept:
                yield pa.RecordBatch.from_arrays(b.columns[:width], names).filter(pa.array(kept))
            else:
                yield pa.RecordBatch.from_arrays([b.column(id_at), pa.array(e), pa.array(path), pa.array(posterior), pa.array(kept)], [id_col, "evidence", "prior", "posterior", "kept"])

    kind = dict(docs.dtypes)[id_col]
    return by_place(rows).mapInArrow(run, docs.schema if only_kept else f"`{id_col}` {kind}, evidence double, prior double, posterior double, kept boolean")
