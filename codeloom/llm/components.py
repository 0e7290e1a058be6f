"""Connected components of links: by one task up to a checked number of links, by alternating large and small stars beyond it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, ready


#: Up to so many distinct links (8 MB) are one bounded task's work; a round of stars takes a dozen stages, whatever its size.
LOCAL_LINKS = 500_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        # The roots of either end take the smaller one, then all follow their roots to the end.
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, roots = _forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            step = 1 << 16
            for i in range(0, len(nodes), step):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + step]), pa.array(roots[i : i + step])], ["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node long, root long")


def components(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """node, root (the smallest node reachable) for every node of links(a, b); a link of a node to itself is ignored.

    Up to `local` distinct links are solved by one task. Beyond, each round of stars halves the depth of trees at least, and
    a round's minimum is combined before its shuffle.
    """
    ready(links.sparkSession)
    edges = cut(gathered(links).select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a > b").distinct())
    if edges.count() <= local:
        return _in_one_task(edges)
    before = None
    while True:
        # Large star: larger neighbours of each node are linked to the smallest of all its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = cut(large)
        # Small star: each node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a > b").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == before or now[0] == now[2] and not edges.join(edges.select(F.col("a").alias("up")), F.col("b") == F.col("up"), "left_semi").head(1):
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
