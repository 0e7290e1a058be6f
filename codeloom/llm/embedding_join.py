"""Operator 2: near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation learnt on a bounded sample turns centred unit vectors into balanced binary codes. A code is cut into
`TABLES` parts, each an index of its own; a vector enters each table under its part and under the parts that differ
in its least certain bits. Vectors that meet in a bucket of equal label, however full it is, are compared again as
original vectors in double precision. Of all buckets in which two vectors meet, the first alone compares them, so that
no pair counts twice and no list of pairs has to be made distinct.

Equal vectors are one class with a count. Crowded buckets are compared block by block: a task holds two bounded blocks
and gives counts and the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready
from .components import components

LEAST = 0.93
#: The rotation is fitted on at most so many classes of equal vectors, chosen by the hash of their ids.
SAMPLE = 8_192
ROUNDS = 40
TABLES, PART, UNSURE = 4, 16, 3
CROWDED, BLOCK = 64, 512


class Rotation:
    """Codes of TABLES * PART bits at most, as signed 64-bit integers, and which bits of each part are least certain."""

    def __init__(self, mean: np.ndarray, matrix: np.ndarray):
        self.mean, self.matrix = mean, matrix

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (unit - self.mean) @ self.matrix
        z = np.hstack([z, np.full((len(z), TABLES * PART - z.shape[1]), -np.inf)])
        # The bits of vectors with few dimensions are dealt to the tables in turn.
        z = z.reshape(len(z), PART, TABLES).transpose(0, 2, 1)
        place = np.uint64(1) << np.arange(TABLES * PART, dtype=np.uint64).reshape(TABLES, PART)
        code = np.where(z > 0, place, np.uint64(0)).sum(axis=(1, 2), dtype=np.uint64)
        unsure = np.argsort(np.abs(z), axis=2, kind="stable")[:, :, :UNSURE]
        mask = np.zeros(len(z), np.uint64)
        for t in range(TABLES):
            for k in range(UNSURE):
                mask |= place[t][unsure[:, t, k]]
        return code.view(np.int64), mask.view(np.int64)


def learn(unit: np.ndarray, rounds: int = ROUNDS) -> Rotation:
    """Iterative quantisation: rotate principal components so that their signs lose the least."""
    mean = unit.mean(axis=0)
    v = unit - mean
    _, _, axes = np.linalg.svd(v.T @ v if len(v) else np.eye(unit.shape[1]))
    axes = axes[: TABLES * PART].T
    v = v @ axes
    r, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((axes.shape[1], axes.shape[1])))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0))
        r = left @ right
    return Rotation(mean, axes @ r)


def buckets(code: int, mask: int) -> list[int]:
    """The buckets of a vector: in each table its part with every choice of the unsure bits."""
    out = []
    for t in range(TABLES):
        part, unsure = code >> PART * t & (1 << PART) - 1, mask >> PART * t & (1 << PART) - 1
        bits = [1 << i for i in range(PART) if unsure >> i & 1]
        fixed = part & ~unsure
        out += [t << PART | fixed | sum(c) for n in range(len(bits) + 1) for c in combinations(bits, n)]
    return out


def first_bucket(ca, ma, cb, mb):
    """Of the buckets that two vectors share, the smallest; -1 without one. Works on arrays that broadcast."""
    differ, fixed = (ca ^ cb) & ~(ma | mb), (ca & ~ma) | (cb & ~mb)
    out = np.full(np.broadcast(ca, cb).shape, -1, np.int64)
    for t in reversed(range(TABLES)):
        low = np.int64(PART * t)
        part = np.int64((1 << PART) - 1)
        out = np.where((differ >> low) & part == 0, (t << PART) | ((fixed >> low) & part), out)
    return out


def first_bucket_sql(a: str, b: str) -> F.Column:
    differ, fixed = f"(({a}_code ^ {b}_code) & ~({a}_mask | {b}_mask))", f"(({a}_code & ~{a}_mask) | ({b}_code & ~{b}_mask))"
    part = (1 << PART) - 1
    whens = " ".join(f"when shiftright({differ}, {PART * t}) & {part} = 0 then {t << PART} | cast(shiftright({fixed}, {PART * t}) & {part} as int)" for t in range(TABLES))
    return F.expr(f"case {whens} end")


def _unit(vector) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if it can't link."""
    if vector is None or not len(vector):
        return None
    x = np.array([np.nan if c is None else c for c in vector] if isinstance(vector, list) else vector, dtype=np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum())


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, digest: null where the row can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                label, x = b.column(2)[i].as_py(), b.column(1)[i].as_py()
                linkable = label is not None and _unit(x) is not None
                out.append(hashlib.md5(repr(label).encode() + b"\0" + (np.array(x, np.float64) + 0.0).tobytes()).digest() if linkable else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(1), b.column(2).cast(pa.string())], ["id", "digest", "vector", "label"])

    element = dict(vectors.dtypes)[vector_col]
    return ready(vectors.sparkSession) and vectors.select(F.col(id_col).cast("long"), vector_col, label_col).mapInArrow(run, f"id long, digest binary, vector {element}, label string")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """id, n_links, component_id, kept of every row.

    Rows link only when labels are equal and not null; vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing, as do vectors of different lengths. Rows are vectors of their own even where ids or
    vectors repeat; rows of one id share a component. A row with a null id links with nothing and has a null component.
    """
    kind, element = dict(vectors.dtypes)[id_col], dict(vectors.dtypes)[vector_col]
    rows = cut(_classes(vectors, id_col, vector_col, label_col))
    classes = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("members"), F.first("vector").alias("vector"), F.first("label").alias("label"))
    classes = cut(classes.withColumn("label", F.concat_ws("/", F.size("vector").cast("string"), "label")))
    sizes = classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head(1)
    dim = sizes[0]["d"] if sizes else 1
    some = classes.where(F.size("vector") == dim).orderBy(F.xxhash64("node"), "node", "digest").limit(SAMPLE).select("vector").collect()
    rotation = learn(np.array([_unit(r["vector"]) for r in some]).reshape(len(some), dim)) if some else None

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, masks, keys = [], [], []
            for i in range(b.num_rows):
                x = _unit(b.column(3)[i].as_py())
                own = rotation if len(x) == dim else Rotation(np.zeros(len(x)), np.eye(len(x))[:, : TABLES * PART])
                c, m = own.codes(x[None, :])
                codes.append(int(c[0]))
                masks.append(int(m[0]))
                keys.append(buckets(int(c[0]) & (1 << 64) - 1, int(m[0]) & (1 << 64) - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(codes, pa.int64()), pa.array(masks, pa.int64()), pa.array(keys, pa.list_(pa.int32()))], ["digest", "node", "label", "code", "mask", "keys"])

    entries = classes.select("digest", "node", "label", "vector").mapInArrow(coded, "digest binary, node long, label string, code long, mask long, keys array<int>")
    entries = cut(entries).select("digest", "node", "label", "code", "mask", F.explode("keys").alias("bucket"))
    counts = entries.groupBy(F.col("label").alias("l"), F.col("bucket").alias("k")).agg(F.count("*").alias("met")).where("met > 1")
    shared = cut(entries.join(counts, (F.col("label") == F.col("l")) & (F.col("bucket") == F.col("k"))).drop("l", "k"))
    side = lambda p: shared.where(F.col("met") <= CROWDED).select(*[F.col(c).alias(f"{p}_{c}") for c in ("digest", "node", "label", "code", "mask", "bucket")])
    pairs = side("a").join(side("b"), (F.col("a_label") == F.col("b_label")) & (F.col("a_bucket") == F.col("b_bucket")) & (F.col("a_digest") < F.col("b_digest")))
    pairs = pairs.where(F.col("a_bucket") == first_bucket_sql("a", "b")).select("a_digest", "b_digest")
    whole = classes.select("digest", "node", "members", "vector")
    named = lambda p: whole.select(*[F.col(c).alias(f"{p}{c}") for c in whole.columns])
    met = pairs.join(named("x_"), F.col("a_digest") == F.col("x_digest")).join(named("y_"), F.col("b_digest") == F.col("y_digest")).select("x_digest", "x_node", "x_members", "x_vector", "y_digest", "y_node", "y_members", "y_vector")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [float(_unit(b.column(3)[i].as_py()) @ _unit(b.column(7)[i].as_py())) >= least for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 2, 4, 5, 6)], ["x_digest", "x_node", "x_members", "y_digest", "y_node", "y_members"]).filter(pa.array(near, pa.bool_()))

    found = cut(met.mapInArrow(compared, "x_digest binary, x_node long, x_members long, y_digest binary, y_node long, y_members long"))
    tallies = found.select(F.col("x_digest").alias("digest"), F.col("y_members").alias("n")).unionByName(found.select(F.col("y_digest").alias("digest"), F.col("x_members").alias("n")))
    links = found.select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))

    crowded = shared.where(F.col("met") > CROWDED)
    if crowded.head(1):
        given = cut(_crowded_links(crowded, classes, least, element))
        tallies = tallies.unionByName(given.where("n is not null").select("digest", "n"))
        links = links.unionByName(given.where("a is not null").select("a", "b"))
    totals = tallies.groupBy(F.col("digest").alias("t")).agg(F.sum("n").alias("n"))
    # Rows of one id are joined, and a class's rows with its node.
    classed = rows.where("id is not null").join(classes.select(F.col("digest").alias("c"), "node", "members"), F.col("digest") == F.col("c"), "left").select("id", "digest", "node", "members")
    own = classed.where("node is not null and node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    roots = components(links.unionByName(own))
    out = classed.join(totals, F.col("digest") == F.col("t"), "left").join(roots.withColumnRenamed("node", "r"), F.col("id") == F.col("r"), "left")
    out = out.select("id", F.coalesce(F.col("n") + F.col("members") - 1, F.col("members") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = out.unionByName(rows.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_links", F.col("component_id").cast(kind).alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _crowded_links(crowded: DataFrame, classes: DataFrame, least: float, element: str) -> DataFrame:
    """Rows (digest, n) with link counts and (a, b) with the links of forests, from pairs of blocks of crowded buckets."""
    blocks = F.ceil(F.col("met") / BLOCK).cast("int")
    own = crowded.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = own.select("digest", "node", "label", "code", "mask", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    vectors = classes.select(F.col("digest").alias("v"), "members", "vector")
    held = dealt.join(vectors, F.col("digest") == F.col("v")).select("digest", "node", "members", "vector", "label", "code", "mask", "bucket", "own", "i", "j")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, bucket = int(pdf["i"].iat[0]), int(pdf["j"].iat[0]), int(pdf["bucket"].iat[0])
        pdf = pdf.sort_values("digest", kind="stable").reset_index(drop=True)
        unit = np.stack([_unit(v) for v in pdf["vector"]])
        code, mask = pdf["code"].to_numpy(np.int64), pdf["mask"].to_numpy(np.int64)
        side = pdf["own"].to_numpy()
        near = unit @ unit.T >= least
        near &= first_bucket(code[:, None], mask[:, None], code[None, :], mask[None, :]) == bucket
        near &= (side[:, None] != side[None, :]) | (i == j)
        np.fill_diagonal(near, False)
        n = near @ pdf["members"].to_numpy(np.int64)
        root = np.arange(len(pdf))
        while True:
            low = np.minimum(root, np.where(near, root[None, :], len(pdf)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        node = pdf["node"].to_numpy(np.int64)
        some, linked = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(pdf)))
        counts = pd.DataFrame({"digest": pdf["digest"].to_numpy()[some], "n": n[some], "a": pd.array([None] * len(some), "Int64"), "b": pd.array([None] * len(some), "Int64")})
        forest = pd.DataFrame({"digest": [None] * len(linked), "n": pd.array([None] * len(linked), "Int64"), "a": node[linked], "b": node[root[linked]]})
        return pd.concat([x.astype({"n": "Int64", "a": "Int64", "b": "Int64"}) for x in (counts, forest)])

    return held.groupBy("label", "bucket", "i", "j").applyInPandas(compare, "digest binary, n long, a long, b long")
