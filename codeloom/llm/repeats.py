"""How many of a document's shingles occur in other documents, counted over all documents without a row for each shingle.

Each task gathers its documents in packs. A pack sends every hash to the bucket of its value: those that it holds once
with the document, those that several of its documents share once in all, so that no hash is sent by a pack twice and
a very common one is no burden to its bucket. A bucket answers each pack with the number of the hashes of each
document that another pack holds as well; a pack's answers are added up. A bucket knows hashes by 32 bits of their own
beside those that name the bucket: hashes that agree in both count as one, so a number can be too large, never too small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .shingles import shingle_set

#: Hashes and documents of a pack; a document of more hashes is a pack of its own.
PACK, PACK_DOCS = 1 << 21, 50_000

_NOTE = "bucket int, pack long, kind int, a binary, b binary, c binary, d binary, e binary"
_DOCS, _HASHES = 0, 1


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return starts, x[starts]


def _pack_rows(ids: list, sets: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """The notes of one pack: its documents, and for each bucket the hashes that it gets."""
    n = np.array([len(s) for s in sets], np.int64)
    digests = [hashlib.md5(s.tobytes()).digest() for s in sets]
    place: dict[bytes, int] = {}
    of = np.array([place.setdefault(d, len(place)) for d in digests], np.int64)
    first = np.unique(of, return_index=True)[1]
    own = [sets[i] for i in first]
    hashes = np.concatenate([*own, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(own)), n[first])
    values, at, count = np.unique(hashes, return_inverse=True, return_counts=True)
    alone = count[at] == 1
    here = np.bincount(owner[~alone], minlength=len(own))
    known = np.array([i is not None for i in ids], np.uint8)
    raw = np.array([i or 0 for i in ids], np.int64)
    name = int.from_bytes(hashlib.md5(raw.tobytes() + b"".join(digests)).digest()[:8], "little", signed=True)
    rows = [(abs(name) % buckets, name, _DOCS, raw.tobytes() + known.tobytes(), n.tobytes(), b"".join(digests), of.tobytes(), here.astype(np.int64).tobytes())]
    bucket = lambda h: ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    once, owner, many = hashes[alone], owner[alone], values[count > 1]
    b = bucket(once)
    order = np.argsort(b.astype(np.uint16) if buckets <= 1 << 16 else b, kind="stable")
    once, owner, b, mb = once[order].astype(np.uint32), owner[order], b[order], bucket(many)
    edges, many_edges = np.searchsorted(b, np.arange(buckets + 1)), np.searchsorted(mb, np.arange(buckets + 1))
    many = many.astype(np.uint32)
    for k in range(buckets):
        lo, hi = edges[k : k + 2]
        also = many[many_edges[k] : many_edges[k + 1]]
        if hi > lo or len(also):
            starts, who = _runs(owner[lo:hi])
            rows.append((k, name, _HASHES, once[lo:hi].tobytes(), who.astype(np.uint32).tobytes(), starts.astype(np.uint32).tobytes(), also.tobytes(), None))
    return pd.DataFrame(rows, columns=["bucket", "pack", "kind", "a", "b", "c", "d", "e"])


def _answer(notes: pd.DataFrame) -> pd.DataFrame:
    """For each pack of a bucket: documents that have hashes which another pack has too, and how many."""
    read = lambda c: [np.frombuffer(x, np.uint32) for x in held[c]]
    docs, held = notes[notes["kind"] == _DOCS], notes[notes["kind"] == _HASHES]
    once, many = read("a"), read("d")
    sizes = [len(x) for x in once]
    everywhere = np.concatenate([*once, *many, *many, np.zeros(0, np.uint32)])
    _, at, count = np.unique(everywhere, return_inverse=True, return_counts=True)
    shared = np.split((count[at[: sum(sizes)]] > 1).astype(np.uint32), np.cumsum(sizes)[:-1]) if sizes else []
    rows = []
    for pack, flags, who, starts in zip(held["pack"], shared, read("b"), read("c"), strict=True):
        if len(flags):
            found = np.add.reduceat(flags, starts)
            rows.append((pack, _HASHES, who[found > 0].tobytes(), found[found > 0].astype(np.uint32).tobytes(), None, None, None))
    answers = pd.DataFrame(rows, columns=["pack", "kind", "a", "b", "c", "d", "e"])
    return pd.concat([docs[answers.columns], answers])


def _add_up(notes: pd.DataFrame) -> pd.DataFrame:
    """The documents of a pack with their numbers of repeated shingles."""
    parts = []
    answers = notes[notes["kind"] == _HASHES]
    for doc in notes[notes["kind"] == _DOCS].itertuples():
        n, of, total = np.frombuffer(doc.b, np.int64), np.frombuffer(doc.d, np.int64), np.frombuffer(doc.e, np.int64).copy()
        ids, known = np.frombuffer(doc.a, np.int64, len(n)), np.frombuffer(doc.a, np.uint8, len(n), 8 * len(n))
        for a, b in zip(answers["a"], answers["b"], strict=True):
            total[np.frombuffer(a, np.uint32)] += np.frombuffer(b, np.uint32)
        digests = [doc.c[16 * i : 16 * i + 16] if n[i] else None for i in range(len(n))]
        parts.append(pd.DataFrame({"id": pd.array(ids, "Int64").copy(), "n_shingles": n, "digest": digests, "repeated": total[of]}))
        parts[-1].loc[known == 0, "id"] = pd.NA
    return pd.concat(parts)


def repeated_shingles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest (of the set; null if empty), repeated (how many of them another set may hold too) of every row.

    Null, empty and blank texts have no shingles; null ids stay null; repeated rows come back repeated; an empty table
    gives no rows.
    """
    spark = ready(docs.sparkSession)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, size = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            rows = _pack_rows(ids, sets, buckets)
            for start in range(0, len(rows), 256):  # a batch is some megabytes
                yield pa.RecordBatch.from_pandas(rows[start : start + 256], schema=schema, preserve_index=False)

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                sets.append(shingle_set(batch.column(1)[i].as_py()))
                size += len(sets[-1])
                if size >= PACK or len(ids) >= PACK_DOCS:
                    yield from packed()
                    ids, sets, size = [], [], 0
        if ids:
            yield from packed()

    schema = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abcde"]])
    sent = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _NOTE)
    answered = sent.groupBy("bucket").applyInPandas(_answer, _NOTE.removeprefix("bucket int, "))
    return answered.groupBy("pack").applyInPandas(_add_up, "id long, n_shingles long, digest binary, repeated long")
