"""Operator 1: Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into phrases, each the longest phrase met before and one more code point. The
hashes of the phrase set's members are kept as a bottom-k sketch: the `KEPT` smallest. Two sketches estimate the
Jaccard likeness of the phrase sets, which is high where one text helps to compress the other.

An edited text shares the first part of its parse with its original, so the parse is resumed from there.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

KEPT = 64
_MASK, _MULT = (1 << 64) - 1, 0x9E3779B97F4A7C15


class Parse:
    """A phrase dictionary that can be taken back to an earlier state."""

    def __init__(self):
        self.next, self.hashes, self.made, self.node = {}, [_MULT], [], 0

    def feed(self, text: str) -> None:
        nxt, hashes, made, node = self.next, self.hashes, self.made, self.node
        get = nxt.get
        for c in array("I", text.encode("utf-32-le", "surrogatepass")):
            key = node << 21 | c
            node = get(key)
            if node is None:
                nxt[key] = len(hashes)
                hashes.append((hashes[key >> 21] ^ c) * _MULT & _MASK)
                made.append(key)
                node = 0
        self.node = node

    def state(self) -> tuple[int, int]:
        return len(self.made), self.node

    def back(self, state: tuple[int, int]) -> None:
        n, self.node = state
        for key in self.made[n:]:
            del self.next[key]
        del self.made[n:], self.hashes[n + 1 :]

    def sketch(self) -> np.ndarray:
        h = np.array(self.hashes[1:], dtype=np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = (h >> np.uint64(32)).astype(np.uint32)
        if len(h) > 4 * KEPT:
            h = np.partition(h, 2 * KEPT)[: 2 * KEPT]
        return np.unique(h)[:KEPT]


def fingerprint(text: str) -> str:
    p = Parse()
    p.feed(text)
    return hexed(p.sketch())


def hexed(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of both that each has; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if len(a) == KEPT or len(b) == KEPT:
        union = union[:KEPT]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).mean())


def edited(text: str, other: str) -> tuple[int, str]:
    """(how many code points of a text stay, what replaces the others): half of it by the first as many of another."""
    half = len(text) // 2
    return len(text) - half, other[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row; null text as the empty text, whose fingerprint is empty."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(b.column(1)[i].as_py() or "") for i in range(b.num_rows)], pa.string())], [id_col, "fingerprint"])

    return ready(docs.sparkSession) and docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; the next document by descending id gives the edit.

    Documents are dealt by ranges of ids; the first document of each range also goes to the range before it (the first
    of all to the last), so every document meets its successor. Null text is the empty text; null ids come last; equal
    ids are neighbours, ordered by their texts' hashes; a single row is its own successor; an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    marks = sorted(set(marks), reverse=True)
    # Range 0 has the largest ids; the marks are as many as there are ranges, so both lists are bounded.
    number = F.lit(len(marks))
    if marks:
        listed = F.array(*[F.lit(m) for m in marks])
        number = F.when(F.col("id").isNull(), F.lit(len(marks))).otherwise(F.size(F.filter(listed, lambda m: m > F.col("id"))))
    rows = rows.withColumn("range", number.cast("int")).withColumn("guest", F.lit(0)).withColumn("tie", F.xxhash64("text"))
    heads = rows.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("head")).orderBy("range").collect()
    before = {heads[i]["range"]: heads[i - 1]["range"] for i in range(len(heads))}
    guests = rows.where(F.lit(False))
    if heads:
        chosen = spark.createDataFrame([(h["range"], before[h["range"]], h["head"]["id"], h["head"]["tie"]) for h in heads], f"range int, to int, id {kind}, tie long")
        chosen = chosen.select(F.col("range").alias("r"), "to", F.col("id").alias("i"), F.col("tie").alias("t"))
        met = rows.join(F.broadcast(chosen), (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")))
        guests = met.select("id", "text", F.col("to").alias("range"), F.lit(1).alias("guest"), "tie")
    dealt = rows.unionByName(guests).repartitionById(max(len(heads), 1), F.col("range")).sortWithinPartitions("range", "guest", F.desc("id"), F.desc("tie")).select("id", "text", "range", "guest")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, done, id_type = None, [], None, None

        def flush() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return made

        for b in batches:
            id_type = b.schema.field(0).type
            for i in range(b.num_rows):
                key, text, place, guest = (b.column(k)[i].as_py() for k in range(4))
                if place == done:  # further guests with the same id
                    continue
                parse = Parse()
                half = len(text) - len(text) // 2
                parse.feed(text[:half])
                state = parse.state()
                parse.feed(text[half:])
                own = parse.sketch()
                if held is not None:
                    out.append(_compared(*held, text, own))
                held = None if guest else (key, text, parse, state, own)
                if guest:
                    done = place
                if len(out) >= 1000:
                    yield flush()
        if out:
            yield flush()

    return dealt.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compared(key, text: str, parse: Parse, state: tuple[int, int], own: np.ndarray, other: str, next_sketch: np.ndarray) -> tuple:
    stays, new = edited(text, other)
    parse.back(state)
    parse.feed(new)
    changed = parse.sketch()
    digest = hashlib.sha256((text[:stays] + new).encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), digest, hexed(own), hexed(changed), likeness(own, changed), likeness(own, next_sketch)
