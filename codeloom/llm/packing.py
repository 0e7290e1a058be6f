"""Operator 10: bounded-space online packing into fixed-length sequences.

Each partition keeps a fixed number of open windows. A document longer than a window gives whole windows at once; its
rest, like every shorter document, goes best-fit into the open window that it leaves fullest. Where none fits, the
fullest window is emitted and a new one opened. What is still open at the end of a partition is merged in a tree:
the leftovers of a bounded number of partitions are packed again by the same rule, until one set is left. No task
ever holds more than its open windows and the leftovers of `FAN` others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import cut

WINDOW, OPEN, FAN = 2048, 32, 8
END_ID = 1


class Windows:
    """Open windows and the sequences that they become. Items are (length, payload)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open = size, most, []

    def place(self, length: int, item) -> list | None:
        """Puts an item into a window; returns the items of a window that is emitted for it, if any."""
        best = None
        for w in self.open:
            if w[0] + length <= self.size and (best is None or w[0] > best[0]):
                best = w
        out = None
        if best is None:
            if len(self.open) >= self.most:
                fullest = max(self.open, key=lambda w: w[0])
                self.open.remove(fullest)
                out = fullest[1]
            best = [0, []]
            self.open.append(best)
        best[0] += length
        best[1].append(item)
        if best[0] == self.size:  # items are shorter than a window, so it was open before and nothing else is emitted
            self.open.remove(best)
            return best[1]
        return out


def padded(total: int, size: int = WINDOW) -> int:
    """The length to which a sequence is padded: a power of two stays as it is."""
    return total if total & (total - 1) == 0 else size


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, open_window int"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, windows: int = OPEN, tokenizer: str = vocab.BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of at most `size` tokens: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is the empty text, of which only the end id is packed. Rows are packed one by one, so repeated ids and
    null ids each give their own pieces; the order of ties is that of the input. An empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {PIECE}"
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "open_window"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, box, rows = TaskContext.get().partitionId(), 0, Windows(size, windows), []
        id_type = None

        def emit(items: list, at: int, window: int | None = None) -> None:
            offset = 0
            for i in items:
                rows.append((*i, at, offset, part, window))
                offset += i[2]

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            types = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int32()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            rows.clear()
            return made

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                ids = vocab.byte_ids(tokenizer, batch.column(1)[i].as_py() or "") + end_id.to_bytes(4, "little")
                total = len(ids) // 4
                whole = total // size
                for k in range(whole):
                    emit([(key, k * size, size, zlib.crc32(ids[4 * k * size : 4 * (k + 1) * size]), total)], (part << 32) + number)
                    number += 1
                if rest := total - whole * size:
                    done = box.place(rest, (key, whole * size, rest, zlib.crc32(ids[4 * whole * size :]), total))
                    if done:
                        emit(done, (part << 32) + number)
                        number += 1
            if len(rows) > 10_000:
                yield batch_of()
        if id_type is not None:
            for k, w in enumerate(box.open):
                emit(w[1], -1, k)
            yield batch_of()

    packed = cut(docs.select(id_col, text_col).mapInArrow(first, schema))
    done, left = [packed.where("open_window is null")], packed.where("open_window is not null")
    parts, level = (packed.agg(F.max("part")).first()[0] or 0) + 1, 0

    def merger(level: int, last: bool):
        def again(pdf: pd.DataFrame) -> pd.DataFrame:
            part, number, box, out = int(pdf["part"].iloc[0]) // FAN, 0, Windows(size, windows), []
            # Windows first: whole leftover windows, largest first, are items; ties by where they come from.
            units = [(int(u["length"].sum()), u) for _, u in pdf.sort_values(["part", "open_window", "offset"], kind="stable").groupby(["part", "open_window"], sort=True)]
            units.sort(key=lambda u: -u[0])

            def emit(items: list, sequence: int, window: int | None) -> None:
                x = pd.concat(items)
                x["offset"] = x["length"].cumsum() - x["length"]
                x["sequence_id"], x["part"], x["open_window"] = sequence, part, window
                out.append(x)

            for n, u in units:
                if n == size:
                    emit([u], (level << 56) + (part << 32) + number, None)
                    number += 1
                elif ready := box.place(n, u):
                    emit(ready, (level << 56) + (part << 32) + number, None)
                    number += 1
            for k, w in enumerate(box.open):
                emit(w[1], (level << 56) + (part << 32) + number if last else -1, None if last else k)
                number += 1
            made = pd.concat(out)
            made["part"] = made["part"].astype("int32")
            made["open_window"] = made["open_window"].astype("Int32")
            return made[names]

        return again

    while True:
        level += 1
        groups = -(-parts // FAN)
        last = groups == 1
        left = cut(left.groupBy((F.col("part") / FAN).cast("int").alias("_group")).applyInPandas(merger(level, last), schema))
        if last:
            done.append(left)
            break
        done.append(left.where("open_window is null"))
        left = left.where("open_window is not null")
        parts = groups
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("part", "open_window")
