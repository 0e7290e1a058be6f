"""Operator 8: token counts by the whole-token shortcut.

Offline, every vocabulary string that is a pre-token by itself and encodes alone as one token is put into a set
(`vocab.whole_tokens`). A text is split into pre-tokens; those in the set count one each without any merging, and
only the rest are merged. Merge results are kept in a bounded memo of each Python worker.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocab
from .common import by_batch

MEMO = 200_000


class _Lengths(dict):
    """Pre-token -> number of tokens. Starts from the proven strings; others are merged on their first use."""

    def __init__(self, name: str):
        super().__init__(dict.fromkeys(vocab.whole_tokens(name), 1))
        self.proven, self.name = len(self), name
        self.merge = vocab.byte_encoder(name)._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(piece.encode("utf-8", "surrogatepass")))
        if len(self) >= self.proven + MEMO:
            self.clear()
            self.update(dict.fromkeys(vocab.whole_tokens(self.name), 1))
        if len(piece) <= 256:
            self[piece] = n
        return n


@lru_cache(None)
def _lengths(name: str) -> _Lengths:
    return _Lengths(name)


def count_tokens(text: str, tokenizer: str = vocab.BYTE_BPE) -> int:
    memo = _lengths(tokenizer)
    parts = text.split(vocab.END_OF_TEXT)
    return len(parts) - 1 + sum(sum(map(memo.__getitem__, vocab.pre_tokens(p))) for p in parts)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, tokenizer: str = vocab.BYTE_BPE) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row.

    Null text counts as the empty text (0 bytes, 0 tokens); a special string in a text is one token, as in the
    library; null ids and repeated rows give a row each; an empty table gives no rows; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, n = [], []
        for i in range(batch.num_rows):
            t = batch.column(1)[i].as_py() or ""
            size.append(len(t.encode()))
            n.append(count_tokens(t, tokenizer))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            [id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    return by_batch(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
