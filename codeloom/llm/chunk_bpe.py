"""Operator 4: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last few code points picks cut places, so that equal passages of different documents are cut
into equal chunks. Each Python worker encodes a chunk once and keeps its ids and decoded form in a memo bounded by
bytes. A cut may fall inside a pre-token; such joins are repaired by encoding the text around the cut again, over
windows that grow until both ends lie on white space, where encodings of the two sides agree with that of the whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vocab
from .common import by_batch

WINDOW, MASK_BITS = 8, 7  # a cut each 128 code points on average
MEMO_BYTES = 64 << 20
WORD_MEMO = 200_000

_MULT = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(WINDOW)]
_WHITE = frozenset(vocab.WHITE)


def cuts(text: str) -> list[int]:
    """Cut places of a text: after each window of code points whose rolling hash ends in MASK_BITS zero bits."""
    if len(text) <= WINDOW:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(points) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h += points[k : k + n] * np.uint64(_MULT[k])
    h ^= h >> np.uint64(29)
    h *= np.uint64(_MULT[1])
    return [int(i) + WINDOW for i in np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) if i + WINDOW < len(text)]


class Encoder:
    def __init__(self, name: str):
        self.name, self.words, self.chunks, self.held = name, {}, {}, 0
        self.strings = vocab.word_merges(name)[1]

    def word(self, w: str) -> tuple[bytes, str]:
        found = self.words.get(w)
        if found is None:
            ids = vocab.word_ids(self.name, w)
            found = (array("I", ids).tobytes(), " ".join([self.strings[i] for i in ids]))
            if len(self.words) >= WORD_MEMO:
                self.words.clear()
            if len(w) <= 256:
                self.words[w] = found
        return found

    def chunk(self, text: str) -> tuple[bytes, str]:
        """ids and decoded form of a text whose ends are white space or the ends of a segment."""
        found = self.chunks.get(text)
        if found is None:
            parts = [self.word(w) for w in _split(text)]
            found = (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]]))
            size = 2 * len(text) + len(found[0]) + len(found[1]) + 200
            if self.held + size > MEMO_BYTES:
                self.chunks.clear()
                self.held = 0
            if size < MEMO_BYTES >> 6:
                self.chunks[text] = found
                self.held += size
        return found

    def segment(self, text: str) -> list[tuple[bytes, str]]:
        """Encodes a text without special strings chunk by chunk, repairing the joins."""
        out, pending, at = [], "", 0
        for end in [*cuts(text), len(text)]:
            piece = text[at:end]
            at = end
            # Repair: what precedes the first white space belongs to the pending join, what follows the last to the next.
            first = _first_white(piece)
            if first is None:
                pending += piece
                continue
            last = _last_white(piece)
            if pending or first:
                out.append(self.join(pending + piece[:first]))
            if last > first:
                out.append(self.chunk(piece[first:last]))
            pending = piece[last + 1 :]
        if pending:
            out.append(self.join(pending))
        return [x for x in out if x[0]]

    def join(self, text: str) -> tuple[bytes, str]:
        """A repaired join: the run between the nearest white space on either side of a cut, encoded again as a whole."""
        return self.word(text)

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of a whole text."""
        parts: list[tuple[bytes, str]] = []
        for piece in _specials(text):
            if piece in vocab.WORD_SPECIALS:
                parts.append((array("I", [vocab.library(self.name).token_to_id(piece)]).tobytes(), piece))
            else:
                parts += self.segment(piece)
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])


def _specials(text: str) -> list[str]:
    """The text cut at its special strings, in one pass."""
    return [x for x in _marks().split(text) if x]


@lru_cache(None)
def _marks():
    return re.compile("(" + "|".join(map(re.escape, vocab.WORD_SPECIALS)) + ")")


@lru_cache(None)
def _white():
    return re.compile(f"[{vocab.WHITE}]"), re.compile(f"[^{vocab.WHITE}]+")


def _first_white(text: str) -> int | None:
    m = _white()[0].search(text)
    return m.start() if m else None


def _last_white(text: str) -> int:
    i = len(text) - 1
    while text[i] not in _WHITE:
        i -= 1
    return i


def _split(text: str) -> list[str]:
    return _white()[1].findall(text)


@lru_cache(None)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def encode_chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = vocab.WORD_BPE, digests: bool = False) -> DataFrame:
    """id, ids (array of int) and decoded for every row; with digests, n_tokens and the SHA-256 of both instead.

    Null text is the empty text (no ids, empty decoding); special strings in a text are their single ids, as in the
    library; equal rows and null ids give a row each; an empty table gives none; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, a, b, c = encoder(tokenizer), [], [], []
        for i in range(batch.num_rows):
            ids, back = enc.encode(batch.column(1)[i].as_py() or "")
            if digests:
                a.append(len(ids) // 4)
                b.append(hashlib.sha256(ids).hexdigest())
                c.append(hashlib.sha256(back.encode()).hexdigest())
            else:
                b.append(np.frombuffer(ids, "<i4"))
                c.append(back)
        if digests:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(b, pa.list_(pa.int32())), pa.array(c, pa.string())], [id_col, "ids", "decoded"])

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return by_batch(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, {schema}")
