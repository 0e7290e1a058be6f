"""Public tokenizer files as fast encoders, loaded once a Python worker.

The byte-level BPE has one vocabulary in two libraries; its merges run in tiktoken, which is several times faster
and gives the same ids. The word BPE marks the last letter of a word by a suffix; the same merges run on bytes when
the suffix is written as a byte that UTF-8 never has.
"""

from __future__ import annotations

import json
from functools import lru_cache

import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

# The pre-token pattern of byte-level BPE (possessive form), and its special string and id.
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END_OF_TEXT, END_OF_TEXT_ID = "<|endoftext|>", 50256

# Fixed value: the code points that \s means in these libraries (White_Space of Unicode).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def path_of(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


@lru_cache(None)
def letter_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter; bytes that print stand for themselves, the others follow from 256."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(None)
def model_of(name: str) -> dict:
    with open(path_of(name), encoding="utf-8") as f:
        return json.load(f)["model"]


@lru_cache(None)
def library(name: str) -> Tokenizer:
    t = Tokenizer.from_file(path_of(name))
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(None)
def byte_ranks(name: str) -> dict[bytes, int]:
    to = letter_bytes()
    return {bytes(to[c] for c in token): i for token, i in model_of(name)["vocab"].items() if all(c in to for c in token) and i != END_OF_TEXT_ID}


@lru_cache(None)
def byte_encoder(name: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(f"codeloom-{name}", pat_str=BYTE_PATTERN, mergeable_ranks=byte_ranks(name), special_tokens={END_OF_TEXT: END_OF_TEXT_ID})


def byte_ids(name: str, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers; a special string in the text is its one id, as is the library's default."""
    enc = byte_encoder(name)
    return bytes(enc._core_bpe.encode_to_tiktoken_buffer(text, {END_OF_TEXT}))


@lru_cache(None)
def whole_tokens(name: str) -> frozenset[str]:
    """The vocabulary strings proven to encode alone as one token: each is one pre-token, and its merges end in its own id.

    A pre-token's encoding doesn't depend on what surrounds it, so such a string counts 1 wherever it is a pre-token.
    """
    enc = byte_encoder(name)
    proven = []
    for raw in byte_ranks(name):
        try:
            s = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        found = pre_tokens(s)
        if found == [s] and len(enc._core_bpe.encode_single_piece(raw)) == 1:
            proven.append(s)
    return frozenset(proven)


@lru_cache(None)
def _pre():
    return regex.compile(BYTE_PATTERN)


def pre_tokens(text: str) -> list[str]:
    return _pre().findall(text)


# The word BPE's pre-token pattern, its special strings, and the suffix of a word's last letter.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_SPECIALS = ("<|startoftext|>", "<|endoftext|>")
WORD_SUFFIX = "</w>"


@lru_cache(None)
def word_merges(name: str):
    """(merge function from a pre-token's UTF-8 bytes to ids, token strings by id)."""
    to, ranks, strings = letter_bytes(), {}, {}
    for token, i in model_of(name)["vocab"].items():
        strings[i] = token
        bare, mark = (token[: -len(WORD_SUFFIX)], b"\xff") if token.endswith(WORD_SUFFIX) else (token, b"")
        ranks[bytes(to[c] for c in bare) + mark] = i
    core = tiktoken.Encoding(f"codeloom-{name}", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return (lambda raw: core.encode_single_piece(raw + b"\xff")), strings


@lru_cache(None)
def _word():
    # Latin letters below U+0250 are stable under NFC and lower-case one by one; other words go through the library.
    return regex.compile(WORD_PATTERN), regex.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")


def word_ids(name: str, word: str) -> list[int]:
    """The ids of one white-space-free run of a text, which has no special string inside."""
    split, plain = _word()
    if not plain.fullmatch(word):
        return library(name).encode(word, add_special_tokens=False).ids
    merge, _ = word_merges(name)
    out: list[int] = []
    for p in split.findall("".join(map(str.lower, word)) if not word.isascii() else word.lower()):
        out += merge(p.encode())
    return out
