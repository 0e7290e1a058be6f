import hashlib
import random
from array import array

from codeloom.llm import chunk_bpe, packing, token_counts, vocab

ODD = [
    "", " ", "\n\n", "<|endoftext|>", " a  b\n\n c ", "x<|endoftext|> y<|startoftext|><|endoftext|>", "日本語のテキスト  と ΣΑΣ İstanbul", "a" * 3000, "  \t\x1c!\x1c a\x85b\xa0c", "don't we'll I'M 12345 ½ é ́x 한국어 🎉🎉x",
    "​ zero em 　 \n \n  x", "'s's't  's", "é" * 300, "\u0000\u0001", "<|endoftext|", "näive Å ﬁ",
]


def texts(n=150):
    rng = random.Random(4)
    pieces = ["the ", "Thing", "'s", " ", "\n", "  ", "été", "1234", "!!", "\t", " ", "ß", "<|endoftext|>", "_x", "ing", "　", "ﬃ", "Σ", "http://a.b/c?d=1", "longwordwithoutanyspace" * 8]
    return ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 200))) for _ in range(n)]


def test_counts_and_ids_equal_the_library():
    t = texts()
    for text, e in zip(t, vocab.library(vocab.BYTE_BPE).encode_batch(t, add_special_tokens=False), strict=True):
        assert token_counts.count_tokens(text) == len(e.ids)
        assert vocab.byte_ids(vocab.BYTE_BPE, text) == array("I", e.ids).tobytes()


def test_whole_tokens_are_single_tokens():
    whole = sorted(vocab.whole_tokens(vocab.BYTE_BPE))
    assert len(whole) > 40_000
    some = whole[::37]
    assert all(len(e.ids) == 1 for e in vocab.library(vocab.BYTE_BPE).encode_batch(some, add_special_tokens=False))


def test_chunked_encoding_equals_the_library(monkeypatch):
    t = texts()
    library = vocab.library(vocab.WORD_BPE)
    for bits in (7, 2):
        monkeypatch.setattr(chunk_bpe, "MASK_BITS", bits)
        enc = chunk_bpe.Encoder(vocab.WORD_BPE)
        for text, e in zip(t, library.encode_batch(t, add_special_tokens=False), strict=True):
            ids, back = enc.encode(text)
            assert ids == array("I", e.ids).tobytes(), text
            assert back == library.decode(e.ids, skip_special_tokens=False)


def test_shared_passages_share_chunks():
    passage = " ".join(f"word{i}" for i in range(400))
    enc = chunk_bpe.Encoder(vocab.WORD_BPE)
    enc.encode("one start " + passage)
    before = len(enc.chunks)
    enc.encode("another, longer start of a text " + passage)
    assert len(enc.chunks) - before <= 4


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(chunk_bpe, "WORD_MEMO", 50)
    enc = chunk_bpe.Encoder(vocab.WORD_BPE)
    for i in range(200):
        enc.encode(" ".join(f"w{i}x{k}" for k in range(50)))
        assert enc.held <= 20_000 and len(enc.words) <= 50


def test_rows(spark):
    rows = [(1, None, 9), (1, "a b", 8), (None, "", 7), (2, "word " * 1100, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in token_counts.token_counts(df).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (1, 3, 2, False), (None, 0, 0, False), (2, 5500, 1101, True)], key=str)
    coded = chunk_bpe.encode_chunked(df, digests=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sum(r["ids_sha256"] == empty == r["decoded_sha256"] and r["n_tokens"] == 0 for r in coded) == 2
    plain = {(r["doc_id"], r["decoded"]) for r in chunk_bpe.encode_chunked(df.limit(2)).collect()}
    assert plain == {(1, ""), (1, "a</w> b</w>")}
    for f in (token_counts.token_counts, chunk_bpe.encode_chunked, packing.pack):
        assert f(df.limit(0)).count() == 0


def test_packing_keeps_every_token_once(spark):
    import zlib

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "thing", "été", "longword"]) for _ in range(rng.choice([0, 1, 5, 40, 300, 2047, 2100, 5000])))) for i in range(120)] + [(500, None), (None, "x"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = packing.pack(df, windows=4).collect()
    sequences, docs = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    assert sum(r["length"] for r in got) == sum(len(vocab.byte_ids(vocab.BYTE_BPE, t or "")) // 4 + 1 for _, t in rows)
    for i, t in rows:
        ids = vocab.byte_ids(vocab.BYTE_BPE, t or "") + (1).to_bytes(4, "little")
        own = sorted(docs[(i, len(ids) // 4)], key=lambda r: r["start"])
        assert all(any(zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for r in own if r["start"] == s) for s in {r["start"] for r in own})
    least = -(-sum(r["length"] for r in got) // packing.WINDOW)
    assert len(sequences) <= 1.1 * least + 2
    assert packing.padded(512) == 512 and packing.padded(513) == packing.WINDOW
