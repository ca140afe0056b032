"""Byte-level BPE, token counts and packing against the libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from spotweave.llm import bytebpe, packing, wordbpe

TEXTS = [
    None, "", "a", " ", "\n\n", "The cat's hat; it'll rain, DON'T go.", "a  b\t c \n d ", "é ü ß Ñ ï İstanbul ſ K", "é café a̧", "x\x00y \x00", "\x1c a\x1cb",
    "<|endoftext|> x <|startoftext|>y<|endoftext|>", "<|endoftext", "你好 世界 😀👨‍👩‍👧", "aaaa aaaaaa " * 400, "z" * 3000, "a b", "12 345 ٣٤ ½ ②", "ΑΣ ΟΔΟΣ Σ", "thanedble thanedble erin", "thanedble thanedble erin",
]


def frame(spark):
    return spark.createDataFrame([(i if i % 7 else None, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, length int").repartition(2)


def test_bytes(spark):
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bytebpe.encode_documents(frame(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()
    want = []
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        want.append((i if i % 7 else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    table = bytebpe.PerfectHash(keys)
    assert sorted(table.slot_key) == list(range(3000))
    assert (table.find(keys) == np.arange(3000)).all()
    assert (table.find([b"", b"x", b"30000", b"12 "]) == -1).all()


def test_counts(spark):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = wordbpe.count_tokens(frame(spark), P.path("word_bpe_49k.json")).collect()
    want = []
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i if i % 7 else None, len((t or "").encode()), n, n > 2048))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_merging_takes_every_second_of_a_run():
    bpe = wordbpe.WordBPE(P.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)]
    symbols, counts = bpe.merge([w.encode() for w in words])
    at = 0
    for w, n in zip(words, counts, strict=True):
        assert symbols[at : at + n].tolist() == library.encode(w, add_special_tokens=False).ids
        at += n


@pytest.mark.parametrize("sequence", [4096, 8])
def test_packing(spark, sequence):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack(frame(spark), P.path("word_bpe_49k.json"), sequence=sequence, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    assert all(r.offset == 0 and r.length == 1 << r.bucket <= sequence and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS)
    whole, at = [], None
    for r in sorted(got, key=lambda r: r.sequence_id):
        at = [] if r.start == 0 else at
        assert r.start == len(at)
        at += r.ids
        if len(at) == r.doc_tokens:
            whole.append(list(at))
    assert sorted(whole) == want


def test_piece_lengths():
    for n in range(1, 300):
        sizes = packing.piece_lengths(n, 64)
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and all(s & (s - 1) == 0 and s <= 64 for s in sizes)
        assert len(set(s for s in sizes if s < 64)) == sum(s < 64 for s in sizes)
    with pytest.raises(ValueError):
        packing.piece_lengths(5, 48)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, P.path("word_bpe_49k.json")).count() == 0
    assert wordbpe.count_tokens(none, P.path("word_bpe_49k.json")).count() == 0
    assert bytebpe.encode_documents(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def random_texts(n, seed=3):
    """Texts of random code points, of few letters, and of random words, some of them alike."""
    rng = np.random.default_rng(seed)
    kinds = ["aeinrst ", "ab ", "'sltd 019.,!?\n\t", "éüßñçœ İıſ", "中文字符 абв", "😀👍🏽‍́ \x00", "<|endoftext|>"]
    out = []
    for _ in range(n):
        alphabet = "".join(kinds[i] for i in rng.integers(0, len(kinds), 2))
        out.append("".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(0, 200)))))
    return out + out[: n // 4]


def test_random_texts_against_the_libraries(spark):
    """Random and repeated rows, and one text longer than a block, through all three operators."""
    texts = [*random_texts(300), "word other " * 450_000]
    docs = spark.createDataFrame([(i % 250, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    counts = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sorted((r.doc_id, r.n_tokens) for r in wordbpe.count_tokens(docs, P.path("word_bpe_49k.json")).collect()) == sorted((i % 250, n) for i, n in enumerate(counts))
    packed = packing.pack(docs, P.path("word_bpe_49k.json")).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {k: sum(n + 1 for i, n in enumerate(counts) if i % 250 == k) for k in range(250)}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bytebpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = [(i % 250, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, ids in enumerate(map(tik.encode_ordinary, texts))]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == sorted(want)


def test_pieces_of_many_counts():
    counts = np.array([0, 1, 2, 3, 63, 64, 65, 128, 1000])
    size, pieces = packing.all_pieces(counts, 64)
    want = [packing.piece_lengths(n, 64) for n in counts.tolist()]
    assert size.tolist() == sum(want, []) and pieces.tolist() == list(map(len, want))


def test_encoder_with_a_memory_too_small():
    """Trimming, long words and pre-tokens shared by words do not change ids."""
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    encoder = packing.Encoder(P.path("word_bpe_49k.json"), memory=40)
    texts = [*random_texts(60, seed=9), "x" * 900, "it's it it's 's", "<|endoftext|>a<|ENDOFTEXT|>"]
    for _ in range(2):
        for k in range(0, len(texts), 5):
            ids, counts = encoder.encode_batch(texts[k : k + 5])
            want = [library.encode(t, add_special_tokens=False).ids for t in texts[k : k + 5]]
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert len(encoder.codes) < 40 + 400
