"""The encoder against the tiktoken library, and back."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import plain
from plumbline.llm.byte_bpe import PATTERN, ByteTokenizer, decode_documents, encode_documents, load_ranks
from plumbline.llm.bytesops import text_bytes

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def test_pattern_is_that_of_the_vocabulary():
    assert PATTERN == public_tokenizers.PATTERN


def test_documents(spark, library):
    docs = plain.documents(spark)
    encoded = encode_documents(docs, PATH)
    got = {r.doc_id: (r.n_tokens, r.ids) for r in encoded.collect()}
    want = {i: library.encode_ordinary(t or "") for i, t in enumerate(plain.TEXTS)}
    assert got == {i: (len(ids), ids) for i, ids in want.items()}
    back = {r.doc_id: bytes(r.decoded) for r in decode_documents(encoded, PATH).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(plain.TEXTS)}


def test_digests(spark, library):
    docs = plain.documents(spark)
    for r in encode_documents(docs, PATH, digests=True).collect():
        text = plain.TEXTS[r.doc_id] or ""
        assert r.ids_sha256 == plain.sha(np.array(library.encode_ordinary(text), dtype="<u4").tobytes())
        assert r.decoded_sha256 == plain.sha(text)


def test_odd_ids_and_empty_table(spark):
    assert sorted(r.n_tokens for r in encode_documents(plain.with_odd_ids(spark), PATH).collect())[0] == 0
    assert encode_documents(plain.documents(spark).limit(0), PATH).collect() == []


def test_random_texts(library):
    random.seed(3)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "l", "é", "É", "×", "1", "23", ".", "!!", "日", "\x1c", "\x85", " ", "²", "́", "😀", "\x00", "_", "re"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, " " * 2000 + "x", "\n" * 50]
    tokenizer = ByteTokenizer(load_ranks(PATH))
    tokenizer.memo.most = 500  # the memory starts anew many times
    data, bounds = text_bytes(pa.array(texts))
    for i in range(0, len(texts), 400):
        j = min(i + 400, len(texts))
        ids, at = tokenizer.encode(data[bounds[i]:bounds[j]], bounds[i: j + 1] - bounds[i])
        for k in range(i, j):
            assert ids[at[k - i]: at[k - i + 1]].tolist() == library.encode_ordinary(texts[k])
        assert tokenizer.decode(ids).tobytes() == data[bounds[i]:bounds[j]].tobytes()


def test_small_vocabulary_steps_back():
    """Longest tokens first would end in a dead end or in merges out of order."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260, b"bcd": 261}
    own = ByteTokenizer(ranks).pairs
    library = tiktoken.Encoding("small", pat_str=r"[a-d]+", mergeable_ranks=ranks, special_tokens={})
    random.seed(1)
    for _ in range(500):
        text = "".join(random.choices("abcd", k=random.randint(1, 12)))
        assert own.encode_piece(text.encode()) == library.encode_ordinary(text)
