"""Every id lies in one piece, sequences are full, ids are those of the library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import plain
from plumbline.llm.packing import TIERS, pack_documents, plan_windows, step_groups

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def check(rows, wanted):
    """rows: the pieces; wanted: ids by document."""
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_document) == set(wanted)
    for doc, pieces in by_document.items():
        pieces.sort(key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == wanted[doc]
        assert {r.doc_tokens for r in pieces} == {len(wanted[doc])}
        at = 0
        for r in pieces:
            assert r.start == at and r.length == len(r.ids) > 0
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
            at += r.length
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= pieces[0].tier <= 2048


def test_odd_documents(spark):
    rows = pack_documents(plain.documents(spark), PATH).collect()
    check(rows, dict(enumerate(expected(plain.TEXTS))))


def test_sample_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack_documents(docs, PATH).collect()
    check(rows, dict(zip(texts, expected(texts.values()))))
    used = sum(r.length for r in rows)
    sequences = {r.sequence_id: r.tier for r in rows}
    assert sum(sequences.values()) - used < TIERS[-1] * docs.rdd.getNumPartitions()


def test_repeated_and_missing_ids(spark):
    rows = pack_documents(plain.with_odd_ids(spark), PATH).collect()
    total = sum(len(e) for e in expected([r.text for r in plain.with_odd_ids(spark).collect()]))
    assert sum(r.length for r in rows) == total
    assert sum(r.doc_id is None for r in rows) >= 3


def test_empty_table(spark):
    assert pack_documents(plain.documents(spark).limit(0), PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_windows_hold_every_token_once(lengths):
    windows = plan_windows(lengths)
    seen = defaultdict(list)
    for w in windows:
        assert w.size in TIERS and w.used == sum(n for _, _, n in w.pieces) <= w.size
        for document, start, length in w.pieces:
            seen[document].append((start, length))
    for document, length in enumerate(lengths):
        at = 0
        for start, n in sorted(seen[document]):
            assert start == at
            at += n
        assert at == length
    assert sum(w.size for w in windows) - sum(lengths) < TIERS[-1]


def test_step_groups_are_balanced():
    sizes = [2048] * 9 + [1024] * 7 + [512] * 5 + [256] * 3
    groups = step_groups(sizes, 4096)
    total = defaultdict(int)
    for size, group in zip(sizes, groups):
        total[group] += size
    assert sorted(total) == list(range(len(total)))
    assert all(total[g] == 4096 for g in list(total)[:-1])
