"""The registered queries against SQL or plain versions, and the pipeline as a whole."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import plain
from compare import database, differences
from corpus_pipeline import STAGES, run
from plumbline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), database(FOLDER), ORACLES[name]) == []


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def test_simhash_query(spark, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_dedup"](spark, FOLDER).collect()}
    assert got == plain.near_groups(rows)


def test_embedding_query(spark):
    from test_learned import all_pairs

    vectors = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want = all_pairs(sorted(vectors))
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op4_embedding_dedup"](spark, FOLDER).collect()}
    assert got == want


def test_packing_query(spark, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in rows}
    pieces = QUERIES["op1_packing"](spark, FOLDER).collect()
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start: r.start + r.length].tobytes()) for r in pieces)


def test_pipeline(spark, rows):
    assert 4 <= len(STAGES) <= 5
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    texts = dict(rows)
    scores = {r.doc_id: r.predicted for r in QUERIES["op9_quality"](spark, FOLDER).collect()}
    kept = {d: t for d, t in rows if scores[d] == 1}
    last = {}
    for d, t in kept.items():
        body = t.translate(plain.LOWER)
        last[body] = max(d, last.get(body, d))
    kept = {d: kept[d] for d in last.values()}
    kept = {d: kept[d] for d, (_, component) in plain.near_groups(kept.items()).items() if d == component}
    cut = plain.without_windows(kept.items())
    final = {d: cut[d][2] if cut[d][1] else t for d, t in kept.items()}
    assert 0 < len(final) < len(texts)

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert got == {d: (t, len(t)) for d, t in final.items()}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = run(spark, FOLDER).collect()
    whole = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        whole.setdefault(r.doc_id, []).extend(r.ids)
    assert whole == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in final.items()}


def test_stages_with_odd_documents(spark, tmp_path):
    docs = plain.documents(spark)
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0), plain.with_odd_ids(spark)):
        rows = table
        for _, stage in STAGES[:-1]:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns == table.columns
        STAGES[-1][1](spark, rows, str(tmp_path)).collect()
