"""Sharding: every row once, gapless slots, sizes as near as rows allow, whatever the keys."""

import zlib

import pytest

import plain
from plumbline.llm import sharding
from plumbline.llm.queries import QUERIES
from plumbline.llm.sharding import shard_documents, write_shards

FOLDER = "/root/testdata/sf0.001"


def check(rows, texts, shards, spread):
    """``texts`` holds (id, text) of the input; sizes of the shards differ by less than ``spread``."""
    sound = lambda t: (t or "").encode()
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (repr(i), len(sound(t)) + 8, zlib.crc32(sound(t))) for i, t in texts)
    held = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r)
    assert set(held) <= set(range(shards))
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in held.values())
    sizes = [sum(r.size for r in held.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= spread
    return held


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = QUERIES["op12_sharding"](spark, FOLDER).collect()
    largest = max(len((t or "").encode()) + 8 for _, t in texts)
    check(rows, texts, 24, 2 * largest)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    assert sorted(rows) == sorted(QUERIES["op12_sharding"](spark, FOLDER).collect())


@pytest.mark.parametrize("few", [32, 2])
def test_near_equal_whatever_the_groups(spark, monkeypatch, few):
    monkeypatch.setattr(sharding, "FEW", few)
    table = spark.range(9000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a hot text' WHEN id % 7 = 0 THEN repeat('long ', 40) || id % 70 ELSE 'text ' || id % 2000 END AS text")
    texts = [(r.doc_id, r.text) for r in table.collect()]
    rows = shard_documents(table.repartition(13), 10).collect()
    mean = sum(r.size for r in rows) / 10
    held = check(rows, texts, 10, 2 * sharding.TOLERANCE * mean + 300)
    # Copies lie side by side: a text is cut by its shards' edges only, so all but nine are in one shard.
    shards = {}
    for own in held.values():
        for r in own:
            shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 9


def test_rows_alike_in_everything(spark):
    table = spark.range(6000).selectExpr("cast(NULL AS long) AS doc_id", "if(id % 3 > 0, 'same', cast(NULL AS string)) AS text")
    rows = shard_documents(table, 8).collect()
    check(rows, [(None, "same")] * 4000 + [(None, None)] * 2000, 8, 200)


def test_odd_documents(spark, tmp_path):
    table = plain.documents(spark)
    texts = list(enumerate(plain.TEXTS))
    rows = shard_documents(table, 3).collect()
    check(rows, texts, 3, 2 * max(len((t or "").encode()) for t in plain.TEXTS))
    odd = plain.with_odd_ids(spark)
    check(shard_documents(odd, 24).collect(), [tuple(r) for r in odd.collect()], 24, 100)
    assert shard_documents(table.limit(0), 24).collect() == []
    check(shard_documents(table, 1).collect(), texts, 1, 0)
    with pytest.raises(ValueError):
        shard_documents(table, 0)
    write_shards(table, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.select("row.*").columns == table.columns and sorted(r.row.doc_id for r in back.collect()) == list(range(len(texts)))
    assert {(r.shard, r.slot) for r in back.collect()} == {(r.shard, r.slot) for r in rows}
