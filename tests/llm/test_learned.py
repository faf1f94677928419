"""Embeddings against all pairs; the trained operators by held-out accuracy and by their definition."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plain
from plumbline.llm import embedding_dedup, lm_scoring
from plumbline.llm.embedding_dedup import MultiIndex, near_vector_groups
from plumbline.llm.lm_scoring import BIGRAM_WEIGHT, SMOOTHING, score_documents
from plumbline.llm.quality import drop_low_quality, score_quality, train_quality
from plumbline.llm.toxicity import OrdinalModel, grade_toxicity, severity_grades, train_toxicity, word_features

FOLDER = "/root/testdata/sf0.01"


def clusters(seed=1):
    random_ = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        for _ in range(12):
            centre = random_.normal(size=16)
            for _ in range(random_.integers(1, 12)):
                rows.append((label, centre + random_.normal(size=16) * random_.choice([0.02, 0.1, 0.2])))
    return [(i, [float(x) for x in v.astype(np.float32)], label) for i, (label, v) in enumerate(rows)]


def all_pairs(rows, similarity=0.98):
    unit = np.array([v for _, v, _ in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    label = np.array([k for _, _, k in rows])
    near = (unit @ unit.T >= similarity) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = plain.roots(len(rows), list(zip(*np.nonzero(near))))
    return {rows[i][0]: (int(near[i].sum()), rows[root[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("chunk", [2048, 5])
def test_vectors_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "VECTORS_PER_CELL", 4)
    rows = clusters()
    want = all_pairs(rows)
    odd = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [None] + [1.0] * 15, 0), (1004, [math.nan] * 16, 0),
           (1005, [math.inf] + [0.0] * 15, 0), (1006, rows[0][1], None), (1007, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vector_groups(table).collect()}
    for i, (links, component) in want.items():
        assert got[i] == (links, component, i == component)
    assert all(got[i] == (0, i, True) for i in range(1000, 1008))
    assert got[None] == (0, None, False)


def test_equal_and_repeated_vectors(spark):
    rows = [(i, [1.0, 0.0, 1.0], 1) for i in range(50)] + [(7, [1.0, 0.0, 1.0], 1), (60, [2.0, 0.0, 2.0], 1), (61, [1.0, 0.0, 1.0], 2)]
    got = near_vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert Counter((r.n_links, r.component_id) for r in got) == {(51, 0): 52, (0, 61): 1}


def test_pairs_of_chunks_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 4)
    vectors = spark.range(60).selectExpr("id AS vec_id", "array(1.0D, id / 1000.0D, 0.5D) AS embedding", "1 AS label")
    classes = vectors.selectExpr("vec_id AS node", "embedding AS vector", "cast(label AS string) AS label", "1L AS weight")
    plan = embedding_dedup._found(classes, 60, 1, 0.98, 0.9999)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(label#\d+, cell#\d+L, seek_chunk#\d+, held_chunk#\d+", plan)


def test_links_count_at_both_ends_if_one_end_asks():
    class Index:
        """Of the held vectors the last one does not visit the asking one's cell."""

        def cells(self, rows):
            return np.zeros(len(rows), dtype=np.int64)

        def visited(self, rows, cells, pairs):
            return pairs[0] < len(rows) - 1

    unit = np.array([1.0, 0.0]).tobytes()
    table = pa.table({"seeks": [True, False, False], "node": [5, 6, 7], "weight": [3, 1, 2], "vector": [unit] * 3})
    links = Counter()
    for row in embedding_dedup._compared(Index(), 0.98)(table).to_pylist():
        links[row["node"]] += row["links"]
    assert links == {5: 3, 7: 3, 6: 0}


def test_no_vectors(spark):
    assert near_vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_recall_of_the_index():
    """Neighbours at the limit of similarity, of vectors the index has not seen."""
    random_ = np.random.default_rng(8)
    rows = random_.normal(size=(3000, 32))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    index = MultiIndex(rows[:1500], 12, 0.98, 0.999)
    side = random_.normal(size=(1500, 32))
    side -= (side * rows[1500:]).sum(1)[:, None] * rows[1500:]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cells = index.cells(0.98 * rows[1500:] + math.sqrt(1 - 0.98**2) * side)
    visited = set(index.visits(rows[1500:]))
    assert np.mean([(i, c) in visited for i, c in enumerate(cells.tolist())]) > 0.99
    assert len(visited) < 0.5 * 1500 * 144
    order = [c for r, c in index.visits(rows[:1])]
    first, second = index.costs(rows[:1])
    cost = [first[0][c // 12] + second[0][c % 12] for c in order]
    assert cost == sorted(cost) and order[0] == index.cells(rows[:1])[0]


def test_language_models(spark):
    texts = ["a b a b c", "a b", "", None, "c c c", "b a", "z"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, part string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, 1), (4, 0), (99, 1), (None, 1), (5, None)], "doc_id long, quality int")
    good = {0, 2}
    tokens = [["<", *(t or "").split(), ">"] for t in texts]
    words = {w for t in tokens for w in t[1:]}

    def loss(doc, members):
        rest = [t for i, t in enumerate(tokens) if i in members and i != doc]
        uni = Counter(w for t in rest for w in t[1:])
        pairs = Counter(p for t in rest for p in zip(t, t[1:]))
        before = Counter(w for t in rest for w in t[:-1])
        out = 0.0
        for v, w in zip(tokens[doc], tokens[doc][1:]):
            base = (uni[w] + SMOOTHING) / (sum(uni.values()) + SMOOTHING * len(words))
            k = BIGRAM_WEIGHT if before[v] else 0.0
            out -= math.log2(k * pairs[v, w] / max(before[v], 1) + (1 - k) * base)
        return out / (len(tokens[doc]) - 1)

    got = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    for i in range(len(texts)):
        assert got[i].n_tokens == len(tokens[i]) - 1
        assert got[i].target_loss == pytest.approx(loss(i, good))
        assert got[i].background_loss == pytest.approx(loss(i, range(len(texts))))
        assert got[i].difference == pytest.approx(got[i].target_loss - got[i].background_loss)
    assert score_documents(docs.limit(0), labels).collect() == []
    assert score_documents(plain.documents(spark), labels.limit(0)).count() == len(plain.TEXTS)
    assert score_documents(plain.with_odd_ids(spark), labels).count() == 7


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, {r.doc_id: r for r in labels.collect()}


def test_messages_do_not_depend_on_the_number_of_parts():
    texts = pa.chunked_array([pa.array(["a few words of a short text", None])])
    block = lm_scoring.Block(pa.table({"id": pa.chunked_array([pa.array([1, 2], pa.int64())]), "text": texts}), pa.table({"id": pa.array([1], pa.int64())}))
    held = len(block.unigrams) + len(block.bigrams)
    assert len(block.messages(20)) <= held and len(block.messages(30)) == len(block.messages(40)) == held


def test_pairs_of_hashes():
    first, second = np.array([5, 1, 5, 5, 1], dtype=np.uint64), np.array([2, 9, 1, 2, 9], dtype=np.uint64)
    a, b, back = lm_scoring.distinct(first, second)
    assert (a.tolist(), b.tolist(), back.tolist()) == ([1, 5, 5], [9, 1, 2], [2, 0, 1, 2, 0])
    assert [x.tolist() for x in lm_scoring.distinct(first, first)] == [[1, 5], [1, 5], [1, 0, 1, 1, 0]]


def test_quality_of_held_out_rows(spark, sample):
    docs, labels, truth = sample
    got = score_quality(docs, train_quality(docs, labels, rows=2000)).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in held]) > 0.97


def test_quality_of_odd_documents(spark, sample):
    docs, labels, _ = sample
    model = train_quality(docs, labels, rows=300)
    odd = plain.documents(spark)
    scores = {r.doc_id: r.score for r in score_quality(odd, model).collect()}
    assert len(scores) == len(plain.TEXTS) and scores[0] == scores[1] == scores[2]
    assert scores[20] == scores[20] and scores[plain.TEXTS.index("same text")] == scores[len(plain.TEXTS) - 2]
    assert drop_low_quality(odd, model).columns == odd.columns
    # Without labels nothing is rejected; an empty table gives no rows.
    blank = train_quality(odd, labels.limit(0))
    assert drop_low_quality(odd, blank).count() == len(plain.TEXTS)
    assert score_quality(odd.limit(0), blank).collect() == []
    assert score_quality(plain.with_odd_ids(spark), blank).count() == 7


def test_toxicity_of_held_out_rows(spark, sample):
    docs, labels, truth = sample
    got = grade_toxicity(docs, train_toxicity(docs, labels)).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.severity <= 3 and r.toxic == (r.grade > 0) == (r.toxic_chance >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    harmless = [r for r in held if truth[r.doc_id].toxic == 0]
    assert np.mean([r.toxic for r in harmless]) < 0.01
    insult = {r.doc_id for r in docs.filter(F.lower("text").rlike("idiot|stupid|scum|moron")).collect()}
    caught = [r.toxic for r in held if r.doc_id in insult]
    assert len(caught) > 20 and np.mean(caught) > 0.8


def test_ordinal_model():
    """Weights are shared, thresholds rise, and more marker words mean a higher grade."""
    random.seed(1)
    texts, toxic = [], []
    for i in range(600):
        words = [f"w{random.randrange(60)}" for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[: 1 + i % 7] = random.choices(["vile", "nasty", "foul"], k=1 + i % 7)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    features, toxic = word_features(pa.array(texts)), np.array(toxic)
    grades = severity_grades(features, toxic)
    assert set(grades[toxic == 0]) == {0} and set(grades[toxic == 1]) == {1, 2, 3}
    model = OrdinalModel(features, grades)
    assert np.all(np.diff(model.threshold) >= 0)
    rest = " ".join(f"w{i}" for i in range(0, 60, 3))
    few, many, none = model.chances(pa.array([f"vile foul {rest}", f"vile nasty foul nasty vile foul {rest}", rest]))
    assert none.sum() < few.sum() < many.sum()
    assert few[0] > 0.5 > none[0]


def test_toxicity_of_odd_documents(spark):
    labels = spark.createDataFrame([(0, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    docs = plain.documents(spark)
    for some in (labels, labels.limit(0)):
        got = grade_toxicity(docs, train_toxicity(docs, some)).collect()
        assert len(got) == len(plain.TEXTS)
    assert not any(r.toxic for r in got)
    assert grade_toxicity(docs.limit(0), train_toxicity(docs, labels)).collect() == []
