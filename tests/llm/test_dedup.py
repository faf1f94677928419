"""Exact, line, substring and SimHash deduplication against plain versions."""

import random

import pytest

import plain
from plumbline.llm import exact_dedup, simhash_dedup
from plumbline.llm.components import connected_components
from plumbline.llm.exact_dedup import content_groups, drop_exact_duplicates
from plumbline.llm.line_dedup import LineRuns, drop_repeated_lines, keyed_lines
from plumbline.llm.simhash_dedup import drop_near_duplicates, link_fingerprints, near_duplicate_groups
from plumbline.llm.substring_dedup import remove_repeated_windows

ROWS = list(enumerate(plain.TEXTS))


def test_exact_groups(spark, monkeypatch):
    want = {}
    for i, t in ROWS:
        want.setdefault((t or "").translate(plain.LOWER), []).append(i)
    for least in (50, 1):  # with ranges of one row every repeated text is salted
        monkeypatch.setattr(exact_dedup, "LEAST_RANGE", least)
        got = {r.doc_id: r for r in content_groups(plain.documents(spark), keep="largest").collect()}
        assert len(got) == len(ROWS)
        for body, members in want.items():
            for i in members:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(members), len(members), i == max(members), plain.sha(body))


def test_exact_keeps_the_smallest_with_all_columns(spark):
    docs = plain.documents(spark)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    first = {}
    for i, t in ROWS:
        first.setdefault((t or "").translate(plain.LOWER), i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_exact_with_a_hot_text(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Hot text', concat('text ', id % 1500)) AS text")
    got = content_groups(docs, keep="largest").collect()
    hot = [r for r in got if r.doc_id % 3 == 0]
    assert {(r.keep_id, r.group_size) for r in hot} == {(5997, 2000)}
    assert [r.doc_id for r in hot if r.kept] == [5997]
    assert len(got) == 6000


def test_exact_with_odd_ids(spark):
    got = content_groups(plain.with_odd_ids(spark), keep="largest").collect()
    alpha = [r for r in got if r.text_sha256 == plain.sha("alpha beta")]
    assert len(got) == 7 and {(r.keep_id, r.group_size) for r in alpha} == {(2, 4)}
    assert sum(r.kept for r in alpha) == 1
    assert all(r.kept and r.group_size == 1 for r in got if r not in alpha)


def test_lines(spark):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in drop_repeated_lines(plain.documents(spark)).collect()}
    assert got == plain.without_lines(ROWS)
    assert sum(v[1] for v in got.values()) > 10


def test_lines_with_odd_ids(spark):
    rows = [(i, f"{plain.LINE}\nrest {i}") for i in (1, 2, 3, 3, 4, 5, None)]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (5, 0)]


def test_runs_hold_every_hash_once(spark):
    store = LineRuns(fanout=2)
    lines = spark.range(400).selectExpr("id AS doc_id", "1L AS text_hash", "0 AS place", "id % 90 AS h1", "id % 90 AS h2").cache()
    for i in range(5):
        store.add(lines.filter(f"doc_id % 5 = {i}"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    held = [r.h1 for run in store.runs() for r in run.collect()]
    assert sorted(held) == list(range(90))
    assert {(r.h1, r.n_docs, r.last_id) for r in store.common(5).collect()} == {
        (h, 5, h + 360) for h in range(40)
    }


def test_windows(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_windows(plain.documents(spark)).collect()}
    assert got == plain.without_windows(ROWS)
    assert sum(v[1] for v in got.values()) > 100


def test_windows_of_random_words(spark):
    """Few words and short windows: many windows overlap and repeat."""
    random.seed(5)
    rows = [(i, " ".join(random.choices("abc", k=random.randint(0, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4, 7):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_windows(docs, window=size).collect()}
        assert got == plain.without_windows(rows, size)


def test_windows_with_odd_ids(spark):
    rows = [(1, plain.PASSAGE), (1, plain.PASSAGE), (None, "own " + plain.PASSAGE), (-5, "x " + plain.PASSAGE)]
    got = remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(-5, 30), (0, 0), (1, 30), (1, 30)]


def test_fingerprint_groups(spark, monkeypatch):
    random.seed(9)
    base = [f"w{random.randrange(5000)}" for _ in range(400)]
    texts = list(plain.TEXTS)
    for _ in range(40):  # near copies
        copy = list(base)
        for _ in range(random.randint(0, 3)):
            copy[random.randrange(400)] = "changed"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    want = plain.near_groups(rows)
    for chunk in (1024, 3):
        monkeypatch.setattr(simhash_dedup, "CHUNK", chunk)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicate_groups(plain.documents(spark, texts)).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) < len(texts) - 20
    docs = plain.documents(spark, texts)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_links_of_random_fingerprints(spark):
    """Clusters of fingerprints a few bits around a centre: components equal those of all pairs."""
    random.seed(2)
    marks = set()
    for _ in range(30):
        centre = random.getrandbits(64)
        for _ in range(15):
            mark = centre
            for b in random.sample(range(64), random.randint(0, 4)):
                mark ^= 1 << b
            marks.add(mark)
    marks = sorted(marks)
    root = plain.roots(len(marks), [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3])
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    links = link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    at = {s: i for i, s in enumerate(signed)}
    assert plain.roots(len(marks), [(at[r.a], at[r.b]) for r in links]) == root


def test_fingerprints_with_odd_ids(spark):
    got = near_duplicate_groups(plain.with_odd_ids(spark)).collect()
    assert len(got) == 7
    alpha = [r.component_id for r in got if r.fingerprint == format(plain.fingerprint("alpha beta"), "016x")]
    assert alpha == [1] * 4


@pytest.mark.parametrize("operator", [content_groups, drop_repeated_lines, remove_repeated_windows, near_duplicate_groups, drop_exact_duplicates, drop_near_duplicates])
def test_empty_table(spark, operator):
    assert operator(plain.documents(spark).limit(0)).collect() == []


def test_keyed_lines_of_null_text(spark):
    assert keyed_lines(plain.documents(spark, [None, ""]), "doc_id", "text", 0).count() == 2


def test_components(spark):
    random.seed(4)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = plain.roots(1100, pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs + [(None, 5)], "a long, b long")).collect()}
    assert got == {n: root[n] for p in pairs if p[0] != p[1] for n in p}
