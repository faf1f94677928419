"""Phrases against counting all n-grams in plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

import plain
from plumbline.llm import phrases
from plumbline.llm.bytesops import Hashing
from plumbline.llm.phrases import collocations, frequent_phrases, phrase_blocks

COLLOCATIONS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counted(rows, longest=5):
    """(language -> words), (language, phrase) -> count."""
    words, counts = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(plain.LOWER)):
            tokens = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(tokens)
            for size in range(1, longest + 1):
                for i in range(len(tokens) - size + 1):
                    counts[lang, tuple(tokens[i: i + size])] += 1
    return words, counts


def wanted(rows, least, top):
    words, counts = counted(rows)
    frequent = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    found = {}
    for (lang, phrase), a in frequent.items():
        cuts = []
        for k in range(1, len(phrase)):
            l, r = counts[lang, phrase[:k]], counts[lang, phrase[k:]]  # noqa: E741
            cuts.append((1000 * a * words[lang] // (l * r), k, l, r))
        inside = any(
            other == lang and len(longer) > len(phrase) and f >= a
            and any(longer[i: i + len(phrase)] == phrase for i in range(len(longer) - len(phrase) + 1))
            for (other, longer), f in frequent.items()
        )
        if not inside:
            score, _, l, r = min(cuts)  # noqa: E741
            found.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, words[lang], -score)
        for lang, own in found.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(own)[:top], 1)
    )


def table(spark, rows):
    """With more columns, some of whose names the operator uses itself."""
    return spark.createDataFrame([(*r, i, "x", None, 2) for i, r in enumerate(rows)], "lang string, text string, n long, block string, phrase string, size int")


def odd_rows():
    rng = np.random.default_rng(5)
    vocabulary = ["The", "of", "a", "New", "york", "İx", "ß", "x\x1cy", "'quoted'", "ﬁ", "12", "日本"]
    rows = [(None if i % 5 == 0 else "en" if i % 2 else "de", " ".join(rng.choice(vocabulary, 40)) + (". " if i % 3 else ",\tnew  york city! ") * 3) for i in range(60)]
    rows += [("en", None), (None, None), ("en", ""), ("", " \t "), ("", "one one one one one one"), ("de", "...!?\n\r\x0b\x0c"), ("en", plain.LONG)]
    return rows + [(None, t) for t in plain.TEXTS] + [("en", "na " * 5000), ("en", "the same line of text here\n" * 300)]


def test_against_plain_counting(spark):
    rows = odd_rows()
    docs = table(spark, rows).repartition(5)
    for least, top in ((5, 40), (20, 2000)):
        got = sorted(tuple(r) for r in collocations(docs, least=least, top=top).select(COLLOCATIONS).collect())
        assert got == wanted(rows, least, top)


# With a few bits nearly all fingerprints stand for several phrases, inside blocks and between them.
@pytest.mark.parametrize("block, bits", [(1 << 20, 64), (2000, 64), (2000, 6), (20_000, 9)])
def test_phrases_of_all_lengths(spark, block, bits):
    rows = odd_rows()
    blocks = phrase_blocks(table(spark, rows).repartition(3), block_bytes=block)
    got = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in frequent_phrases(blocks, least=4, fingerprint_bits=bits).collect()}
    assert blocks.count() > (5 if block == 2000 else 2)
    assert got == {k: f for k, f in counted(rows)[1].items() if f >= 4}


class Poor(Hashing):
    """A hash with so few values that different words collide all the time."""

    def words(self, data, starts, ends):
        return super().words(data, starts, ends) % np.uint64(3)


def test_collisions_of_words_in_a_block(monkeypatch):
    monkeypatch.setattr(phrases, "_hashing", lambda seed=71: Poor(seed))
    text = " ".join(f"w{i % 13} v{i % 7}" for i in range(400)).encode()
    row = phrases._block(1, "en", [(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))])
    words = phrases.Words(row)
    tokens = text.decode().split(" ")
    for size in (1, 2, 3):
        found = words.counted(words.hashes(), size, np.arange(len(tokens) - size + 1), 64)
        got = {tuple(words.names[j - 1].decode() for j in words.stream[at: at + size]): n for at, n in zip((m & 0xFFFFFFFF for m in found["mark"].to_pylist()), found["n"].to_pylist())}
        assert len(found) == len(got) and got == Counter(tuple(tokens[i: i + size]) for i in range(len(tokens) - size + 1))


def test_nothing_frequent_and_empty(spark):
    docs = table(spark, [("en", "one two"), (None, None)])
    assert collocations(docs).collect() == [] and collocations(docs.limit(0)).collect() == []
    assert collocations(docs).columns == COLLOCATIONS


def test_exact_beyond_64_bits(spark):
    n, a, l, r = 9 * 10**15 + 7, 4 * 10**15 + 3, 5 * 10**15 + 9, 6 * 10**15 + 1  # noqa: E741
    row = spark.sql(f"""SELECT cast({a} AS decimal(38,0)) * cast({n} AS decimal(38,0)) * cast(1000 AS decimal(38,0))
        div (cast({l} AS decimal(38,0)) * cast({r} AS decimal(38,0))) AS score""").first()
    assert row.score == 1000 * a * n // (l * r)
