"""Plain versions of the operators, one row at a time, to test against."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# Texts with everything that may be odd: null, empty, blank, long, repeated, unusual characters.
LONG = " ".join(f"word{i % 97} and{i % 31}" for i in range(6000))
PASSAGE = " ".join(f"passage{i}" for i in range(30))
LINE = "A line of text that is shared by many documents, word for word."
TEXTS = [
    None, "", "   \n\t ", "one", "two words", "Three Words Here", "three words here", LONG, LONG.upper(), PASSAGE,
    "before " + PASSAGE + " after", PASSAGE + " " + PASSAGE, "it's a 'quoted' text. Don't! 12,345 and ½ of İstanbul",
    "日本語 のテキスト … ×÷ é É", "a" * 5000, "na " * 300, "x\x1cy\x85z w <|endoftext|> end",
    *[f"start {i}\n  {LINE if i % 2 else LINE.upper()}  \nend {i}\n{LINE}" for i in range(7)],
    LINE + "\n" + LINE, "\n\n", "same text", "same text", "SAME text",
]


def documents(spark, texts=TEXTS):
    """Documents with nulls and repeats in every column and with names that operators use themselves."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else f"src{i % 2}", None if t is None else len(t), i, "x", None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, id long, row string, block string, hash int"
    )


def with_odd_ids(spark):
    """Rows repeated as a whole, an id with two texts, null ids."""
    rows = [(1, "alpha beta"), (1, "alpha beta"), (2, "alpha beta"), (2, "other text"), (None, "alpha beta"), (None, None), (None, "lonely")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def roots(n: int, pairs) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i: i + shingle]), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows, distance: int = 3) -> dict:
    """doc_id -> (fingerprint, smallest id of the component); ids are unique."""
    rows = sorted(rows)
    marks = np.array([fingerprint(t) for _, t in rows], dtype=np.uint64)
    pairs = [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(marks[i] ^ marks) <= distance) if j > i]
    root = roots(len(rows), pairs)
    return {rows[i][0]: (format(int(marks[i]), "016x"), rows[root[i]][0]) for i in range(len(rows))}


def without_windows(rows, size: int = 20) -> dict:
    """doc_id -> (words, removed words, kept text); ids are unique."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = np.zeros(len(words), dtype=bool)
        for i in range(len(words) - size + 1):
            window = tuple(words[i: i + size])
            if window in seen:
                gone[i: i + size] = True
            seen.add(window)
        out[doc] = (len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def without_lines(rows, min_length: int = 40, min_docs: int = 5) -> dict:
    """doc_id -> (lines, dropped lines, kept text); ids are unique."""
    holders = defaultdict(set)
    split = {doc: [(line, line.strip(" \t\n\v\f\r").translate(LOWER)) for line in (text or "").split("\n")] for doc, text in rows}
    for doc, lines in split.items():
        for _, key in lines:
            if len(key) >= min_length:
                holders[key].add(doc)
    out = {}
    for doc, lines in split.items():
        kept = [line for line, key in lines if len(holders.get(key, ())) < min_docs or max(holders[key]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out
