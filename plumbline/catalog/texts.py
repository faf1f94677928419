"""Catalogue: free text."""

from __future__ import annotations

from plumbline.catalog.base import Query, r, rounded, union
from plumbline.functions.lexicon import NEGATIVE_WORDS, POSITIVE_WORDS
from plumbline.operators import text

# The white space of the word rule, as a character class of the checking engine.
SPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def tokens(column: str) -> str:
    return f"list_filter(string_split_regex({column}, '{SPACE}+'), lambda w: w <> '')"


# The same texts in two tables: long documents and short turns.
TEXTS = [("documents", "text"), ("conversations", "text")]


def _both(load, make):
    parts = [make(load(table), [column]).drop("column", "column_pos") for table, column in TEXTS]
    return parts[0].unionByName(parts[1])


TEXT_STATS = union(["documents", "conversations"], lambda i, t: (
    f"SELECT {r('avg(w)', 5)} AS avg_words, CAST(max(w) AS BIGINT) AS max_words, CAST(min(w) AS BIGINT) AS min_words, "
    f"{r('avg(c)', 5)} AS avg_chars, CAST(max(c) AS BIGINT) AS max_chars, CAST(min(c) AS BIGINT) AS min_chars "
    f"FROM (SELECT len({tokens('text')}) AS w, length(text) AS c FROM {t} WHERE text IS NOT NULL)"
))

EMPTY = r(f"avg(CASE WHEN len({tokens('text')}) = 0 THEN 1.0 ELSE 0.0 END)")
VOCABULARY = union(["documents", "conversations"], lambda i, t: (
    f"SELECT count(DISTINCT w) AS unique_words, count(w) AS total_words, {r('count(DISTINCT w) / count(w)')} AS vocabulary_density, "
    f"(SELECT {EMPTY} FROM {t}) AS empty_ratio "
    f"FROM (SELECT unnest({tokens('lower(text)')}) AS w FROM {t})"
))

COMMON = f"""
SELECT 'text' AS "column", w AS word, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, w) AS rank
FROM (SELECT unnest({tokens('lower(text)')}) AS w FROM documents) GROUP BY w QUALIFY rank <= 10"""


def _list(found: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in found) + "]"


SENTIMENT = union(["documents", "conversations"], lambda i, t: (
    f"SELECT {r('avg(CASE WHEN p > n THEN 1.0 ELSE 0.0 END)')} AS positive, {r('avg(CASE WHEN n > p THEN 1.0 ELSE 0.0 END)')} AS negative, "
    f"{r('avg(CASE WHEN p = n THEN 1.0 ELSE 0.0 END)')} AS neutral, {r('avg(p)')} AS positive_words, {r('avg(n)')} AS negative_words "
    f"FROM (SELECT len(list_intersect({tokens('lower(text)')}, {_list(POSITIVE_WORDS)})) AS p, "
    f"len(list_intersect({tokens('lower(text)')}, {_list(NEGATIVE_WORDS)})) AS n FROM {t} WHERE text IS NOT NULL)"
))


def _lengths(measure: str, expression: str) -> str:
    return f"""SELECT '{measure}' AS measure, CAST(b.bin AS BIGINT) AS bin, {r('lo + b.bin * ((hi - lo) / 50)', 4)} AS "left",
  {r('lo + (b.bin + 1) * ((hi - lo) / 50)', 4)} AS "right", coalesce(n, 0) AS n
FROM (SELECT generate_series AS bin FROM generate_series(0, 49)) b
CROSS JOIN (SELECT min({expression}) AS lo, max({expression}) AS hi FROM documents) e
LEFT JOIN (
  SELECT least(CAST(floor((x - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin, count(*) AS n
  FROM (SELECT {expression} AS x FROM documents), (SELECT min({expression}) AS lo, max({expression}) AS hi FROM documents)
  GROUP BY 1) c ON c.bin = b.bin"""


LENGTHS = _lengths("chars", "length(text)") + "\nUNION ALL\n" + _lengths("words", f"len({tokens('text')})")

QUERIES = [
    Query("text_stats", lambda load: rounded(_both(load, text.text_stats), 5), TEXT_STATS),
    Query("vocabulary_stats", lambda load: rounded(_both(load, text.vocabulary_stats)), VOCABULARY),
    Query("common_words", lambda load: rounded(text.common_words(load("documents"), ["text"])), COMMON),
    Query("lexicon_sentiment", lambda load: rounded(_both(load, text.lexicon_sentiment)), SENTIMENT),
    Query(
        "text_histograms",
        lambda load: rounded(text.text_histograms(load("documents")), 4),
        LENGTHS,
    ),
]
