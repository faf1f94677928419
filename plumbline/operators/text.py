"""Free text: lengths, vocabulary, common words, lexicon sentiment. Built-ins only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.expressions import col, per_column, ratio, words
from plumbline.functions.lexicon import NEGATIVE_WORDS, POSITIVE_WORDS
from plumbline.operators.roles import detect_text_columns

HISTOGRAM_SCHEMA = "measure string, bin int, left double, right double, n bigint"


def text_columns(df: DataFrame, first: int | None = None) -> list[str]:
    """The columns of long text in column order, all or the first few."""
    found = detect_text_columns(df).orderBy("column_pos").collect()  # one row per column
    return [r["column"] for r in found][:first]


def text_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, avg/max/min words, avg/max/min chars) of the non-null texts."""
    columns = text_columns(df) if columns is None else list(columns)

    def n_words(c: str):
        return F.size(words(col(c).cast("string")))

    def n_chars(c: str):
        return F.length(col(c).cast("string"))

    # Counting the words once per row keeps the split out of the aggregate.
    counted = df.select(
        *[e for i, c in enumerate(columns)
          for e in (F.when(col(c).isNotNull(), n_words(c)).alias(f"w{i}"), n_chars(c).alias(f"c{i}"))]
    )
    at = {c: i for i, c in enumerate(columns)}
    return per_column(
        counted,
        columns,
        {
            "avg_words": lambda c: F.avg(f"w{at[c]}"),
            "max_words": lambda c: F.max(f"w{at[c]}"),
            "min_words": lambda c: F.min(f"w{at[c]}"),
            "avg_chars": lambda c: F.avg(f"c{at[c]}"),
            "max_chars": lambda c: F.max(f"c{at[c]}"),
            "min_chars": lambda c: F.min(f"c{at[c]}"),
        },
    )


# Stand for a text among its words, which hold no space: one with words, and one without.
WITH_WORDS, WITHOUT_WORDS = " ", "  "


def word_counts(df: DataFrame, columns: Sequence[str] | None = None, marks: bool = False) -> DataFrame:
    """(column, word, n) over all texts, words lower-cased; with ``marks`` also a mark for every text.

    Frequent words are added up on the map side, so the most common word costs
    one row per task in the shuffle.
    """
    columns = text_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, word string, n bigint")
    texts = F.array(
        *[
            F.struct(F.lit(c).alias("column"), words(F.lower(col(c).cast("string"))).alias("tokens"))
            for c in columns
        ]
    )
    tokens = F.col("tokens")
    if marks:
        tokens = F.array_append(tokens, F.when(F.size(tokens) > 0, WITH_WORDS).otherwise(WITHOUT_WORDS))
    return (
        df.select(F.inline(texts))
        .select("column", F.explode(tokens).alias("word"))
        .groupBy("column", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, unique_words, total_words, vocabulary_density, empty_ratio)."""
    columns = text_columns(df) if columns is None else list(columns)
    # One pass: every text counts as a mark beside its words.
    word, n = F.col("word"), F.col("n")
    is_word = ~word.isin(WITH_WORDS, WITHOUT_WORDS)
    counted = word_counts(df, columns, marks=True).groupBy("column").agg(
        F.count(F.when(is_word, 1)).alias("unique_words"),
        F.coalesce(F.sum(F.when(is_word, n)), F.lit(0)).alias("total_words"),
        ratio(F.sum(F.when(word == WITHOUT_WORDS, n).otherwise(0)), F.sum(F.when(~is_word, n))).alias("empty_ratio"),
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(counted), "column", "left").select(  # one row per column
        "column",
        F.coalesce("unique_words", F.lit(0)).alias("unique_words"),
        F.coalesce("total_words", F.lit(0)).alias("total_words"),
        ratio(F.col("unique_words"), F.col("total_words")).alias("vocabulary_density"),
        "empty_ratio",
    )


def common_words(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(column, word, n, rank): the k most common words, ties in word order."""
    best = W.partitionBy("column").orderBy(F.desc("n"), "word")
    return word_counts(df, columns).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def lexicon_sentiment(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, positive, negative, neutral, positive_words, negative_words).

    A text scores one for every lexicon word that it holds as a whole token,
    however often; punctuation is part of a token.
    """
    columns = text_columns(df) if columns is None else list(columns)
    positive = F.array(*[F.lit(w) for w in POSITIVE_WORDS])
    negative = F.array(*[F.lit(w) for w in NEGATIVE_WORDS])
    scored = df.select(
        *[words(F.lower(col(c).cast("string"))).alias(f"t{i}") for i, c in enumerate(columns)]
    ).select(
        *[
            e
            for i in range(len(columns))
            for e in (
                F.when(F.col(f"t{i}").isNotNull(), F.size(F.array_intersect(f"t{i}", positive))).alias(f"p{i}"),
                F.when(F.col(f"t{i}").isNotNull(), F.size(F.array_intersect(f"t{i}", negative))).alias(f"n{i}"),
            )
        ]
    )
    at = {c: i for i, c in enumerate(columns)}

    def share(compare):
        return lambda c: F.avg(compare(F.col(f"p{at[c]}"), F.col(f"n{at[c]}")).cast("double"))

    return per_column(
        scored,
        columns,
        {
            "positive": share(lambda p, n: p > n),
            "negative": share(lambda p, n: n > p),
            "neutral": share(lambda p, n: p == n),
            "positive_words": lambda c: F.avg(f"p{at[c]}"),
            "negative_words": lambda c: F.avg(f"n{at[c]}"),
        },
    )


def text_histograms(df: DataFrame, column: str | None = None, bins: int = 50) -> DataFrame:
    """(measure, bin, left, right, n): lengths in characters and in words of one
    text column, the first unless named; no rows without any."""
    if column is None:
        column = next(iter(text_columns(df, 1)), None)
    if column is None:
        return df.sparkSession.createDataFrame([], HISTOGRAM_SCHEMA)
    text = col(column).cast("string")
    measured = F.array(
        F.struct(F.lit("chars").alias("measure"), F.length(text).alias("length")),
        F.struct(F.lit("words").alias("measure"), F.size(words(text)).alias("length")),
    )
    # One row per measure and length: the texts are read and split only once.
    lengths = (
        df.where(text.isNotNull())
        .select(F.inline(measured))
        .groupBy("measure", "length")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    whole = W.partitionBy("measure")
    low, high = F.min("length").over(whole), F.max("length").over(whole)
    left_edge = F.when(low == high, low - 0.5).otherwise(low.cast("double"))
    width = F.when(low == high, F.lit(1.0)).otherwise((high - low).cast("double")) / bins
    binned = (
        lengths.select("measure", "length", "rows", left_edge.alias("start"), width.alias("width"))
        .withColumn("bin", F.least(F.floor((F.col("length") - F.col("start")) / F.col("width")), F.lit(bins - 1)))
        .groupBy("measure", "start", "width", "bin")
        .agg(F.sum("rows").alias("n"))
    )
    # Every bin appears: a zero row per bin and measure is added before the last sum.
    zeros = binned.select("measure", "start", "width").distinct().select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return (
        binned.select("measure", "start", "width", "bin", "n")
        .union(zeros)
        .groupBy("measure", "start", "width", "bin")
        .agg(F.sum("n").alias("n"))
        .select(
            "measure",
            F.col("bin").cast("int").alias("bin"),
            (F.col("start") + F.col("bin") * F.col("width")).alias("left"),
            (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("right"),
            "n",
        )
    )
