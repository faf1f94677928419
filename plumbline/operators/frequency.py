"""Frequency tables of many columns in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.expressions import (
    DIGEST_LENGTH,
    categorical_columns,
    col,
    group_key,
    ratio,
)

FREQUENCY_SCHEMA = "column string, column_pos int, value string, n bigint, rank int"


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_pos, key, value), one row per non-null cell."""
    cells = [
        F.struct(
            F.lit(i).alias("column_pos"),
            group_key(df, c).cast("string").alias("key"),
            col(c).cast("string").alias("value"),
        )
        for i, c in enumerate(columns)
    ]
    return df.select(F.inline(F.array(*cells))).where("key is not null")


def _named(columns: Sequence[str]):
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("column_pos") + 1)


def value_counts(
    df: DataFrame, columns: Sequence[str] | None = None, k: int | None = 10
) -> DataFrame:
    """(column, column_pos, value, n, rank): the k most frequent non-null values.

    Ties go to the smaller value. Counting pre-aggregates on the map side, and
    long texts are counted by digest. Only values as frequent as the k-th best
    can be among the k; their texts alone are looked up again and compared.
    ``k=None`` returns every value.
    """
    columns = categorical_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], FREQUENCY_SCHEMA)
    counts = _cells(df, columns).groupBy("column_pos", "key").agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        ranked = _with_texts(df, columns, counts).withColumn("rank", F.lit(None).cast("int"))
    else:
        by_count = W.partitionBy("column_pos").orderBy(F.desc("n"))
        least = (
            counts.withColumn("place", F.row_number().over(by_count)).where(F.col("place") <= k)
            .groupBy("column_pos").agg(F.min("n").alias("least"))
        )
        near = counts.join(F.broadcast(least), "column_pos").where("n >= least").drop("least")  # one row per column
        best = W.partitionBy("column_pos").orderBy(F.desc("n"), "value")
        ranked = (
            _with_texts(df, columns, near).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        )
    return ranked.select(_named(columns).alias("column"), "column_pos", "value", "n", "rank")


def _with_texts(df: DataFrame, columns: Sequence[str], counts: DataFrame) -> DataFrame:
    """Replace digests by the texts they stand for."""
    strings = [c for c in columns if dict(df.dtypes)[c] == "string"]
    if not strings:
        return counts.withColumnRenamed("key", "value")
    digests = counts.where(F.length("key") == DIGEST_LENGTH).select("column_pos", "key")
    # Each digest stands for one text; as a distinct it is reduced by hashing on the map side.
    texts = (
        _cells(df, columns).where(F.length("value") >= DIGEST_LENGTH)
        .join(digests, ["column_pos", "key"], "left_semi")
        .select("column_pos", "key", F.col("value").alias("text")).distinct()
    )
    return counts.join(texts, ["column_pos", "key"], "left").select(
        "column_pos", F.coalesce("text", "key").alias("value"), "n"
    )


def group_sizes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, column_pos, n_present, n_distinct, n_leading) of each column's values.

    Columns without any value are absent.
    """
    columns = categorical_columns(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, column_pos int, n_present bigint, n_distinct bigint, n_leading bigint"
        )
    return (
        _cells(df, columns)
        .groupBy("column_pos", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column_pos")
        .agg(F.sum("n").alias("n_present"), F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("n_leading"))
        .select(_named(columns).alias("column"), "column_pos", "n_present", "n_distinct", "n_leading")
    )


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Top values of every categorical column."""
    return value_counts(df, columns, k)


def value_shares(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(value, n, share): frequency over the number of non-null cells."""
    total = df.agg(F.count(col(column))).scalar()
    return value_counts(df, [column], k).select("value", "n", ratio(F.col("n"), total).alias("share"))
