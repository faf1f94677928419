"""Cleaning: sparse columns, duplicate rows, values that are not numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.expressions import col, floating_columns, group_key

# Fixed value: a column with a larger share of missing values is dropped.
SPARSE_SHARE = 0.5


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    if name in floating_columns(df):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def drop_sparse_columns(df: DataFrame, threshold: float = SPARSE_SHARE) -> DataFrame:
    """Drop the columns whose share of missing values exceeds ``threshold``."""
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.when(missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    ).first()
    n_rows = row["n_rows"]
    sparse = [c for i, c in enumerate(df.columns) if row[f"m{i}"] > threshold * n_rows]
    return df.select(*[col(c) for c in df.columns if c not in sparse])


def dedup_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows; null equals null.

    Copies are merged on the map side before the shuffle, so a row repeated
    very often does not load one task.
    """
    return df.dropDuplicates()


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(n_rows, n_distinct, n_duplicates): rows beyond the first of each group.

    Long strings are grouped by digest, so texts themselves are not shuffled.
    """
    columns = list(columns or df.columns)
    groups = df.groupBy(*[group_key(df, c).alias(f"k{i}") for i, c in enumerate(columns)]).agg(
        F.count(F.lit(1)).alias("n")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("n").alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def nullify_infinite(df: DataFrame) -> DataFrame:
    """Replace infinities in floating columns by null."""
    return _replace(df, lambda x: x.isin(float("inf"), float("-inf")))


def nullify_nan(df: DataFrame) -> DataFrame:
    """Replace NaN in floating columns by null, the one marker of a missing value."""
    return _replace(df, F.isnan)


def _replace(df: DataFrame, unwanted) -> DataFrame:
    floats = set(floating_columns(df))
    return df.select(
        *[
            F.when(~unwanted(col(c)), col(c)).alias(c) if c in floats else col(c)
            for c in df.columns
        ]
    )


def clean(df: DataFrame) -> DataFrame:
    """Sparse columns out, duplicate rows out, then infinities to null."""
    kept = drop_sparse_columns(nullify_nan(df))
    return nullify_infinite(dedup_rows(kept))
