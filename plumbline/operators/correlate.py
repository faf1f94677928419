"""Pairwise-complete Pearson correlation and what is read from it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.expressions import number, numeric_columns, per_column, ratio

MATRIX_SCHEMA = "var1 string, var2 string, pos1 int, pos2 int, r double"
# Thresholds on abs(r).
STRONG, REDUNDANT, NOTABLE, NEAR_IDENTICAL = 0.5, 0.8, 0.3, 0.95


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, impute: bool = False
) -> DataFrame:
    """(var1, var2, pos1, pos2, r) for all ordered pairs, the diagonal included.

    A first scan finds means and null counts; a second one adds up products of
    centred values, which is stable and cheaper than one covariance aggregate
    per pair. Only pairs with a nullable side need sums of their own. r is null
    for a constant column. ``impute=True`` correlates mean-imputed columns.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], MATRIX_SCHEMA)
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[e for i, c in enumerate(columns)
          for e in (F.avg(number(c)).alias(f"mean{i}"), F.count(number(c)).alias(f"n{i}"),
                    F.min(number(c)).alias(f"lo{i}"), F.max(number(c)).alias(f"hi{i}"))],
    ).first()
    n, p = first["n"], len(columns)
    means = [first[f"mean{i}"] for i in range(p)]
    varied = [first[f"n{i}"] > 0 and first[f"lo{i}"] < first[f"hi{i}"] for i in range(p)]

    # Centred columns; a constant one is left out, as rounding could make its sum of squares positive.
    centred = df.select(*[
        _centred(c, means[i], impute, varied[i]).alias(f"x{i}") for i, c in enumerate(columns)
    ])
    sums = _block_sums(centred, p)
    names = F.array(*[F.lit(c) for c in columns])
    half = sums.select(
        "i", "j", _pearson(F.col("sxy"), F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.col("n")).alias("r")
    )
    both = half.union(half.where("i < j").select(F.col("j"), F.col("i"), "r"))
    return both.select(
        F.element_at(names, F.col("i") + 1).alias("var1"),
        F.element_at(names, F.col("j") + 1).alias("var2"),
        F.col("i").alias("pos1"),
        F.col("j").alias("pos2"),
        F.when(F.col("r").isNotNull() & (F.col("i") == F.col("j")), F.lit(1.0)).otherwise(F.col("r")).alias("r"),
    )


def _centred(c: str, mean: float | None, impute: bool, varied: bool) -> Column:
    if not varied:
        return F.lit(None).cast("double")
    x = number(c) - F.lit(mean)
    return F.coalesce(x, F.lit(0.0)) if impute else x


def _pearson(sxy: Column, sx: Column, sy: Column, sxx: Column, syy: Column, n: Column) -> Column:
    covariation = sxy - ratio(sx * sy, n)
    spread_x = F.greatest(sxx - ratio(sx * sx, n), F.lit(0.0))
    spread_y = F.greatest(syy - ratio(sy * sy, n), F.lit(0.0))
    # Below this the spread is only rounding error of the sums.
    flat = (spread_x <= 1e-12 * sxx) | (spread_y <= 1e-12 * syy)
    return F.when(~flat, ratio(covariation, F.sqrt(spread_x) * F.sqrt(spread_y)))


def _block_sums(centred: DataFrame, p: int) -> DataFrame:
    """Sums, squares and products of all pairs: one block of p x p sums per task, added up by Spark."""
    fields = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype="float64", na_value=np.nan)
            known = (~np.isnan(x)).astype("float64")
            x = np.nan_to_num(x)
            squares = x * x
            sums = [known.T @ known, x.T @ known, known.T @ x,
                    squares.T @ known, known.T @ squares, x.T @ x]
            total = sums if total is None else [a + b for a, b in zip(total, sums)]
        if total is not None:
            i, j = np.triu_indices(p)
            yield pd.DataFrame({"i": i, "j": j, **{f: s[i, j] for f, s in zip(fields, total)}})

    schema = "i int, j int, " + ", ".join(f"{f} double" for f in fields)
    return (
        centred.mapInPandas(block, schema)
        .groupBy("i", "j")
        .agg(*[F.sum(f).alias(f) for f in fields])
    )


def pairs_above(
    matrix: DataFrame, threshold: float
) -> DataFrame:
    """Pairs in column order (pos1 < pos2) with abs(r) above the threshold."""
    return matrix.where((F.col("pos1") < F.col("pos2")) & (F.abs("r") > threshold))


def strong_correlations(matrix: DataFrame, threshold: float = STRONG) -> DataFrame:
    return pairs_above(matrix, threshold).select("var1", "var2", "r")


def redundant_pairs(matrix: DataFrame, threshold: float = REDUNDANT) -> DataFrame:
    """Pairs that carry nearly the same information, r as absolute value."""
    return pairs_above(matrix, threshold).select("var1", "var2", F.abs("r").alias("r"))


def target_correlations(matrix: DataFrame, target: str, threshold: float = NOTABLE) -> DataFrame:
    """(variable, r) of the columns that go with one target, highest first."""
    return (
        matrix.where((F.col("var1") == target) & (F.col("var2") != target) & (F.abs("r") > threshold))
        .select(F.col("var2").alias("variable"), "r", F.col("pos2").alias("variable_pos"))
        .orderBy(F.desc("r"), "variable_pos")
        .select("variable", "r")
    )


def target_relationships(matrix: DataFrame, target: str, threshold: float = NOTABLE) -> DataFrame:
    """(variable, abs_r, rank, is_strong, n_strong_predictors, max_correlation) of a target.

    The target itself is in the list; it does not count as a predictor. The
    largest correlation is the second of the list, 0 if there is only one column.
    """
    mine = matrix.where(F.col("var1") == target).select(
        F.col("var2").alias("variable"), F.col("pos2").alias("pos"), F.abs("r").alias("abs_r")
    )
    # One row per column of the table.
    order = W.orderBy(F.desc_nulls_last("abs_r"), "pos")
    everything = W.partitionBy()
    return mine.withColumn("rank", F.row_number().over(order)).select(
        "variable",
        "abs_r",
        "rank",
        F.coalesce(F.col("abs_r") > threshold, F.lit(False)).alias("is_strong"),
        (F.count(F.when(F.col("abs_r") > threshold, 1)).over(everything) - 1).alias("n_strong_predictors"),
        F.when(F.count(F.lit(1)).over(everything) > 1,
               F.max(F.when(F.col("rank") == 2, F.col("abs_r"))).over(everything))
        .otherwise(0.0).alias("max_correlation"),
    )


def mean_abs_correlation(matrix: DataFrame) -> DataFrame:
    """(variable, variable_pos, mean_abs_r): the column itself counts with r = 1."""
    return matrix.groupBy(F.col("var1").alias("variable"), F.col("pos1").alias("variable_pos")).agg(
        F.avg(F.abs("r")).alias("mean_abs_r")
    )


def top_correlated_features(matrix: DataFrame, k: int = 15) -> DataFrame:
    """The k columns with the largest mean abs(r)."""
    return (
        mean_abs_correlation(matrix)
        .orderBy(F.desc_nulls_last("mean_abs_r"), "variable_pos")
        .limit(k)
    )


def heatmap_table(matrix: DataFrame, k: int = 15) -> DataFrame:
    """The matrix restricted to its k most correlated columns."""
    keep = top_correlated_features(matrix, k).select("variable")
    return matrix.join(
        F.broadcast(keep.withColumnRenamed("variable", "var1")), "var1", "left_semi"
    ).join(F.broadcast(keep.withColumnRenamed("variable", "var2")), "var2", "left_semi")


def correlation_importance(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(variable, importance): mean abs(r) after mean imputation, top k."""
    return importance_of(correlation_matrix(df, columns, impute=True), k)


def importance_of(matrix: DataFrame, k: int = 10) -> DataFrame:
    """(variable, importance): mean abs(r) in a correlation matrix, top k."""
    return top_correlated_features(matrix, k).select(
        "variable", F.col("mean_abs_r").alias("importance")
    )


def variance_importance(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(variable, importance): sample variance after mean imputation, top k.

    Imputed cells sit on the mean, so they add to the count but not to the
    squares: no second pass is needed.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    return (
        per_column(
            df,
            columns,
            {"spread": lambda c: F.var_pop(number(c)), "present": lambda c: F.count(number(c))},
            {"n_rows": F.count(F.lit(1))},
        )
        .select(
            F.col("column").alias("variable"),
            "column_pos",
            ratio(F.col("spread") * F.col("present"), F.col("n_rows") - 1).alias("importance"),
        )
        .orderBy(F.desc_nulls_last("importance"), "column_pos")
        .limit(k)
        .select("variable", "importance")
    )
