"""Multivariate structure: scaling, clusters, components, forest importance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce, wraps

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.expressions import col, number, numeric_columns
from plumbline.operators import clusters
from plumbline.operators.correlate import correlation_matrix
from plumbline.operators.forest import importances

# Random seed, most clusters tried, trees, leading components.
SEED, MOST_CLUSTERS, TREES, LEADING_COMPONENTS = 42, 10, 100, 3


@dataclass(frozen=True)
class Scale:
    """Mean and population deviation of a mean-imputed column."""

    column: str
    mean: float
    deviation: float


def scales(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[int, list[Scale]]:
    """Number of rows and the scales of the columns that hold any value, in one scan.

    An imputed cell adds nothing to the squares, so the deviation after
    imputation follows from the one before.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[e for i, c in enumerate(columns)
          for e in (F.count(number(c)).alias(f"n{i}"), F.avg(number(c)).alias(f"m{i}"),
                    F.var_pop(number(c)).alias(f"v{i}"))],
    ).first()
    n = row["n"]
    return n, [
        Scale(c, row[f"m{i}"], (row[f"v{i}"] * row[f"n{i}"] / n) ** 0.5)
        for i, c in enumerate(columns) if row[f"n{i}"]
    ]


def _imputed(scale: Scale) -> Column:
    return F.coalesce(number(scale.column), F.lit(scale.mean))


def _standardized(scale: Scale) -> Column:
    if scale.deviation == 0:
        return F.lit(0.0)
    return (_imputed(scale) - scale.mean) / scale.deviation


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns as double with nulls replaced by the column mean."""
    _, found = scales(df, columns)
    return _replace(df, {s.column: _imputed(s) for s in found})


def standardize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean-imputed columns with mean 0 and population deviation 1; constants become 0."""
    _, found = scales(df, columns)
    return _replace(df, {s.column: _standardized(s) for s in found})


def feature_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, found: Sequence[Scale] | None = None
) -> DataFrame:
    """The table with a ``features`` vector of its standardised numeric columns."""
    found = scales(df, columns)[1] if found is None else found
    return df.withColumn("features", array_to_vector(F.array(*[_standardized(s) for s in found])))


class Features:
    """Standardised features of one table, computed once and kept for several models."""

    def __init__(self, df: DataFrame, columns: Sequence[str] | None = None):
        self.n_rows, self.scales = scales(df, columns)
        self.columns = [s.column for s in self.scales]
        self.source = df
        self._kept: DataFrame | None = None

    @property
    def points(self) -> DataFrame:
        """The features as columns z0, z1, ..."""
        return self.source.select(*[_standardized(s).alias(f"z{i}") for i, s in enumerate(self.scales)])

    @property
    def packed(self) -> DataFrame:
        """The features as arrays of many rows, for models that read them often."""
        if self._kept is None:
            self._kept = clusters.packed(self.points).persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept

    def release(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None


def _features(table: DataFrame | Features, columns: Sequence[str] | None = None) -> Features:
    return table if isinstance(table, Features) else Features(table, columns)


def _released(function):
    """Features made for one call only are released at its end."""

    @wraps(function)
    def call(table: DataFrame | Features, *args, **kwargs):
        features = _features(table)
        try:
            return function(features, *args, **kwargs)
        finally:
            if features is not table:
                features.release()

    return call


def elbow(costs: Sequence[float], rule: str = "late") -> int:
    """Number of clusters from the costs of k = 2, 3, ...

    ``late`` adds four to the place of the largest second difference, so the
    answer is 2 or at least 4; ``centre`` takes the k in the middle of it.
    """
    if len(costs) <= 2:
        return 2
    bends = [costs[i + 2] - 2 * costs[i + 1] + costs[i] for i in range(len(costs) - 2)]
    return bends.index(max(bends)) + (4 if rule == "late" else 3)


@dataclass
class Clustering:
    """Costs by number of clusters, the chosen number, and its centres with their rows."""

    costs: dict[int, float]
    best: int
    centers: np.ndarray
    sizes: np.ndarray


@_released
def cluster(features: DataFrame | Features, rule: str = "late") -> Clustering:
    """k-means for every k tried, all in the same passes over the rows."""
    if len(features.columns) < 2:
        raise ValueError("clustering needs two numeric columns")
    tried = range(2, min(MOST_CLUSTERS, features.n_rows // 2) + 1)
    if not tried:
        raise ValueError("clustering needs at least four rows")
    found = clusters.fit(features.packed, len(features.columns), list(tried), SEED)
    costs = {k: cost for k, (_, _, cost) in found.items()}
    best = min(elbow(list(costs.values()), rule), tried[-1])
    return Clustering(costs, best, *found[best][:2])


@_released
def kmeans_elbow(features: DataFrame | Features, clustering: Clustering | None = None) -> DataFrame:
    """(k, inertia, second_difference, is_chosen)."""
    found = clustering or cluster(features)
    by_k = W.orderBy("k")  # at most nine rows
    costs = features.source.sparkSession.createDataFrame(
        list(found.costs.items()), "k int, inertia double"
    )
    bend = F.lead("inertia").over(by_k) - 2 * F.col("inertia") + F.lag("inertia").over(by_k)
    return costs.select("k", "inertia", bend.alias("second_difference"), (F.col("k") == found.best).alias("is_chosen"))


@_released
def cluster_profile(features: DataFrame | Features, clustering: Clustering | None = None) -> DataFrame:
    """(cluster, size, column, column_pos, center) with centres in original units; clusters in the order of their centres."""
    found = clustering or cluster(features)
    return features.source.sparkSession.createDataFrame(
        [
            (i, int(found.sizes[i]), s.column, j, float(center[j] * s.deviation + s.mean))
            for i, center in enumerate(found.centers)
            for j, s in enumerate(features.scales)
        ],
        "cluster int, size long, column string, column_pos int, center double",
    )


@dataclass
class Components:
    """Shares of the variance in falling order; loadings by column and component."""

    shares: np.ndarray
    loadings: np.ndarray


@_released
def components(features: DataFrame | Features, k: int | None = None, matrix: DataFrame | None = None) -> Components:
    """Principal components of the standardised features, from the correlation matrix of the imputed columns (which may be handed over).

    The matrix has a row per pair of columns; its eigenvectors are found on the driver. No pass over the rows but that for the matrix. A
    constant column has no variance. The entry of largest size in a component is positive.
    """
    if len(features.columns) < 3 and k is None:
        raise ValueError("component analysis needs three numeric columns")
    size = len(features.columns)
    of = matrix if matrix is not None else correlation_matrix(features.source, features.columns, impute=True)
    at = {c: i for i, c in enumerate(features.columns)}
    r = np.zeros((size, size))
    for row in of.collect():
        if row["var1"] in at and row["var2"] in at:
            r[at[row["var1"]], at[row["var2"]]] = row["r"] or 0.0
    values, vectors = np.linalg.eigh((r + r.T) / 2)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(size)] < 0, -1, 1)
    return Components((values / max(values.sum(), np.finfo(float).tiny))[:k], vectors[:, :k])


@_released
def pca_variance(features: DataFrame | Features, model: Components | None = None) -> DataFrame:
    """(component, ratio, cumulative) of the explained variance, all components."""
    model = model or components(features)
    return features.source.sparkSession.createDataFrame(
        [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(model.shares, np.cumsum(model.shares)))],
        "component int, ratio double, cumulative double",
    )


@_released
def dimensionality(features: DataFrame | Features, model: Components | None = None) -> DataFrame:
    """(total_features, components_95, components_90, reduction_ratio, high_potential)."""
    total = len(features.columns)
    variance = pca_variance(features, model)

    def needed(share: float) -> Column:
        # Rounding may leave the last running total a hair below one.
        return F.coalesce(F.min(F.when(F.col("cumulative") >= share, F.col("component"))), F.lit(1))

    return variance.agg(
        F.lit(total).alias("total_features"),
        needed(0.95).alias("components_95"),
        needed(0.90).alias("components_90"),
    ).select(
        "*",
        (F.col("components_95") / total).alias("reduction_ratio"),
        (F.col("components_95") < total * 0.3).alias("high_potential"),
    )


@_released
def pca_feature_weights(features: DataFrame | Features, model: Components | None = None, k: int = 5) -> DataFrame:
    """(column, weight): mean abs(loading) over the first three components, top k."""
    model = model or components(features)
    loadings = model.loadings[:, :LEADING_COMPONENTS]  # columns x 3
    return (
        features.source.sparkSession.createDataFrame(
            [(c, i, float(abs(loadings[i]).mean())) for i, c in enumerate(features.columns)],
            "column string, column_pos int, weight double",
        )
        .orderBy(F.desc("weight"), "column_pos")
        .limit(k)
    )


@_released
def pca_projection(
    features: DataFrame | Features, clustering: Clustering | None = None, model: Components | None = None
) -> DataFrame:
    """(kind, cluster, pc1, pc2, pct1, pct2): every row and every cluster centre on
    the plane of the first two components."""
    found = clustering or cluster(features)
    model = model or components(features, 2)
    plane, pct = model.loadings[:, :2], (model.shares[:2] * 100).tolist()
    columns = [F.col(f"z{i}") for i in range(len(features.columns))]

    def sum_of(terms: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a + b, terms, F.lit(0.0))

    away = [
        F.struct(sum_of([(z - float(x)) * (z - float(x)) for z, x in zip(columns, center)]).alias("d"), F.lit(i).alias("i"))
        for i, center in enumerate(found.centers)
    ]
    points = features.points.select(F.lit("row").alias("kind"), F.array_min(F.array(*away))["i"].alias("cluster"), *columns)
    centers = features.source.sparkSession.createDataFrame(
        [("center", i, *map(float, center)) for i, center in enumerate(found.centers)],
        "kind string, cluster int, " + ", ".join(f"z{i} double" for i in range(len(columns))),
    )
    return points.unionByName(centers).select(
        "kind", "cluster",
        *[sum_of([z * float(w) for z, w in zip(columns, plane[:, j])]).alias(f"pc{j + 1}") for j in (0, 1)],
        F.lit(pct[0]).alias("pct1"), F.lit(pct[1]).alias("pct2"),
    )


def forest_importance(
    df: DataFrame, target: str | None = None, include_target: bool = False, trees: int = TREES, k: int = 10,
) -> DataFrame:
    """(column, importance): random-forest importance for a target, top k. The trees grow to the end.

    The target (first numeric column unless named) is left out of the features;
    ``include_target=True`` keeps it in. Missing values are imputed by the mean. Without features, or with a
    constant target, no column has any importance.
    """
    columns = numeric_columns(df)
    target = target or columns[0]
    wanted = [c for c in columns if include_target or c != target]
    _, found = scales(df, list(dict.fromkeys([*wanted, target])))
    by_name = {s.column: s for s in found}
    used = [by_name[c] for c in wanted if c in by_name]
    schema = "column string, column_pos int"
    names = df.sparkSession.createDataFrame([(s.column, i) for i, s in enumerate(used)], schema)
    if not used or target not in by_name:
        return names.select("column", F.lit(0.0).alias("importance"))
    label = by_name[target]
    rows = df.select(*[_imputed(s).alias(f"x{i}") for i, s in enumerate(used)], (_imputed(label) - label.mean).alias("y"))
    weights = importances(rows, [f"x{i}" for i in range(len(used))], trees, SEED)
    return (
        names.join(weights, names["column_pos"] == weights["feature"], "left")
        .select("column", "column_pos", F.coalesce("importance", F.lit(0.0)).alias("importance"))
        .orderBy(F.desc("importance"), "column_pos")
        .limit(k)
        .select("column", "importance")
    )
