"""A whole profile: clean the table, find out what it is, run what applies."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import RLock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.dates import is_temporal, parse_date
from plumbline.functions.expressions import numeric_columns
from plumbline.functions.storage import cut_lineage, stored
from plumbline.operators import (
    clean,
    correlate,
    forecast,
    frequency,
    geo,
    models,
    readiness,
    roles,
    seasonal,
    series,
    stats,
    text,
)
from plumbline.sources.tables import read_table, validate

# Fixed value: which analyses apply to which dataset type, in running order.
BASE_ANALYSES = ["basic_stats", "outliers", "correlations"]
TYPED_ANALYSES = [
    (("high_dimensional",), ["clustering", "dimensionality"]),
    (("time_series",), ["seasonality", "trend", "forecasting"]),
    (("geographic",), ["spatial", "regional"]),
    (("text_heavy",), ["text", "sentiment"]),
    (("classification", "regression"), ["feature_importance", "predictive_power"]),
]


def relevant_analyses(types: list[str]) -> list[str]:
    chosen = list(BASE_ANALYSES)
    for wanted, names in TYPED_ANALYSES:
        if any(t in types for t in wanted):
            chosen += names
    return chosen


def plan_analyses(df: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(position, analysis) that apply to the table."""
    names = relevant_analyses(roles.dataset_type_names(df, evidence))
    return df.sparkSession.createDataFrame(list(enumerate(names)), "position int, analysis string")


# Analyses that run side by side: most are short jobs that leave cores idle.
ANALYSES_AT_ONCE = 4


class shared:
    """A property computed once per table, also when several analyses ask at once."""

    def __init__(self, make: Callable):
        self.make = make

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, table, owner: type | None = None):
        with table.locks.setdefault(self.name, RLock()):
            if self.name not in table.__dict__:
                table.__dict__[self.name] = self.make(table)
            return table.__dict__[self.name]


class Table:
    """A cleaned table with the results that several analyses share.

    Every shared result is computed at most once: the evidence on roles, the
    numeric summary, the correlation matrix, the feature vectors with their
    models, the daily series.
    """

    def __init__(self, df: DataFrame, exclude: tuple[str, ...] = ()):
        self.df = df
        self.exclude = exclude
        self.locks: dict[str, RLock] = {}

    @shared
    def evidence(self) -> DataFrame:
        return roles.role_evidence(self.df, self.exclude)

    @shared
    def types(self) -> list[str]:
        return roles.dataset_type_names(self.df, self.evidence)

    @shared
    def summary(self) -> DataFrame:
        return stats.numeric_summary(self.df)

    @shared
    def outliers(self) -> DataFrame:
        return cut_lineage(stats.iqr_outliers(self.df, summary=self.summary))

    @shared
    def matrix(self) -> DataFrame:
        return cut_lineage(correlate.correlation_matrix(self.df))

    @shared
    def imputed_matrix(self) -> DataFrame:
        """Correlations after mean imputation; without nulls they are the ones at hand."""
        n_rows = self.evidence.first()["n_rows"]
        if self.summary.where(F.col("count") < n_rows).isEmpty():
            return self.matrix
        return correlate.correlation_matrix(self.df, impute=True)

    @shared
    def features(self) -> models.Features:
        return models.Features(self.df)

    @shared
    def clustering(self) -> models.Clustering:
        return models.cluster(self.features)

    @shared
    def pca(self):
        return models.components(self.features, matrix=self.imputed_matrix)

    @shared
    def dated(self) -> tuple[DataFrame, str] | None:
        """The table with its first date column parsed, and that column's name."""
        found = self.evidence.where("is_date").orderBy("column_pos").first()
        if found is None:
            return None
        if is_temporal(self.df, found["column"]):
            return self.df, found["column"]
        return parse_date(self.df, found["column"], found["date_format"]), found["column"]

    @shared
    def daily(self) -> DataFrame:
        if self.dated is None or not numeric_columns(self.df):
            raise ValueError("a daily series needs a date and a numeric column")
        df, date_column = self.dated
        return stored(series.daily_metrics(df, date_column))

    @shared
    def decomposed(self) -> DataFrame:
        return stored(seasonal.seasonal_decompose(self.daily))

    @shared
    def text_columns(self) -> list[str]:
        rows = self.evidence.where("is_text").orderBy("column_pos").collect()  # one row per column
        return [r["column"] for r in rows]

    def release(self) -> None:
        if "features" in self.__dict__:
            self.features.release()


Tables = dict[str, DataFrame]


def _basic_stats(t: Table) -> Tables:
    return {
        "table_shape": stats.table_shape(t.df),
        "null_counts": stats.null_counts(t.df),
        "numeric_summary": t.summary,
        "categorical_summary": frequency.categorical_summary(t.df),
        "quality_warnings": readiness.quality_warnings(t.df, t.matrix if len(numeric_columns(t.df)) > 1 else None),
        "quality_recommendations": readiness.quality_recommendations(t.df),
    }


def _outliers(t: Table) -> Tables:
    return {"iqr_outliers": t.outliers}


def _correlations(t: Table) -> Tables:
    return {"correlation_matrix": t.matrix, "strong_correlations": correlate.strong_correlations(t.matrix)}


def _clustering(t: Table) -> Tables:
    return {
        "kmeans_elbow": models.kmeans_elbow(t.features, t.clustering),
        "cluster_profile": models.cluster_profile(t.features, t.clustering),
    }


def _dimensionality(t: Table) -> Tables:
    return {
        "pca_variance": models.pca_variance(t.features, t.pca),
        "dimensionality": models.dimensionality(t.features, t.pca),
        "pca_feature_weights": models.pca_feature_weights(t.features, t.pca),
        "redundant_pairs": correlate.redundant_pairs(t.matrix),
    }


def _seasonality(t: Table) -> Tables:
    return {
        "seasonality": seasonal.seasonality(t.daily, decomposed=t.decomposed),
        "seasonal_extremes": seasonal.seasonal_extremes(t.decomposed),
        "seasonal_trend": seasonal.seasonal_trend(t.decomposed),
        "acf": series.acf(t.daily),
        "dominant_periods": seasonal.dominant_periods(t.daily),
    }


def _trend(t: Table) -> Tables:
    return {
        "linear_trend": series.linear_trend(t.daily),
        "volatility": series.volatility(t.daily),
        "change_points": series.change_points(t.daily),
    }


def _forecasting(t: Table) -> Tables:
    return {
        "forecast_readiness": forecast.forecast_readiness(t.daily, decomposed=t.decomposed),
        "forecast_models": forecast.suggest_forecast_models(t.daily, decomposed=t.decomposed),
    }


def _spatial(t: Table) -> Tables:
    tables = {}
    if roles.coordinate_columns(t.df):
        tables["coordinate_stats"] = geo.coordinate_stats(t.df)
    if roles.location_columns(t.df):
        tables["location_stats"] = geo.location_stats(t.df)
    return tables


def _regional(t: Table) -> Tables:
    if not roles.location_columns(t.df) or not numeric_columns(t.df):
        return {}
    return {"regional_stats": geo.regional_stats(t.df)}


def _text(t: Table) -> Tables:
    columns = t.text_columns
    return {
        "text_stats": text.text_stats(t.df, columns),
        "vocabulary_stats": text.vocabulary_stats(t.df, columns),
        "common_words": text.common_words(t.df, columns),
    }


def _sentiment(t: Table) -> Tables:
    return {"lexicon_sentiment": text.lexicon_sentiment(t.df, t.text_columns)}


def _feature_importance(t: Table) -> Tables:
    if len(numeric_columns(t.df)) < 2:
        return {}
    return {
        "correlation_importance": correlate.importance_of(t.imputed_matrix),
        "variance_importance": correlate.variance_importance(t.df),
        "forest_importance": models.forest_importance(t.df),
    }


def _predictive_power(t: Table) -> Tables:
    classes = cut_lineage(readiness.classification_readiness(t.df, evidence=t.evidence))
    numbers = cut_lineage(readiness.regression_readiness(t.df, evidence=t.evidence, matrix=t.matrix))
    return {
        "classification_readiness": classes,
        "regression_readiness": numbers,
        "predictive_readiness": readiness.predictive_readiness(t.df),
        "suggested_models": readiness.suggest_models(classes, numbers),
    }


ANALYSES: dict[str, Callable[[Table], Tables]] = {
    "basic_stats": _basic_stats,
    "outliers": _outliers,
    "correlations": _correlations,
    "clustering": _clustering,
    "dimensionality": _dimensionality,
    "seasonality": _seasonality,
    "trend": _trend,
    "forecasting": _forecasting,
    "spatial": _spatial,
    "regional": _regional,
    "text": _text,
    "sentiment": _sentiment,
    "feature_importance": _feature_importance,
    "predictive_power": _predictive_power,
}


@dataclass
class Profile:
    """Result tables by name, and one status row per analysis."""

    spark: SparkSession
    table: Table | None = None
    tables: Tables = field(default_factory=dict)
    outcomes: list[tuple[int, str, str, str | None]] = field(default_factory=list)

    @property
    def status(self) -> DataFrame:
        """(position, analysis, status, message)."""
        return self.spark.createDataFrame(
            self.outcomes, "position int, analysis string, status string, message string"
        )

    def record(self, analysis: str, error: Exception | None = None) -> None:
        self.outcomes.append(
            (len(self.outcomes), analysis, "failed" if error else "ok", str(error).split("\n")[0] if error else None)
        )


def run_profile(
    spark: SparkSession,
    source: str | DataFrame,
    only: list[str] | None = None,
    exclude: tuple[str, ...] = (),
    cleaned: bool = False,
    multiline: bool = True,
) -> Profile:
    """Load, clean and analyse a table; a failing analysis leaves the others alone.

    The cleaned table is written once to the checkpoint folder as a columnar
    table, so analyses neither repeat the cleaning nor read columns that they
    do not use. ``cleaned=True`` takes the table as it is, without that copy.
    ``only`` overrides the choice of analyses; ``multiline`` goes to ``read_table``. Tables that sum up what has run
    (key statistics, relationships and patterns, implications, flags) and the data of the chosen charts (``chart_...``) come last.
    """
    from plumbline.plans.report import summary_tables  # it builds on this module

    profile = Profile(spark)
    try:
        df = validate(read_table(spark, source, multiline=multiline))
        table = Table(df if cleaned else stored(clean.clean(df)), exclude)
        chosen = relevant_analyses(table.types) if only is None else only
    except Exception as error:  # as with any analysis, the reason goes to the status table
        profile.record("load", error)
        return profile
    profile.table = table
    profile.record("load")

    def analyse(name: str) -> Tables:
        return {key: cut_lineage(result) for key, result in ANALYSES[name](table).items()}

    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(ANALYSES_AT_ONCE) as pool:
        running = {name: pool.submit(inherit(analyse), name) for name in chosen}
        for name, analysis in running.items():
            try:
                profile.tables.update(analysis.result())
                profile.record(name)
            except Exception as error:
                profile.record(name, error)
    try:
        profile.tables.update(summary_tables(profile))
    except Exception as error:
        profile.record("summary", error)
    table.release()
    return profile
