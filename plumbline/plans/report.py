"""Tables that sum up a profile, and the ad-hoc questions one asks afterwards."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.dates import is_temporal, parse_date
from plumbline.functions.expressions import categorical_columns, col, numeric_columns
from plumbline.operators import correlate, frequency, geo, models, ordered, readiness, roles, seasonal, series, stats, text
from plumbline.operators.stats import completeness
from plumbline.plans.profile import Profile, Table


def key_stats(summary: DataFrame, outliers: DataFrame) -> DataFrame:
    """(column, mean, std, min, max, n_outliers, pct), the percentage to two decimals."""
    found = outliers.select("column", "n_outliers", F.round("pct", 2).alias("pct"))
    return summary.select("column", "mean", "std", "min", "max").join(F.broadcast(found), "column")


def key_patterns(cluster_profile: DataFrame | None, dimensionality: DataFrame | None) -> DataFrame:
    """(pattern, key, value): number and sizes of clusters, components for 95 %."""
    parts = []
    if cluster_profile is not None:
        sizes = cluster_profile.select("cluster", "size").distinct()
        parts.append(sizes.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
            F.lit("clusters").alias("pattern"), F.lit("count").alias("key"), "value"))
        parts.append(sizes.select(
            F.lit("clusters"), F.concat(F.lit("size_"), F.col("cluster").cast("string")), F.col("size").cast("double")))
    if dimensionality is not None:
        named = F.array(*[
            F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value"))
            for k in ("components_95", "reduction_ratio")
        ])
        parts.append(dimensionality.select(F.lit("dimensionality"), F.inline(named)))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def key_relationships(matrix: DataFrame) -> DataFrame:
    """(var1, var2, strength): strong pairs, r to three decimals."""
    return correlate.strong_correlations(matrix).select("var1", "var2", F.round("r", 3).alias("strength"))


def implications(
    df: DataFrame,
    readiness: DataFrame | None = None,
    suggestions: DataFrame | None = None,
    recommendations: DataFrame | None = None,
    n_errors: int = 0,
) -> DataFrame:
    """(topic, key, value): what follows for modelling and for data quality."""
    parts = [
        completeness(df).select(
            F.lit("data_quality").alias("topic"), F.lit("completeness").alias("key"),
            F.round("completeness", 6).cast("string").alias("value")),
        df.sparkSession.createDataFrame(
            [("data_quality", "consistency", str(n_errors == 0).lower())], "topic string, key string, value string"),
    ]
    if readiness is not None:
        parts.append(readiness.select(
            F.lit("predictive_potential"), F.lit("suitable_for_ml"), F.col("suitable_for_ml").cast("string")))
    if suggestions is not None:
        parts.append(suggestions.select(F.lit("predictive_potential"), F.lit("suggested_approach"), "suggestion"))
    if recommendations is not None:
        parts.append(recommendations.select(F.lit("data_quality"), F.lit("recommendation"), "recommendation"))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def first_any_date(df: DataFrame) -> tuple[DataFrame, str] | None:
    """The table with the first column that holds any date parsed, and its name."""
    found = roles.detect_date_columns(df, "any").orderBy("column_pos").first()  # one row per column
    if found is None:
        return None
    if is_temporal(df, found["column"]):
        return df, found["column"]
    return parse_date(df, found["column"], found["date_format"]), found["column"]


def detect_patterns(df: DataFrame, k: int = 10) -> DataFrame:
    """(pattern, item, key, value): the time span and row series of the first column
    with any date, and the top values of every location column."""
    parts = []
    dated = first_any_date(df)
    if dated is not None:
        table, date_column = dated
        span = series.date_span(table, date_column).select(
            F.inline(F.array(*[
                F.struct(F.lit(name).alias("key"), F.col(name).cast("string").alias("value"))
                for name in ("start_date", "end_date", "span_days")
            ]))
        )
        parts.append(span.select(F.lit("time_series").alias("pattern"), F.lit(date_column).alias("item"), "key", "value"))
        if numeric_columns(table):
            rows = ordered.row_series_profile(table, date_column)
            parts.append(rows.select(
                F.lit("time_series"), F.lit(date_column),
                F.concat("part", F.lit("_"), F.col("idx").cast("string")),
                F.round("value", 4).cast("string")))
    places = roles.location_columns(df)
    if places:
        parts.append(frequency.value_counts(df, places, k).select(
            F.lit("geographic").alias("pattern"), F.col("column").alias("item"),
            F.col("value").alias("key"), F.col("n").cast("string").alias("value")))
    if not parts:
        return df.sparkSession.createDataFrame([], "pattern string, item string, key string, value string")
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def analysis_summary(
    df: DataFrame,
    outliers: DataFrame | None = None,
    matrix: DataFrame | None = None,
    n_clusters: int = 0,
) -> DataFrame:
    """One row of flags: missing values, outliers, strong pairs, clusters, patterns."""
    outliers = stats.iqr_outliers(df) if outliers is None else outliers
    matrix = correlate.correlation_matrix(df) if matrix is None else matrix
    patterns = []
    if first_any_date(df) is not None:
        patterns.append("time_series")
    if roles.location_columns(df):
        patterns.append("geographic")
    any_outlier = outliers.agg(F.coalesce(F.bool_or(F.col("n_outliers") > 0), F.lit(False))).scalar()
    n_strong = correlate.strong_correlations(matrix).agg(F.count(F.lit(1))).scalar()
    nulls = sum((F.count(F.when(col(c).isNull(), 1)) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), (nulls > 0).alias("has_missing")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(categorical_columns(df))).alias("n_categorical"),
        "has_missing",
        any_outlier.alias("has_outliers"),
        n_strong.alias("n_strong_correlations"),
        F.lit(n_clusters).alias("n_clusters"),
        F.lit(",".join(patterns)).alias("patterns"),
    )


def summary_tables(profile: Profile) -> dict[str, DataFrame]:
    """The tables that sum up the analyses of a profile, as far as these have run."""
    df, tables = profile.table.df, profile.tables
    outliers, matrix = tables.get("iqr_outliers"), tables.get("correlation_matrix")
    failures = sum(status == "failed" for _, _, status, _ in profile.outcomes)
    out = {
        "implications": implications(
            df, tables.get("predictive_readiness"), tables.get("suggested_models"),
            tables.get("quality_recommendations"), failures),
        "charts": select_chart_tables(df, profile.table.types),
    }
    out |= chart_tables(profile)
    if "numeric_summary" in tables and outliers is not None:
        out["key_stats"] = key_stats(tables["numeric_summary"], outliers)
    if matrix is not None:
        out["key_relationships"] = key_relationships(matrix)
    if outliers is not None and matrix is not None:
        n_clusters = profile.table.clustering.best if "kmeans_elbow" in tables else 0
        out["analysis_summary"] = analysis_summary(df, outliers, matrix, n_clusters)
    if "cluster_profile" in tables or "dimensionality" in tables:
        out["key_patterns"] = key_patterns(tables.get("cluster_profile"), tables.get("dimensionality"))
    return out


def report_findings(profile: Profile) -> DataFrame:
    """(section, key, value): dataset facts, types, scalar results, issues."""
    facts: list[tuple[str, str, str]] = []
    if profile.table is not None:
        df = profile.table.df
        facts += [
            ("dataset", "columns", str(len(df.columns))),
            ("dataset", "numeric_features", str(len(numeric_columns(df)))),
            ("dataset", "categorical_features", str(len(categorical_columns(df)))),
            *[("dataset_types", name, "true") for name in profile.table.types],
        ]
    facts += [
        ("issues", analysis, f"{analysis} analysis failed: {message}")
        for _, analysis, status, message in profile.outcomes if status == "failed"
    ]
    schema = "section string, key string, value string"
    result = profile.spark.createDataFrame(facts, schema)
    if profile.table is not None:
        result = result.union(profile.table.df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
            F.lit("dataset"), F.lit("rows"), "value"))
    scalars = {
        "kmeans_elbow": ("clustering", lambda t: t.where("is_chosen").select("clustering", F.lit("optimal_clusters"), F.col("k"))),
        "dimensionality": ("dimensionality", lambda t: t.select("dimensionality", F.lit("total_features"), F.col("total_features"))),
    }
    for table, (section, pick) in scalars.items():
        if table in profile.tables:
            picked = pick(profile.tables[table].withColumn(section, F.lit(section))).toDF("section", "key", "value")
            result = result.union(picked.select("section", "key", F.col("value").cast("string")))
    return result


# ---------------------------------------------------------------- charts

# Chart names; the first dataset type of this list that holds gives the second chart.
SECOND_CHART = [
    ("high_dimensional", "clustering_pca"),
    ("time_series", "seasonality"),
    ("geographic", "spatial_distribution"),
    ("text_heavy", "text_length_dist"),
    ("classification", "class_distribution"),
    ("regression", "target_distribution"),
]
# Fixed value: the operator that computes the data of each chart.
CHART_OPERATORS = {
    "correlation_heatmap": "heatmap_table",
    "clustering_pca": "pca_projection",
    "seasonality": "decomposition_table",
    "spatial_distribution": "density_grid",
    "text_length_dist": "text_histograms",
    "class_distribution": "class_distribution",
    "target_distribution": "histogram",
    "outliers_boxplot": "boxplot_stats",
}


def select_chart_tables(df: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(position, chart, operator): heat map, one chart by type, box plot."""
    types = roles.dataset_type_names(df) if types is None else types
    numeric = numeric_columns(df)
    charts = ["correlation_heatmap"] if len(numeric) >= 2 else []
    charts += [chart for name, chart in SECOND_CHART if name in types][:1]
    if numeric and len(charts) < 3:
        charts.append("outliers_boxplot")
    return df.sparkSession.createDataFrame(
        [(i, c, CHART_OPERATORS[c]) for i, c in enumerate(charts)],
        "position int, chart string, operator string",
    )


def _class_chart(t: Table) -> dict[str, DataFrame]:
    target = t.evidence.where("is_class_target").orderBy("column_pos").first()
    return {"": readiness.class_distribution(t.df, target["column"])}


def _target_chart(t: Table) -> dict[str, DataFrame]:
    target = t.evidence.where("is_regression_target").orderBy("column_pos").first()["column"]
    return {"": stats.histogram(t.df, target), "_fit": stats.normal_fit(t.df, target)}


def _place_chart(t: Table) -> dict[str, DataFrame]:
    """The grid and, from enough rows on, the contours; regions in place of a table without coordinates."""
    if not roles.coordinate_columns(t.df):
        return {"": geo.location_stats(t.df)}
    out = {"": geo.density_grid(t.df)}
    if t.df.limit(geo.ENOUGH_FOR_CONTOURS + 1).count() > geo.ENOUGH_FOR_CONTOURS:
        out["_contours"] = geo.density_contours(t.df)
    return out


# How the data of each chart are made from a table; a second table of a chart has an ending.
CHART_DATA = {
    "correlation_heatmap": lambda t: {"": correlate.heatmap_table(t.matrix)},
    "clustering_pca": lambda t: {"": models.pca_projection(t.features, t.clustering, models.components(t.features, 2, t.imputed_matrix))},
    "seasonality": lambda t: {"": seasonal.decomposition_table(*t.dated)},
    "spatial_distribution": _place_chart,
    "text_length_dist": lambda t: {"": text.text_histograms(t.df, next(iter(t.text_columns), None))},
    "class_distribution": _class_chart,
    "target_distribution": _target_chart,
    "outliers_boxplot": lambda t: {"": stats.boxplot_stats(
        t.df, [r["column"] for r in stats.top_outlier_columns(t.outliers).collect()], t.summary)},
}


def chart_tables(profile: Profile) -> dict[str, DataFrame]:
    """The data of every chosen chart as ``chart_<name>``; one that fails is noted in the profile and leaves the others alone."""
    out: dict[str, DataFrame] = {}
    chosen = select_chart_tables(profile.table.df, profile.table.types).orderBy("position").collect()  # three rows at most
    for row in chosen:
        name = f"chart_{row['chart']}"
        try:
            out |= {name + ending: data for ending, data in CHART_DATA[row["chart"]](profile.table).items()}
        except Exception as error:
            profile.record(name, error)
    return out


# ------------------------------------------------------ ad-hoc questions

# Chart suggestions by number of columns and how many are numeric.
SUGGESTED_CHARTS = {
    (1, 1): [("histogram", "Show distribution of values"), ("box plot", "Show outliers and quartiles")],
    (1, 0): [("bar chart", "Show frequency of categories"), ("pie chart", "Show proportion of categories")],
    (2, 2): [("scatter plot", "Show relationship between variables"), ("hexbin plot", "Show density of points")],
    (2, 1): [("box plot", "Show distribution by category"), ("violin plot", "Show detailed distribution by category")],
    (2, 0): [("heatmap", "Show relationship between categories"), ("stacked bar chart", "Show composition of categories")],
}


def column_distribution(df: DataFrame, column_name: str, summary: DataFrame | None = None) -> DataFrame:
    """(type, section, item, value): statistics of a numeric column, or the top
    values of any other one."""
    if column_name not in df.columns:
        raise ValueError(f"Column {column_name} not found")
    if column_name in numeric_columns(df):
        summary = stats.numeric_summary(df, [column_name]) if summary is None else summary
        outliers = stats.iqr_outliers(df, [column_name], summary)
        names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
        measured = F.array(*[
            F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in names
        ])
        kind = F.lit("numeric").alias("type")
        return summary.where(F.col("column") == column_name).select(
            kind, F.lit("statistics").alias("section"), F.inline(measured)
        ).union(outliers.select(
            kind, F.lit("has_outliers"), F.lit("has_outliers"), (F.col("n_outliers") > 0).cast("double")))
    kind = F.lit("categorical").alias("type")
    return frequency.value_counts(df, [column_name], 10).select(
        kind, F.lit("value_counts").alias("section"), F.col("value").alias("item"), F.col("n").cast("double").alias("value")
    ).union(stats.distinct_counts(df, [column_name]).select(
        kind, F.lit("unique_values"), F.lit("unique_values"), F.col("n_distinct").cast("double")))


def find_correlations(df: DataFrame, target_column: str) -> DataFrame:
    """(variable, r) of the numeric columns that go with a numeric target."""
    if target_column not in numeric_columns(df):
        raise ValueError(f"Column {target_column} is not numeric")
    return correlate.target_correlations(correlate.correlation_matrix(df), target_column)


def suggest_visualization(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, chart, description) for one or two columns; none for more."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"Columns not found: {unknown}")
    numeric = set(numeric_columns(df))
    shown = SUGGESTED_CHARTS.get((len(columns), sum(c in numeric for c in columns)), [])
    return df.sparkSession.createDataFrame(
        [(i, *chart) for i, chart in enumerate(shown)], "position int, chart string, description string"
    )


# The questions by name, with the JSON type of their argument.
DRILL_DOWNS = {
    "analyze_column_distribution": column_distribution,
    "find_correlations": find_correlations,
    "suggest_visualization": suggest_visualization,
}
DRILL_DOWN_PARAMETERS = {
    "analyze_column_distribution": {"column_name": "string"},
    "find_correlations": {"target_column": "string"},
    "suggest_visualization": {"columns": "array of string"},
}


def drill_down(df: DataFrame, name: str, arguments: dict | str) -> DataFrame:
    """Answer a question by name with JSON arguments; what is wrong comes back as (error)."""
    if isinstance(arguments, str):
        arguments = json.loads(arguments)
    try:
        if name not in DRILL_DOWNS:
            raise ValueError(f"Unknown function {name}")
        return DRILL_DOWNS[name](df, **arguments)
    except ValueError as problem:
        return df.sparkSession.createDataFrame([(str(problem),)], "error string")
