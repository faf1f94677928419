"""Is the table fit for classification or regression, and what to try."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.expressions import (
    categorical_columns,
    col,
    group_key,
    number,
    numeric_columns,
    ratio,
)
from plumbline.operators.correlate import (
    NEAR_IDENTICAL,
    correlation_matrix,
    pairs_above,
    target_relationships,
)
from plumbline.operators.frequency import group_sizes, value_counts
from plumbline.operators.roles import role_evidence
from plumbline.operators.stats import Z_LIMIT, distinct_counts

# Fixed values of the rules.
BALANCED, ENOUGH_PER_CLASS = 0.3, 30
NORMAL_P = 0.05
ENOUGH_ROWS, ROWS_PER_FEATURE, COMPLETE = 100, 10, 0.7
MANY_PREDICTORS = 5
HIGH_CARDINALITY, DOMINANT = 0.5, 0.8


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(value, n) of every class."""
    return value_counts(df, [target], None).select("value", "n")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(n_classes, ratio, interpretation, smallest_class, sufficient) of a target:
    smallest over largest share, and whether every class has 30 rows."""
    classes = df.where(col(target).isNotNull()).groupBy(group_key(df, target).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return classes.agg(
        F.count(F.lit(1)).alias("n_classes"),
        ratio(F.min("n"), F.max("n")).alias("ratio"),
        F.min("n").alias("smallest_class"),
    ).select(
        "n_classes",
        "ratio",
        F.when(F.col("ratio") > BALANCED, "balanced").otherwise("imbalanced").alias("interpretation"),
        "smallest_class",
        F.coalesce(F.col("smallest_class") >= ENOUGH_PER_CLASS, F.lit(True)).alias("sufficient"),
    )


def skew_z(n: Column, g1: Column) -> Column:
    """Normal score of the sample skewness (D'Agostino 1970)."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    delta = 1 / F.sqrt(F.log(w2) / 2)
    alpha = F.sqrt(2 / (w2 - 1))
    return delta * F.asinh(y / alpha)


def kurtosis_z(n: Column, b2: Column) -> Column:
    """Normal score of the sample kurtosis (Anscombe and Glynn 1983)."""
    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - expected) / F.sqrt(variance)
    shape = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(
        6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))
    )
    a = 6 + 8 / shape * (2 / shape + F.sqrt(1 + 4 / (shape * shape)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    root = F.signum(d) * F.cbrt(ratio(1 - 2 / a, F.abs(d)))
    return (1 - 2 / (9 * a) - root) / F.sqrt(2 / (9 * a))


def target_shape(df: DataFrame, target: str) -> DataFrame:
    """(skewness, normality_p, is_normal, min, max, std) of a numeric target.

    Skewness is bias-corrected; normality is the combined skewness and kurtosis
    test, null below 8 values or for a constant target.
    """
    x = number(target)
    spread = F.var_pop(x)
    moments = df.agg(
        F.count(x).cast("double").alias("n"),
        spread.alias("variance"),
        F.skewness(x).alias("g1"),
        (F.kurtosis(x) + 3).alias("b2"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.stddev_samp(x).alias("std"),
    )
    # The tests are defined from 8 values on; the guard keeps their formulas off shorter input.
    n = F.greatest(F.col("n"), F.lit(8.0))
    usable = (F.col("n") >= 8) & (F.col("variance") > 0)
    g1, b2 = F.when(usable, F.col("g1")), F.when(usable, F.col("b2"))
    z1, z2 = skew_z(n, g1), kurtosis_z(n, b2)
    corrected = F.when(
        (F.col("n") >= 3) & (F.col("variance") > 0),
        F.col("g1") * ratio(F.sqrt(F.col("n") * F.greatest(F.col("n") - 1, F.lit(0.0))), F.col("n") - 2),
    )
    return moments.select(
        corrected.alias("skewness"),
        F.exp(-(z1 * z1 + z2 * z2) / 2).alias("normality_p"),
        "min", "max", "std",
    ).select(
        "skewness", "normality_p",
        F.coalesce(F.col("normality_p") > NORMAL_P, F.lit(False)).alias("is_normal"),
        "min", "max", "std",
    )


def target_quality(df: DataFrame, target: str) -> DataFrame:
    """(missing_ratio, unique_ratio, outlier_ratio) of a numeric target."""
    x = number(target)
    mean, sd = df.agg(F.avg(x), F.stddev_pop(x)).first()
    far = F.count(F.when(F.abs(x - mean) / sd > Z_LIMIT, 1)) if sd else F.lit(None)
    rows = F.count(F.lit(1))
    return df.agg(
        ratio(rows - F.count(x), rows).alias("missing_ratio"),
        ratio(F.count_distinct(col(target)), rows).alias("unique_ratio"),
        ratio(far, F.count(x)).alias("outlier_ratio"),
    )


def _first_target(df: DataFrame, kind: str, evidence: DataFrame | None, exclude: Sequence[str]) -> str | None:
    evidence = role_evidence(df, exclude) if evidence is None else evidence
    row = evidence.where(f"is_{kind}_target").orderBy("column_pos").first()
    return row["column"] if row else None


def classification_readiness(
    df: DataFrame, target: str | None = None, evidence: DataFrame | None = None, exclude: Sequence[str] = ()
) -> DataFrame:
    """One row on the first classification target, or none."""
    target = target or _first_target(df, "class", evidence, exclude)
    if target is None:
        return _nothing(df, "target string, n_classes bigint, ratio double, interpretation string, "
                            "smallest_class bigint, sufficient boolean, numeric_features int, "
                            "categorical_features int, missing_value_impact double")
    used = [*numeric_columns(df), target]
    nulls = sum((F.count(F.when(col(c).isNull(), 1)) for c in used), F.lit(0))
    impact = df.agg(ratio(nulls, F.count(F.lit(1)) * len(used))).scalar()
    return class_balance(df, target).select(
        F.lit(target).alias("target"),
        "*",
        F.lit(len(numeric_columns(df))).alias("numeric_features"),
        F.lit(len(categorical_columns(df))).alias("categorical_features"),
        impact.alias("missing_value_impact"),
    )


def regression_readiness(
    df: DataFrame,
    target: str | None = None,
    evidence: DataFrame | None = None,
    matrix: DataFrame | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """One row on the first regression target, or none."""
    target = target or _first_target(df, "regression", evidence, exclude)
    if target is None:
        return _nothing(df, "target string, skewness double, normality_p double, is_normal boolean, "
                            "min double, max double, std double, n_strong_predictors bigint, "
                            "max_correlation double, missing_ratio double, unique_ratio double, "
                            "outlier_ratio double")
    links = target_relationships(correlation_matrix(df) if matrix is None else matrix, target)
    quality = target_quality(df, target)
    # Each of the three parts is one row.
    return (
        target_shape(df, target).withColumn("target", F.lit(target))
        .join(links.where("rank = 1").select(F.lit(target).alias("target"), "n_strong_predictors", "max_correlation"), "target")
        .join(quality.withColumn("target", F.lit(target)), "target")
    )


def _nothing(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def predictive_readiness(df: DataFrame) -> DataFrame:
    """Volume, completeness and suitability for machine learning, one row."""
    features = numeric_columns(df)
    nulls = sum((F.count(F.when(col(c).isNull(), 1)) for c in features), F.lit(0))
    facts = df.agg(F.count(F.lit(1)).alias("n_samples"), nulls.cast("bigint").alias("nulls"))
    n, p = F.col("n_samples"), len(features)
    complete = F.col("feature_completeness")
    return facts.select(
        "n_samples",
        F.lit(p).alias("n_features"),
        (n / max(1, p)).alias("samples_per_feature"),
        ((n >= ENOUGH_ROWS) & (n >= ROWS_PER_FEATURE * p)).alias("sufficient_volume"),
        (1 - ratio(F.col("nulls"), n * p)).alias("feature_completeness"),
    ).select(
        "*",
        (complete * F.least(F.lit(1.0), ratio(n, F.lit(ROWS_PER_FEATURE * p)))).alias("quality_score"),
        F.coalesce((n >= ENOUGH_ROWS) & (complete > COMPLETE), F.lit(False)).alias("suitable_for_ml"),
    )


def suggest_models(classification: DataFrame, regression: DataFrame) -> DataFrame:
    """(suggestion), sorted: kinds of model that the readiness tables point to."""

    def when(condition: Column, *names: str) -> list[Column]:
        return [F.when(condition, F.lit(name)) for name in names]

    always = F.lit(True)
    binary = F.col("n_classes") == 2
    for_classes = [
        *when(binary, "logistic_regression"),
        *when(always, "random_forest_classifier", "gradient_boosting_classifier"),
        *when(~binary, "neural_network_classifier"),
        *when(F.col("ratio") < BALANCED, "smote_balancing", "weighted_models"),
    ]
    for_numbers = [
        *when(always, "random_forest_regressor", "gradient_boosting_regressor"),
        *when(~F.col("is_normal"), "target_transformation", "quantile_regression"),
        *when(F.col("n_strong_predictors") > MANY_PREDICTORS, "feature_selection", "regularized_regression"),
    ]
    parts = [
        table.select(F.explode(F.array_compact(F.array(*names))).alias("suggestion"))
        for table, names in ((classification, for_classes), (regression, for_numbers))
    ]
    return parts[0].union(parts[1]).distinct().orderBy("suggestion")


def quality_recommendations(df: DataFrame) -> DataFrame:
    """(position, recommendation): missing values, high cardinality, dominant values."""
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        sum((F.count(F.when(col(c).isNull(), 1)) for c in df.columns), F.lit(0)).alias("nulls"),
    ).first()
    sizes = group_sizes(df).orderBy("column_pos").collect()  # one row per categorical column
    notes = ["Consider handling missing values"] if facts["nulls"] else []
    notes += [
        f"High cardinality in {r['column']} might need grouping"
        for r in sizes if r["n_distinct"] / facts["n"] > HIGH_CARDINALITY
    ]
    notes += [
        f"Consider addressing imbalance in {r['column']}"
        for r in sizes if r["n_leading"] / r["n_present"] > DOMINANT
    ]
    return df.sparkSession.createDataFrame(list(enumerate(notes)), "position int, recommendation string")


def quality_warnings(df: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """(kind, column, other, value): few columns, no numbers, many distinct values,
    columns that nearly repeat each other."""
    schema = "kind string, column string, other string, value double"
    fixed = []
    if len(df.columns) < 2:
        fixed.append(("one_column", None, None, float(len(df.columns))))
    if not numeric_columns(df):
        fixed.append(("no_numeric_column", None, None, 0.0))
    warnings = df.sparkSession.createDataFrame(fixed, schema)
    categorical = categorical_columns(df)
    if categorical:
        varied = distinct_counts(df, categorical).select(
            F.lit("high_cardinality").alias("kind"),
            "column",
            F.lit(None).cast("string").alias("other"),
            ratio(F.col("n_distinct"), F.col("n_rows")).alias("value"),
        )
        warnings = warnings.union(varied.where(F.col("value") > HIGH_CARDINALITY))
    if len(numeric_columns(df)) > 1:
        matrix = correlation_matrix(df) if matrix is None else matrix
        warnings = warnings.union(
            pairs_above(matrix, NEAR_IDENTICAL).select(
                F.lit("high_correlation"), "var1", "var2", F.abs("r")
            )
        )
    return warnings
