import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import readiness, stats


def _one(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_skew_score_examples(spark):
    for values, wanted in [((2, 8, 0, 4, 1, 9, 9, 0), 0.44626), ((1, 2, 3, 4, 5, 6, 7, 8000), 3.57177)]:
        row = _one(spark, values).agg(F.count("x").cast("double").alias("n"), F.skewness("x").alias("g1"))
        assert row.select(readiness.skew_z(F.col("n"), F.col("g1"))).first()[0] == pytest.approx(wanted, abs=1e-5)


def test_kurtosis_score_example(spark):
    row = _one(spark, range(20)).agg(F.count("x").cast("double").alias("n"), (F.kurtosis("x") + 3).alias("b2"))
    assert row.select(readiness.kurtosis_z(F.col("n"), F.col("b2"))).first()[0] == pytest.approx(-1.70581, abs=1e-4)


def test_shape_of_samples(spark):
    generator = np.random.default_rng(8)
    normal = readiness.target_shape(_one(spark, generator.normal(size=500)), "x").first()
    skewed = readiness.target_shape(_one(spark, generator.lognormal(size=500)), "x").first()
    assert normal["is_normal"] and not skewed["is_normal"]


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [1.0, 2.0, 9.0], [4.0] * 20])
def test_shape_of_short_and_constant_columns(spark, values):
    found = readiness.target_shape(_one(spark, values), "x").first()
    assert found["normality_p"] is None and not found["is_normal"]
    expected = pd.Series(values).skew() if len(set(values)) > 1 and len(values) > 2 else None
    assert found["skewness"] == (pytest.approx(expected) if expected is not None else None)


def test_target_quality(spark):
    df = spark.createDataFrame([(0.0,)] * 30 + [(100.0,), (None,)], "x double")
    found = readiness.target_quality(df, "x").first()
    assert found["missing_ratio"] == pytest.approx(1 / 32)
    assert found["unique_ratio"] == pytest.approx(2 / 32)
    assert found["outlier_ratio"] == pytest.approx(1 / 31)
    constant = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert readiness.target_quality(constant, "x").first()["outlier_ratio"] is None
    assert stats.zscore_outlier_ratio(constant, "x").first()["outlier_ratio"] is None


def test_class_balance(spark):
    df = spark.createDataFrame([("a",)] * 100 + [("b",)] * 29 + [(None,)], "c string")
    found = readiness.class_balance(df, "c").first()
    assert (found["n_classes"], found["interpretation"], found["sufficient"]) == (2, "imbalanced", False)
    assert found["ratio"] == pytest.approx(0.29)


def test_no_numeric_column_gives_no_score(spark):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    found = readiness.predictive_readiness(df).first()
    assert found["quality_score"] is None and not found["suitable_for_ml"]


def test_no_target_gives_no_row(spark):
    df = spark.createDataFrame([(1, "a")], "row_id int, name_id string")
    assert readiness.classification_readiness(df).isEmpty()
    assert readiness.regression_readiness(df).isEmpty()


def test_suggestions(spark):
    classes = spark.createDataFrame([(2, 0.1)], "n_classes int, ratio double")
    numbers = spark.createDataFrame([(False, 6)], "is_normal boolean, n_strong_predictors int")
    found = [r["suggestion"] for r in readiness.suggest_models(classes, numbers).collect()]
    assert found == sorted([
        "logistic_regression", "random_forest_classifier", "gradient_boosting_classifier", "smote_balancing",
        "weighted_models", "random_forest_regressor", "gradient_boosting_regressor", "target_transformation",
        "quantile_regression", "feature_selection", "regularized_regression",
    ])
    none = readiness.suggest_models(classes.limit(0), numbers.limit(0))
    assert none.isEmpty()
