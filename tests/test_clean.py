from math import inf, nan

import pytest

from plumbline.operators import clean
from plumbline.operators.readiness import quality_recommendations, quality_warnings


def test_sparse_columns_drop_above_half(spark):
    rows = [(1.0, 1.0, None), (2.0, 2.0, None), (3.0, None, None), (4.0, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    assert clean.drop_sparse_columns(df).columns == ["a", "b"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, nan), (2, nan), (3, 1.0)], "a int, b double")
    assert clean.drop_sparse_columns(df).columns == ["a"]


def test_null_rows_are_duplicates_of_each_other(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x"), (None, "x"), (2, "y")], "a int, b string")
    found = clean.dedup_rows(df).collect()
    assert {tuple(r) for r in found} == {(1, None), (None, "x"), (2, "y")} and len(found) == 3
    assert clean.duplicate_count(df).first().asDict() == {"n_rows": 5, "n_distinct": 3, "n_duplicates": 2}


def test_rows_of_equal_hash_are_compared_in_full(spark):
    # Nulls leave the hash as it is, so these two different rows share one.
    df = spark.createDataFrame([("x", None), (None, "x"), (None, "x")], "a string, b string")
    assert clean.dedup_rows(df).count() == 2


def test_table_without_copies_is_left_alone(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1)], "a double, b int")
    assert clean.dedup_rows(df).count() == 2
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert clean.dedup_rows(zeros).count() == 1


def test_long_texts_are_compared_whole(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long + "a",), (long + "b",), (long + "a",)], "t string")
    assert clean.duplicate_count(df).first()["n_duplicates"] == 1


def test_values_that_are_no_numbers_become_null(spark):
    df = spark.createDataFrame([(inf,), (-inf,), (nan,), (None,), (1.5,)], "x double")
    found = [r["x"] for r in clean.nullify_infinite(clean.nullify_nan(df)).collect()]
    assert found == [None, None, None, None, 1.5]


def test_clean_keeps_other_types(spark):
    df = spark.createDataFrame([(True, [1.0], 1.0), (True, [1.0], 1.0)], "flag boolean, v array<double>, x double")
    cleaned = clean.clean(df)
    assert cleaned.count() == 1 and cleaned.columns == ["flag", "v", "x"]


def test_one_text_column_warns_and_recommends(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    kinds = {r["kind"] for r in quality_warnings(df).collect()}
    assert kinds == {"one_column", "no_numeric_column", "high_cardinality"}
    notes = [r["recommendation"] for r in quality_recommendations(df).orderBy("position").collect()]
    assert notes == ["Consider handling missing values", "High cardinality in name might need grouping"]


def test_dominant_value_is_noted(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "kind string")
    notes = [r["recommendation"] for r in quality_recommendations(df).collect()]
    assert notes == ["Consider addressing imbalance in kind"]
