from datetime import date

import pytest

from plumbline.functions.dates import parse_date
from plumbline.operators import roles
from plumbline.plans.profile import relevant_analyses


def test_roles_come_from_types(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a", True, date(2024, 1, 1), [1.0])],
        "i int, x double, s string, flag boolean, d date, v array<double>",
    )
    found = {r["column"]: r["role"] for r in roles.column_roles(df).collect()}
    assert found == {"i": "numeric", "x": "numeric", "s": "categorical", "flag": "none", "d": "categorical", "v": "none"}


def test_name_rules_are_substring_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, "b", 3.0)], "capacity string, platform double, belong double, width string, row_index double")
    assert roles.location_columns(df) == ["capacity"]
    assert roles.coordinate_columns(df) == ("platform", "belong")
    assert not roles.may_be_target("width", False)
    assert not roles.may_be_target("row_index", True) and roles.may_be_target("row_index", False)
    assert roles.detect_coordinates(df).first().asDict() == {"latitude": "platform", "longitude": "belong"}


DATES = ["2024-11-01", "2024-11-02", "2024-11-03", "21-Nov-24", "1/2/2020", "junk", None]


def test_one_format_per_column(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "d string")
    found = roles.detect_date_columns(df, "any").first()
    assert (found["date_format"], found["date_share"]) == ("iso", pytest.approx(3 / 7))
    assert roles.detect_date_columns(df, "majority").isEmpty()
    parsed = [r["d"] for r in parse_date(df, "d").collect()]
    assert [p.day if p else None for p in parsed] == [1, 2, 3, None, None, None, None]


def test_share_must_exceed_half(spark):
    half = spark.createDataFrame([("2024-01-01",), ("x",)], "d string")
    assert roles.detect_date_columns(half).isEmpty()
    more = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("x",)], "d string")
    assert roles.detect_date_columns(more).count() == 1


@pytest.mark.parametrize("text, fmt, year", [
    ("05-Mar-69", "d-MMM-yy", 1969), ("05-Mar-68", "d-MMM-yy", 2068), ("5-MAR-1999", "d-MMM-yyyy", 1999),
    ("3/5/2021", "M/d/yyyy", 2021), ("2020", "iso", 2020), ("2020-02", "iso", 2020), ("March 5, 2021", "MMMM d, yyyy", 2021),
])
def test_formats(spark, text, fmt, year):
    df = spark.createDataFrame([(text,)], "d string")
    assert parse_date(df, "d", fmt).first()["d"].year == year


def test_dataset_types_in_order(spark):
    rows = [(f"2024-01-{i:02d}", "north" if i % 2 else "south", float(i), "x" * 60) for i in range(1, 29)]
    df = spark.createDataFrame(rows, "day string, region string, amount double, note string")
    names = roles.dataset_type_names(df)
    assert names == ["time_series", "geographic", "text_heavy", "classification", "regression"]
    assert relevant_analyses(names) == [
        "basic_stats", "outliers", "correlations", "seasonality", "trend", "forecasting",
        "spatial", "regional", "text", "sentiment", "feature_importance", "predictive_power",
    ]


def test_limits_of_target_rules(spark):
    rows = [(i % 9, i % 10, i % 11, i % 10, str(i % 9), str(i % 10)) for i in range(990)]
    df = spark.createDataFrame(rows, "nine int, ten int, eleven int, valid int, few string, many string")
    assert [r["column"] for r in roles.detect_regression_targets(df).collect()] == ["eleven"]
    assert [r["column"] for r in roles.detect_class_targets(df).collect()] == ["few"]
    assert roles.detect_class_targets(df, exclude=["few"]).isEmpty()


def test_empty_text_table_has_no_types(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert roles.dataset_type_names(df) == ["classification"]
