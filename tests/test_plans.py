from datetime import date, timedelta

import numpy as np
import pytest

from plumbline.plans import profile, report


@pytest.fixture(scope="module")
def sales(spark):
    generator = np.random.default_rng(9)
    rows = []
    for i in range(300):
        x = float(generator.normal())
        rows.append((
            (date(2024, 1, 1) + timedelta(days=i % 100)).strftime("%d-%b-%y"), ["north", "south", "east"][i % 3],
            x, x * 2 + float(generator.normal()) * 0.1, float(generator.normal()), float(generator.normal()),
            float(generator.normal()) * 9, float(i), "a good long note about what was sold on this day number %d" % i))
    return spark.createDataFrame(
        rows, "day string, region string, a double, b double, c double, d double, latitude double, longitude double, note string")


def test_whole_profile(spark, sales):
    found = profile.run_profile(spark, sales)
    statuses = {r["analysis"]: (r["status"], r["message"]) for r in found.status.collect()}
    assert set(statuses.values()) == {("ok", None)}
    assert list(statuses) == ["load", *profile.relevant_analyses([
        "time_series", "geographic", "text_heavy", "classification", "regression", "high_dimensional"])]
    assert found.tables["strong_correlations"].first()["var2"] == "b"
    assert found.tables["coordinate_stats"].count() == 1
    assert found.tables["linear_trend"].count() == 6
    assert found.tables["analysis_summary"].first()["n_clusters"] == found.table.clustering.best >= 2
    assert found.tables["key_stats"].count() == found.tables["numeric_summary"].count()
    assert {"key_relationships", "key_patterns", "implications", "charts", "quality_warnings", "quality_recommendations"} <= set(found.tables)
    assert all(found.tables[t].count() > 0 for t in ("key_relationships", "key_patterns", "implications", "charts"))
    assert found.tables["lexicon_sentiment"].first()["positive"] == 1.0
    facts = {(r["section"], r["key"]): r["value"] for r in report.report_findings(found).collect()}
    assert facts["dataset", "rows"] == "300" and facts["dimensionality", "total_features"] == "6"
    assert ("clustering", "optimal_clusters") in facts and ("dataset_types", "text_heavy") in facts


def test_failing_analysis_leaves_the_others(spark, sales, monkeypatch):
    def broken(table):
        raise RuntimeError("no luck")

    monkeypatch.setitem(profile.ANALYSES, "outliers", broken)
    found = profile.run_profile(spark, sales, only=["basic_stats", "outliers", "correlations"])
    statuses = {r["analysis"]: (r["status"], r["message"]) for r in found.status.collect()}
    assert statuses["outliers"] == ("failed", "no luck") and statuses["correlations"][0] == "ok"
    issues = report.report_findings(found).where("section = 'issues'").first()
    assert issues["value"] == "outliers analysis failed: no luck"


def test_table_that_cannot_be_loaded(spark):
    found = profile.run_profile(spark, "missing.csv")
    assert [(r["analysis"], r["status"]) for r in found.status.collect()] == [("load", "failed")]
    assert report.report_findings(found).count() == 1


def test_summary_flags(spark, sales):
    found = report.analysis_summary(sales, n_clusters=4).first()
    assert (found["n_rows"], found["n_columns"], found["n_numeric"], found["n_categorical"]) == (300, 9, 6, 3)
    assert not found["has_missing"] and found["n_strong_correlations"] == 1
    assert found["patterns"] == "time_series,geographic"


def test_drill_down(spark, sales):
    numeric = report.drill_down(sales, "analyze_column_distribution", '{"column_name": "longitude"}')
    values = {r["item"]: r["value"] for r in numeric.collect()}
    assert (values["count"], values["max"], values["has_outliers"]) == (300.0, 299.0, 0.0)
    words = report.drill_down(sales, "analyze_column_distribution", {"column_name": "region"})
    assert {r["item"]: r["value"] for r in words.collect()} == {
        "east": 100.0, "north": 100.0, "south": 100.0, "unique_values": 3.0}
    links = report.drill_down(sales, "find_correlations", {"target_column": "a"}).collect()
    assert [r["variable"] for r in links] == ["b"]


@pytest.mark.parametrize("name, arguments, message", [
    ("analyze_column_distribution", {"column_name": "zz"}, "Column zz not found"),
    ("find_correlations", {"target_column": "region"}, "Column region is not numeric"),
    ("suggest_visualization", {"columns": ["a", "zz"]}, "Columns not found: ['zz']"),
    ("draw", {}, "Unknown function draw"),
])
def test_wrong_questions(sales, name, arguments, message):
    assert report.drill_down(sales, name, arguments).first()["error"] == message


@pytest.mark.parametrize("columns, charts", [
    (["a"], ["histogram", "box plot"]), (["region"], ["bar chart", "pie chart"]),
    (["a", "b"], ["scatter plot", "hexbin plot"]), (["a", "region"], ["box plot", "violin plot"]),
    (["day", "region"], ["heatmap", "stacked bar chart"]), (["a", "b", "c"], []),
])
def test_chart_suggestions(sales, columns, charts):
    found = report.suggest_visualization(sales, columns).orderBy("position").collect()
    assert [r["chart"] for r in found] == charts


@pytest.mark.parametrize("types, second", [
    (["time_series", "high_dimensional"], "clustering_pca"), (["time_series", "geographic"], "seasonality"),
    (["geographic", "text_heavy"], "spatial_distribution"), (["text_heavy", "regression"], "text_length_dist"),
    (["classification", "regression"], "class_distribution"), (["regression"], "target_distribution"),
])
def test_chart_choice(sales, types, second):
    found = [r["chart"] for r in report.select_chart_tables(sales, types).orderBy("position").collect()]
    assert found == ["correlation_heatmap", second, "outliers_boxplot"]


def test_chart_choice_without_numbers(spark, sales):
    texts = sales.select("day", "region")
    found = [r["chart"] for r in report.select_chart_tables(texts, ["classification"]).collect()]
    assert found == ["class_distribution"]


def test_patterns_of_text_dates(sales):
    found = {(r["pattern"], r["key"]): r["value"] for r in report.detect_patterns(sales).collect()}
    assert found["time_series", "start_date"] == "2024-01-01" and found["time_series", "span_days"] == "99"
    assert found["geographic", "north"] == "100"
    assert ("time_series", "residual_std_0") in found


def test_implications_list(sales):
    rows = report.implications(sales, n_errors=1, recommendations=sales.sparkSession.createDataFrame(
        [(0, "look again")], "position int, recommendation string"))
    assert {(r["key"], r["value"]) for r in rows.collect()} == {
        ("completeness", "1.0"), ("consistency", "false"), ("recommendation", "look again")}
