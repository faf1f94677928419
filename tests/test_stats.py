import math

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import correlate, frequency, quantiles, stats


@pytest.mark.parametrize("make", [
    lambda g, n: g.normal(size=n),
    lambda g, n: g.lognormal(sigma=8, size=n),
    lambda g, n: np.where(g.random(n) < 0.4, 3.0, g.random(n)),
    lambda g, n: np.round(g.normal(size=n) * 2),
    lambda g, n: g.choice([-1e308, 1e308, 5.0], size=n),
])
def test_quantiles_are_exact(spark, monkeypatch, make):
    monkeypatch.setattr(quantiles, "RANKED_DIRECTLY", 20)
    monkeypatch.setattr(quantiles, "BINS", 16)
    values = make(np.random.default_rng(7), 2001)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    found = quantiles.exact_quantiles(df, ["x"], probabilities)["x"]
    wanted = pd.Series(values).quantile(list(probabilities)).tolist()
    assert found == pytest.approx(wanted, rel=1e-12)


def test_quantiles_ignore_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, None)], "a double, b double")
    found = quantiles.exact_quantiles(df, ["a", "b"], (0.5,))
    assert found == {"a": [1.5], "b": [None]}


def test_summary_of_column_without_values(spark, one):
    df = spark.createDataFrame([(1, None), (3, None)], "a int, b double")
    found = one(stats.numeric_summary(df))
    assert found["a"]["mean"] == 2.0 and found["a"]["q25"] == 1.5
    assert found["b"]["count"] == 0 and found["b"]["q50"] is None
    assert one(stats.iqr_outliers(df))["b"]["n_outliers"] == 0


def test_zero_quartile_range_flags_every_other_value(spark, one):
    df = spark.createDataFrame([(3.0,)] * 8 + [(2.0,), (None,)], "x double")
    found = one(stats.iqr_outliers(df))["x"]
    assert (found["n_outliers"], found["pct"], found["lower"]) == (1, 10.0, 3.0)
    assert [r["x"] for r in stats.outlier_rows(df, "x").collect()] == [2.0]


def test_booleans_have_no_role_but_count(spark, one):
    df = spark.createDataFrame([(True, 1), (None, 2)], "flag boolean, x int")
    assert [r["column"] for r in stats.numeric_summary(df).collect()] == ["x"]
    assert one(stats.null_counts(df))["flag"]["n_null"] == 1
    assert stats.completeness(df).first()["completeness"] == 0.75


def test_names_with_dots(spark, one):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "`a.b` double, `c d` string")
    assert one(stats.numeric_summary(df))["a.b"]["max"] == 2.0
    assert one(frequency.value_counts(df), "value")["a"]["n"] == 1


def test_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([(v,) for v in "dcbaab"] + [(None,)], "v string")
    found = frequency.value_counts(df, ["v"], 3).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in found] == [("a", 2), ("b", 2), ("c", 1)]


def test_long_values_come_back_whole(spark):
    texts = ["y" * 100, "y" * 100, "z" * 64, "short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r["value"]: r["n"] for r in frequency.value_counts(df, ["t"], None).collect()}
    assert found == {"y" * 100: 2, "z" * 64: 1, "short": 1}


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert sum(r["n"] for r in stats.histogram(df, "x", 10).collect()) == 2


def _matrix(df, **options):
    return {(r["var1"], r["var2"]): r["r"] for r in correlate.correlation_matrix(df, **options).collect()}


def test_correlation_is_pairwise_complete(spark):
    pdf = pd.DataFrame({
        "a": [1.0, 2, 3, 4, 5, 6], "k": [5.0] * 6, "n": [1.0, None, 2, 8, None, 3], "m": [None, 1.0, 4, 2, 9, 7],
    })
    df = spark.createDataFrame(pdf).selectExpr(*[f"nullif({c}, 'NaN'::double) AS {c}" for c in pdf])
    found = _matrix(df)
    wanted = pdf.corr()
    for x in pdf:
        for y in pdf:
            if "k" in (x, y):
                assert found[x, y] is None
            else:
                assert found[x, y] == pytest.approx(wanted.loc[x, y])
                assert found[x, y] == found[y, x]


def test_constant_within_the_shared_rows_has_no_correlation(spark):
    df = spark.createDataFrame([(1.1, None), (1.1, 2.0), (1.1, 3.0), (7.0, None)], "a double, b double")
    assert _matrix(df)["a", "b"] is None


@pytest.mark.parametrize("width", [2, 6, 30])
def test_correlation_of_any_width(spark, width):
    generator = np.random.default_rng(3)
    pdf = pd.DataFrame(generator.normal(size=(300, width)) + 1e6, columns=[f"c{i}" for i in range(width)])
    pdf = pdf.mask(generator.random(pdf.shape) < 0.2)
    df = spark.createDataFrame(pdf).selectExpr(*[f"nullif({c}, 'NaN'::double) AS {c}" for c in pdf])
    wanted = pdf.corr()
    for pair, r in _matrix(df).items():
        assert r == pytest.approx(wanted.loc[pair], abs=1e-8)


def test_values_that_are_no_numbers_are_missing(spark):
    rows = [(float(i), float(i * i)) for i in range(1, 101)]
    odd = [(math.nan, 1.0), (math.inf, 2.0), (-math.inf, 3.0), (None, 4.0)]
    plain, mixed = (spark.createDataFrame(r, "a double, b double") for r in (rows, rows + odd))
    for operator in (stats.numeric_summary, stats.iqr_outliers, stats.histogram):
        arguments = ["a"] if operator is stats.histogram else [["a"]]
        want = [r.asDict() for r in operator(plain, *arguments).collect()]
        got = [r.asDict() for r in operator(mixed, *arguments).collect()]
        for w, g in zip(want, got, strict=True):
            assert {k: v for k, v in g.items() if k not in ("pct", "n_rows")} == {k: v for k, v in w.items() if k not in ("pct", "n_rows")}
    assert _matrix(mixed)["a", "b"] == pytest.approx(_matrix(plain)["a", "b"])


def test_quartiles_of_many_rows_with_nan(spark):
    df = spark.range(120_000).selectExpr("if(id % 2 = 0, cast(id AS double), if(id % 4 = 1, 'NaN', 'Infinity')::double) AS a")
    row = stats.numeric_summary(df).first()
    assert (row["count"], row["q25"], row["q50"], row["q75"]) == (60_000, 29_999.5, 59_999.0, 89_998.5)


def test_ties_of_long_texts_go_to_the_smaller_value(spark):
    texts = [(c * 70,) for c in "dbca"] + [(c,) for c in "zyx"]
    got = frequency.value_counts(spark.createDataFrame(texts, "t string"), k=2).orderBy("rank").collect()
    assert [r["value"] for r in got] == ["a" * 70, "b" * 70]


def test_single_column_has_no_second_correlation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    links = correlate.target_relationships(correlate.correlation_matrix(df), "a").first()
    assert links["max_correlation"] == 0.0 and links["n_strong_predictors"] == 0
