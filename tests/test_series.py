import math
from datetime import date, datetime, timedelta
from math import pi, sin

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import forecast, ordered, seasonal, series


def _days(spark, values, start=date(2024, 1, 1)):
    rows = [(start + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "day date, x double")


def _series(spark, values):
    return series.daily_metrics(_days(spark, values), "day", ["x"])


def test_gaps_and_edges(spark):
    rows = [
        (datetime(2024, 1, 1, 8), None), (datetime(2024, 1, 2, 9), 2.0), (datetime(2024, 1, 2, 18), 4.0),
        (datetime(2024, 1, 5), 9.0), (datetime(2024, 1, 6), None), (None, 100.0),
    ]
    df = spark.createDataFrame(rows, "ts timestamp, x double")
    gaps = series.daily_series(df, "ts", ["x"]).orderBy("pos").collect()
    assert [r["value"] for r in gaps] == [None, 3.0, None, None, 9.0, None]
    assert [r["pos"] for r in gaps] == list(range(6))
    filled = series.interpolate_linear(series.daily_series(df, "ts", ["x"])).orderBy("pos").collect()
    assert [r["value"] for r in filled] == [None, 3.0, 5.0, 7.0, 9.0, 9.0]


def test_series_per_key(spark):
    rows = [("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 3), 3.0), ("b", date(2024, 5, 1), 7.0)]
    df = spark.createDataFrame(rows, "k string, day date, x double")
    found = series.daily_metrics(df, "day", ["x"], ["k"])
    assert sorted((r["k"], r["pos"], r["value"]) for r in found.collect()) == [
        ("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("b", 0, 7.0)]
    trend = {r["k"]: r["slope"] for r in series.linear_trend(found, ["k"]).collect()}
    assert trend["a"] == pytest.approx(1.0) and trend["b"] is None


@pytest.mark.parametrize("n, period", [(60, 30), (45, 22), (31, 15), (4, 2)])
def test_decomposition(spark, n, period):
    generator = np.random.default_rng(n)
    x = generator.normal(size=n) + np.arange(n) * 0.1
    found = seasonal.seasonal_decompose(_series(spark, x)).toPandas().sort_values("pos")
    assert set(found["period"]) == {period}
    weights = np.ones(period + 1) if period % 2 == 0 else np.ones(period)
    if period % 2 == 0:
        weights[[0, -1]] = 0.5
    half = period // 2
    trend = np.full(n, np.nan)
    trend[half:n - half] = np.convolve(x, weights / period, mode="valid")
    np.testing.assert_allclose(found["trend"].to_numpy(float), trend, atol=1e-9)
    phase = pd.Series(x - trend).groupby(np.arange(n) % period).mean()
    phase -= phase.mean()
    np.testing.assert_allclose(found["seasonal"], phase.to_numpy()[np.arange(n) % period], atol=1e-9)
    assert found["seasonal"][:period].sum() == pytest.approx(0, abs=1e-9)
    whole = (found["trend"] + found["seasonal"] + found["residual"]).dropna()
    np.testing.assert_allclose(whole, found["observed"][whole.index], atol=1e-9)


def test_too_short_to_decompose(spark):
    assert seasonal.seasonal_decompose(_series(spark, [1, 2, 3])).isEmpty()


def generated_rows(df):
    """Rows that explodes have made, from the metrics of the plan that ran."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        own = node.metrics().get("numOutputRows").get().value() if name == "Generate" else 0
        children = node.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_spectrum_of_any_length(spark):
    rng = np.random.default_rng(3)
    # One day, few days, a prime that is summed directly, primes that are not, lengths with many and with few factors.
    lengths = [1, 2, 30, 97, 257, 360, 1009, 2 * 503, 1024]
    values = {f"m{n}": rng.normal(size=n) + 5 for n in lengths}
    rows = [(m, i, float(v)) for m, x in values.items() for i, v in enumerate(x)] + [("m30", 30 + i, None) for i in range(4)]
    df = spark.createDataFrame(rows, "metric string, pos int, value double").repartition(4)
    found = {(r["metric"], r["k"]): r["magnitude"] for r in seasonal.spectrum(df).collect()}
    assert len(found) == sum(n // 2 + 1 for n in lengths)
    for m, x in values.items():
        for k, size in enumerate(np.abs(np.fft.rfft(x))):
            assert found[m, k] == pytest.approx(size, abs=1e-8)
    assert seasonal.spectrum(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [2310, 2309, 2 * 1153])
def test_spectrum_work(spark, n):
    df = spark.range(n).selectExpr("'m' AS metric", "cast(id AS int) AS pos", "cast(id % 7 AS double) AS value")
    rows = generated_rows(seasonal.spectrum(df))
    # Direct sums would take n * n / 2 rows.
    assert 0 < rows < (2.5 * n**1.5 if n == 2310 else 20 * n**1.5) and rows < n * n / 2


def test_dominant_period(spark):
    x = [10 * sin(2 * pi * i / 15) + 0.01 * i for i in range(60)]
    found = seasonal.dominant_periods(_series(spark, x)).orderBy("rank").collect()
    assert found[-1]["period"] == 15
    assert seasonal.seasonality(_series(spark, x)).first()["is_seasonal"]
    top = seasonal.seasonal_extremes(seasonal.seasonal_decompose(_series(spark, x)), 3).where("kind = 'peak'").orderBy("rank")
    assert [r["rank"] for r in top.collect()] == [1, 2, 3]


def test_kruskal_with_and_without_ties(spark):
    found = seasonal.kruskal_by_phase(_series(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10] * 3), phases=2).first()
    assert found["statistic"] is not None
    assert seasonal.kruskal_by_phase(_series(spark, range(23))).first()["statistic"] is None
    assert seasonal.kruskal_by_phase(_series(spark, [5] * 24)).first()["statistic"] is None
    # 24 untied values in two interleaved groups: the closed form of H.
    h = seasonal.kruskal_by_phase(_series(spark, range(24)), phases=2).first()["statistic"]
    ranks = np.arange(1, 25)
    sums = ranks[::2].sum(), ranks[1::2].sum()
    assert h == pytest.approx(12 / (24 * 25) * sum(s * s / 12 for s in sums) - 3 * 25)


def test_autocorrelation(spark):
    generator = np.random.default_rng(5)
    x = generator.normal(size=20).cumsum()
    found = {r["lag"]: r["acf"] for r in series.acf(_series(spark, x)).collect()}
    c = x - x.mean()
    assert found[1] == pytest.approx((c[1:] * c[:-1]).sum() / (c * c).sum())
    assert found[7] == pytest.approx((c[7:] * c[:-7]).sum() / (c * c).sum())
    assert found[30] is None
    lag1 = series.lag1_autocorr(_series(spark, x)).first()["lag1"]
    assert lag1 == pytest.approx(pd.Series(x).autocorr())
    assert series.lag1_autocorr(_series(spark, [1])).first()["lag1"] is None


def test_trend_numbers(spark):
    x = [4.0, 6.0, 5.0, 9.0]
    s = pd.Series(x)
    trend = series.linear_trend(_series(spark, x)).first()
    assert trend["slope"] == pytest.approx(np.polyfit(range(4), x, 1)[0])
    assert (trend["direction"], trend["total_change"], trend["percent_change"]) == ("increasing", 5.0, 125.0)
    moves = series.volatility(_series(spark, x)).first()
    assert moves["volatility"] == pytest.approx(s.std() / s.mean())
    assert moves["momentum"] == pytest.approx(s.diff().mean())
    assert series.volatility(_series(spark, [-4.0, -6.0])).first()["stability"] == "stable"
    points = series.change_points(_series(spark, x)).first()
    assert (points["max_increase"], points["max_decrease"]) == (4.0, -1.0)
    flat = series.linear_trend(_series(spark, [3, 3, 3])).first()
    assert flat["direction"] == "decreasing"


def test_span_counts_whole_days(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 12),), (datetime(2024, 1, 4, 11),), (None,)], "ts timestamp")
    found = series.date_span(df, "ts").first()
    assert (found["start_date"], found["end_date"], found["span_days"]) == (date(2024, 1, 1), date(2024, 1, 4), 2)


def test_unit_root_p_values(spark):
    df = spark.createDataFrame([(-3.43,), (-2.86,), (-2.57,), (-20.0,), (3.0,), (-1.2,), (None,)], "t double")
    p = [r["p"] for r in df.select(forecast.unit_root_p(df["t"]).alias("p")).collect()]
    assert p[:3] == pytest.approx([0.01, 0.05, 0.10], abs=1e-3) and p[3:5] == [0, 1] and p[6] is None
    z = 1.7339 + 0.93202 * -1.2 - 0.12745 * 1.44 - 0.010368 * -1.728
    assert p[5] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-12)


def test_unit_root_test_tells_noise_from_walk(spark):
    generator = np.random.default_rng(11)
    noise = generator.normal(size=200)
    assert forecast.adf_test(_series(spark, noise)).first()["is_stationary"]
    walk = forecast.adf_test(_series(spark, noise.cumsum() + np.arange(200) * 0.5)).first()
    assert not walk["is_stationary"] and walk["needs_differencing"]
    assert forecast.adf_test(_series(spark, [2.0] * 50)).first()["p_value"] is None


def unit_root(x):
    """Number of lags and t value by separate least-squares fits."""
    x = x - x.mean()
    change = np.diff(x)
    n = len(x)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)

    def fit(first, k):
        rows = len(change) - first
        design = np.column_stack([np.ones(rows), x[first:-1]] + [change[first - j:first - j + rows] for j in range(1, k + 1)])
        found = np.linalg.lstsq(design, change[first:], rcond=None)[0]
        return design, found, change[first:] - design @ found

    scores = []
    for k in range(most + 1):
        _, _, rest = fit(most, k)
        scores.append(len(rest) * np.log(rest @ rest / len(rest)) + 2 * (k + 2))
    best = int(np.argmin(scores))
    design, found, rest = fit(best, best)
    scale = np.linalg.inv(design.T @ design)[1, 1] * (rest @ rest) / (len(rest) - design.shape[1])
    return best, found[1] / np.sqrt(scale)


def test_lag_choice_matches_separate_fits(spark):
    rng = np.random.default_rng(2)
    walks = {"walk": rng.normal(size=80).cumsum(), "short": rng.normal(size=9), "far": 1e6 + rng.normal(size=200).cumsum(), "noise": rng.normal(size=33)}
    rows = [(m, i, float(v)) for m, x in walks.items() for i, v in enumerate(x)] + [("flat", i, 1.0) for i in range(20)] + [("tiny", 0, 1.0), ("tiny", 1, 2.0)]
    df = spark.createDataFrame(rows, "metric string, pos int, value double").repartition(3)
    found = {r["metric"]: (r["lags"], r["statistic"]) for r in forecast.adf_test(df).collect()}
    assert set(found) == {*walks, "flat", "tiny"} and found["flat"] == found["tiny"] == (None, None)
    for metric, x in walks.items():
        lags, t = unit_root(x)
        assert found[metric][0] == lags and found[metric][1] == pytest.approx(t, rel=1e-6)


@pytest.mark.parametrize("n, models", [
    (9, ["ARIMA"]),
    (10, ["ARIMA", "Prophet", "Exponential Smoothing"]),
    (100, ["ARIMA", "LSTM"]),
])
def test_model_suggestions(spark, n, models):
    x = range(n) if n < 100 else np.random.default_rng(1).normal(size=n)
    found = forecast.suggest_forecast_models(_series(spark, x)).orderBy("position").collect()
    assert [r["model"] for r in found if r["model"] != "SARIMA"] == models


def test_readiness_needs_thirty_days(spark):
    short = forecast.forecast_readiness(_series(spark, range(29))).first()
    long = forecast.forecast_readiness(_series(spark, range(30))).first()
    assert not short["suitable_for_forecasting"] and long["suitable_for_forecasting"]


def test_forward_fill_across_partitions(spark):
    pdf = pd.DataFrame({"t": range(500), "k": [i % 3 for i in range(500)], "x": [float(i) if i % 97 == 5 else None for i in range(500)]})
    df = spark.createDataFrame([(r.t, r.k, None if pd.isna(r.x) else r.x) for r in pdf.itertuples()], "t int, k int, x double").repartition(7)
    found = ordered.forward_fill(df, "t", ["x"], range_rows=60).toPandas().sort_values("t")
    pd.testing.assert_series_equal(found["x"].reset_index(drop=True), pdf["x"].astype(float).ffill(), check_names=False)
    keyed = ordered.forward_fill(df, "t", ["x"], ["k"], range_rows=60).toPandas().sort_values("t")
    pd.testing.assert_series_equal(keyed["x"].reset_index(drop=True), pdf.groupby("k")["x"].ffill().astype(float), check_names=False)


def test_forward_fill_of_one_hot_key(spark):
    rows = [("hot", i, float(i) if i == 0 else None) for i in range(400)] + [(None, i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    found = ordered.forward_fill(df, "t", ["x"], ["k"], range_rows=30)
    assert found.where("k = 'hot' AND x = 0.0").count() == 400
    assert found.where("k IS NULL AND x IS NULL").count() == 5


def test_forward_fill_of_many_types_and_keys(spark):
    rng = np.random.default_rng(2)
    rows = [
        (None if k == 3 else f"k{k}", None if g == 2 else int(g), i, None if rng.random() < 0.6 else f"v{i}", None if rng.random() < 0.6 else datetime(2024, 1, 1, i % 24))
        for i, (k, g) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 3, 300)))
    ]
    df = spark.createDataFrame(rows, "k string, g int, t int, s string, d timestamp")
    want = pd.DataFrame(rows, columns=list("kgtsd")).sort_values("t")
    want[["s", "d"]] = want.groupby(["k", "g"], dropna=False)[["s", "d"]].ffill()
    clean = lambda v: None if pd.isna(v) else v
    expected = sorted((r.t, clean(r.s), clean(r.d)) for r in want.itertuples())
    for size in (1, 7, 1000):
        found = ordered.forward_fill(df, "t", ["s", "d"], ["k", "g"], range_rows=size)
        assert found.columns == df.columns and sorted((r.t, r.s, r.d) for r in found.collect()) == expected
    assert ordered.forward_fill(df.limit(0), "t", ["s"], ["k"]).collect() == []


def test_one_exchange_of_the_rows(spark):
    df = spark.range(1000).selectExpr("id AS t", "if(id % 7 = 0, id, NULL) AS x")
    filled = ordered.forward_fill(df, "t", ["x"], range_rows=100)
    # The range exchange lies behind the checkpoint; nothing is exchanged after it.
    assert "Exchange" not in filled._jdf.queryExecution().executedPlan().toString()
    assert filled.rdd.getNumPartitions() == 10


@pytest.mark.parametrize("block", [7, 40, 100_000])
@pytest.mark.parametrize("n", [30, 31, 200])
def test_row_series(spark, block, n):
    generator = np.random.default_rng(n)
    rows = [(date(2024, 1, 1) + timedelta(days=int(d)), float(v) if v != 3 else None)
            for d, v in zip(generator.integers(0, 9, n), generator.integers(0, 12, n))]
    rows += [(date(2023, 1, 1), 1.0)] + [(None, 5.0)] * 3
    df = spark.createDataFrame(rows, "day date, x double").repartition(5)
    found = {(r["part"], r["idx"]): r["value"] for r in ordered.row_series_profile(df, "day", "x", range_rows=block).collect()}
    pdf = pd.DataFrame(rows, columns=["day", "x"]).sort_values(["day", "x"], na_position="last")
    x = pdf["x"].astype(float).ffill().to_numpy()
    total, period = len(x), min(30, len(x) // 2)
    half = period // 2
    weights = np.ones(period + 1 if period % 2 == 0 else period)
    if period % 2 == 0:
        weights[[0, -1]] = 0.5
    trend = np.full(total, np.nan)
    trend[half:total - half] = np.convolve(x, weights / period, mode="valid")
    phase = pd.Series(x - trend).groupby(np.arange(total) % period).mean()
    phase -= phase.mean()
    rest = x - trend - phase.to_numpy()[np.arange(total) % period]
    known = trend[~np.isnan(trend)][-5:]
    for i in range(5):
        assert found["seasonal", i] == pytest.approx(phase[i], abs=1e-9)
        if len(known) == 5:
            assert found["trend", i] == pytest.approx(known[i])
    assert found["residual_std", 0] == pytest.approx(pd.Series(rest).std())


def test_row_series_of_few_rows(spark):
    df = spark.createDataFrame([(date(2024, 1, i + 1), float(i)) for i in range(29)], "day date, x double")
    assert ordered.row_series_profile(df, "day").isEmpty()


def test_every_metric_has_a_series(spark):
    df = spark.createDataFrame([(date(2024, 1, i), *[float(i + j) for j in range(5)]) for i in (1, 3)], "d date, a double, b double, c double, e double, f double")
    assert series.daily_series(df, "d").select("metric").distinct().count() == 5
    assert series.daily_series(df, "d", first=2).select("metric").distinct().count() == 2


def test_padded_dates_are_parsed(spark):
    from plumbline.functions.dates import parse_date

    df = spark.createDataFrame([(" " * 50 + "2024-01-02" + " " * 50,), ("x" * 60,)], "t string")
    assert [r["d"] for r in parse_date(df, "t", alias="d").collect()] == [datetime(2024, 1, 2), None]
