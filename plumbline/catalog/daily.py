"""Catalogue: daily series, seasonality, forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import Query, r, rounded, union
from plumbline.operators import forecast, ordered, seasonal, series

EVENTS_NUMBERS = ["event_id", "user_id", "value"]


# Prices in whole cents add up exactly in any order, so daily means compare exactly.
CENTS_NUMBERS = ["o_orderkey", "o_custkey", "cents"]
CENTS = """orders_in_cents AS (
  SELECT o_orderkey, o_custkey, round(o_totalprice * 100) AS cents, o_orderdate FROM orders)"""


def _cents(load):
    return load("orders").select(
        "o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).alias("cents"), "o_orderdate"
    )


def _orders(load):
    return series.daily_metrics(_cents(load), "o_orderdate", CENTS_NUMBERS)


def _events(load):
    return series.daily_metrics(load("events"), "ts", EVENTS_NUMBERS)


def daily_sql(table: str, ts: str, metrics: list[str]) -> str:
    """CTE text: raw daily means ``gaps`` and the gapless ``series``."""
    means = union(metrics, lambda i, m: (
        f"SELECT '{m}' AS metric, CAST({ts} AS DATE) AS day, avg({m}) AS value FROM {table} "
        f"WHERE {ts} IS NOT NULL GROUP BY 2"
    ))
    return f"""observed AS ({means}),
span AS (SELECT min(day) AS lo, max(day) AS hi FROM observed),
calendar AS (SELECT CAST(g AS DATE) AS day, lo FROM span, generate_series(lo, hi, INTERVAL 1 DAY) AS s(g)),
gaps AS (
  SELECT m.metric, c.day, date_diff('day', c.lo, c.day) AS pos, o.value
  FROM calendar c CROSS JOIN (SELECT DISTINCT metric FROM observed) m
  LEFT JOIN observed o ON o.metric = m.metric AND o.day = c.day),
around AS (
  SELECT *, last_value(value IGNORE NULLS) OVER before AS v0,
         last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER before AS p0,
         first_value(value IGNORE NULLS) OVER later AS v1,
         first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER later AS p1
  FROM gaps
  WINDOW before AS (PARTITION BY metric ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         later AS (PARTITION BY metric ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
series AS (
  SELECT metric, day, pos, CASE WHEN value IS NOT NULL THEN value WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0
         ELSE (v1 - v0) / (p1 - p0) * (pos - p0) + v0 END AS value FROM around)"""


DECOMPOSED = """sized AS (
  SELECT *, least(30, n // 2) AS period, least(30, n // 2) // 2 AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY metric) AS n FROM series)),
smooth AS (
  SELECT a.metric, a.pos,
         sum(b.value * CASE WHEN abs(a.pos - b.pos) = a.h AND a.period % 2 = 0 THEN 0.5 ELSE 1.0 END) / any_value(a.period) AS trend
  FROM sized a JOIN sized b ON a.metric = b.metric AND b.pos BETWEEN a.pos - a.h AND a.pos + a.h
  WHERE a.pos >= a.h AND a.pos <= a.n - 1 - a.h GROUP BY a.metric, a.pos),
phases AS (
  SELECT metric, phase, m - avg(m) OVER (PARTITION BY metric) AS seasonal FROM (
    SELECT s.metric, s.pos % s.period AS phase, avg(s.value - t.trend) AS m
    FROM sized s JOIN smooth t ON s.metric = t.metric AND s.pos = t.pos GROUP BY 1, 2)),
decomposed AS (
  SELECT s.metric, s.day, s.pos, s.period, s.value AS observed, t.trend, p.seasonal,
         s.value - t.trend - p.seasonal AS residual
  FROM sized s LEFT JOIN smooth t ON s.metric = t.metric AND s.pos = t.pos
  JOIN phases p ON p.metric = s.metric AND p.phase = s.pos % s.period)"""

ON_ORDERS = f"WITH {CENTS},\n{daily_sql('orders_in_cents', 'o_orderdate', CENTS_NUMBERS)}"
ON_EVENTS = f"WITH {daily_sql('events', 'ts', EVENTS_NUMBERS)}"

SERIES = "SELECT metric, CAST(day AS VARCHAR) AS day, CAST(pos AS BIGINT) AS pos, {value} AS value FROM {table}"

TREND = f"""
, fitted AS (SELECT metric, regr_slope(value, pos) AS slope, arg_min(value, pos) AS a, arg_max(value, pos) AS z
  FROM series GROUP BY metric)
SELECT metric, {r('slope', 5)} AS slope, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
  {r('z - a', 4)} AS total_change, {r('(z / a - 1) * 100', 4)} AS percent_change FROM fitted"""

CHANGES = """, changes AS (SELECT metric, value, value - lag(value) OVER (PARTITION BY metric ORDER BY pos) AS change FROM series)"""
VOLATILITY = CHANGES + f"""
, measured AS (SELECT metric, stddev_samp(value) / avg(value) AS v, avg(change) AS m FROM changes GROUP BY metric)
SELECT metric, {r('v', 5)} AS volatility, {r('m', 5)} AS momentum,
  CASE WHEN v < 0.1 THEN 'stable' ELSE 'volatile' END AS stability FROM measured"""
CHANGE_POINTS = CHANGES + f"""
, spread AS (SELECT metric, stddev_samp(change) AS sd FROM changes GROUP BY metric)
SELECT c.metric, {r('max(change)', 4)} AS max_increase, {r('min(change)', 4)} AS max_decrease,
  count(*) FILTER (WHERE abs(change) > 2 * sd) AS significant_changes
FROM changes c JOIN spread s ON c.metric = s.metric GROUP BY c.metric"""

DECOMPOSE_ROWS = f"""
SELECT metric, CAST(day AS VARCHAR) AS day, CAST(pos AS BIGINT) AS pos, CAST(period AS BIGINT) AS period,
  {r('observed', 3)} AS observed, {r('trend', 3)} AS trend, {r('seasonal', 3)} AS seasonal, {r('residual', 3)} AS residual
FROM decomposed"""

LARGEST_DECOMPOSED = f"WITH {CENTS},\n{daily_sql('orders_in_cents', 'o_orderdate', ['cents'])},\n" + DECOMPOSED + DECOMPOSE_ROWS

STRENGTH = "strengths AS (SELECT metric, avg(abs(seasonal)) / avg(abs(residual)) AS strength FROM decomposed GROUP BY metric)"

EXTREMES = f"""
SELECT metric, kind, rank, CAST(day AS VARCHAR) AS day, {r('seasonal', 4)} AS seasonal FROM (
  SELECT metric, 'peak' AS kind, row_number() OVER (PARTITION BY metric ORDER BY round(seasonal, 6) DESC, day) AS rank, day, seasonal FROM decomposed
  UNION ALL
  SELECT metric, 'trough', row_number() OVER (PARTITION BY metric ORDER BY round(seasonal, 6), day), day, seasonal FROM decomposed)
WHERE rank <= 3"""

SEASONAL_TREND = f"""
, ends AS (SELECT metric, arg_min(trend, pos) FILTER (WHERE trend IS NOT NULL) AS a,
  arg_max(trend, pos) FILTER (WHERE trend IS NOT NULL) AS z, stddev_samp(observed) AS sd FROM decomposed GROUP BY metric)
SELECT metric, CASE WHEN z > a THEN 'increasing' ELSE 'decreasing' END AS direction, {r('abs(z - a) / sd', 5)} AS strength FROM ends"""

ACF = """
, centred AS (SELECT metric, pos, value - avg(value) OVER (PARTITION BY metric) AS x FROM series WHERE value IS NOT NULL)
, lagged AS (SELECT metric, x, lag(x, 1) OVER w AS l1, lag(x, 7) OVER w AS l7, lag(x, 30) OVER w AS l30
  FROM centred WINDOW w AS (PARTITION BY metric ORDER BY pos))
""" + union(["1", "7", "30"], lambda i, k: (
    f"SELECT metric, CAST({k} AS BIGINT) AS lag, {r(f'sum(x * l{k}) / sum(x * x)')} AS acf FROM lagged GROUP BY metric"
))

LAG1 = """links AS (SELECT metric, corr(value, before) AS lag1 FROM
  (SELECT metric, value, lag(value) OVER (PARTITION BY metric ORDER BY pos) AS before FROM series) GROUP BY metric)"""

PERIODS = """sizes AS (SELECT metric, count(*) AS n FROM series GROUP BY metric),
frequencies AS (SELECT metric, n, k FROM sizes, generate_series(0, 100000) AS g(k) WHERE 2 * k <= n),
bins AS (
  SELECT s.metric, f.n, f.k,
         sqrt(pow(sum(s.value * cos(2 * pi() * ((f.k * s.pos) % f.n) / f.n)), 2)
            + pow(sum(s.value * sin(2 * pi() * ((f.k * s.pos) % f.n) / f.n)), 2)) AS magnitude
  FROM frequencies f JOIN series s ON s.metric = f.metric GROUP BY s.metric, f.n, f.k),
slots AS (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY magnitude DESC, sign DESC, k) AS slot FROM (
    SELECT *, unnest(CASE WHEN k = 0 OR 2 * k = n THEN [0] ELSE [1, -1] END) AS sign FROM bins)),
periods AS (
  SELECT metric, k, n // k AS period, magnitude, row_number() OVER (PARTITION BY metric ORDER BY slot DESC) AS rank
  FROM slots WHERE slot <= 5 AND sign > 0 AND n // k BETWEEN 2 AND n // 3)"""

KRUSKAL = """ranked AS (
  SELECT metric, pos % 12 AS phase, count(*) OVER (PARTITION BY metric, value) AS t,
         rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS rk
  FROM series WHERE value IS NOT NULL),
grouped AS (SELECT metric, phase, sum(rk) AS s, count(*) AS c, sum(t * t - 1) AS tied FROM ranked GROUP BY metric, phase),
kruskal AS (
  SELECT metric, CASE WHEN sum(c) >= 24 THEN
    (12.0 / (sum(c) * (sum(c) + 1.0)) * sum(s * s / c) - 3 * (sum(c) + 1.0))
    / (1 - sum(tied) / (pow(sum(c), 3) - sum(c))) END AS statistic
  FROM grouped GROUP BY metric)"""

SEASONALITY = f"""
SELECT s.metric, {r('strength', 5)} AS strength, coalesce(p.n, 0) AS n_periods, {r('statistic', 4)} AS statistic,
  strength > 0.5 AND p.n IS NOT NULL AS is_seasonal
FROM strengths s LEFT JOIN (SELECT metric, count(*) AS n FROM periods GROUP BY metric) p ON p.metric = s.metric
JOIN kruskal k ON k.metric = s.metric"""

READINESS = f"""
SELECT q.metric, q.data_points, {r('q.missing_ratio')} AS missing_ratio, 'daily' AS frequency, {r('lag1', 5)} AS lag1,
  abs(lag1) > 0.7 AS has_strong_autocorr, {r('strength', 5)} AS seasonality_strength, strength > 0.5 AS has_seasonality,
  data_points >= 30 AND missing_ratio < 0.2 AND abs(lag1) > 0.7 AS suitable_for_forecasting
FROM (SELECT metric, count(*) AS data_points, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_ratio
      FROM series GROUP BY metric) q JOIN links l ON l.metric = q.metric JOIN strengths s ON s.metric = q.metric"""

MODELS = """
, facts AS (SELECT s.metric, count(*) AS n, regr_slope(value, pos) AS slope, stddev_samp(value) AS sd, any_value(strength) AS strength
  FROM series s JOIN strengths t ON t.metric = s.metric GROUP BY s.metric),
named AS (SELECT metric, list_filter([
    'ARIMA',
    CASE WHEN n >= 30 AND strength > 0.5 THEN 'SARIMA' END,
    CASE WHEN n >= 10 AND abs(slope) > 0.1 * sd THEN 'Prophet' END,
    CASE WHEN n >= 10 AND abs(slope) > 0.1 * sd THEN 'Exponential Smoothing' END,
    CASE WHEN n >= 100 THEN 'LSTM' END,
    CASE WHEN n >= 1000 THEN 'Neural Prophet' END], lambda m: m IS NOT NULL) AS models FROM facts)
SELECT metric, CAST(unnest(range(len(models))) AS BIGINT) AS position, unnest(models) AS model FROM named"""

DATE_SPAN = """
SELECT CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS start_date, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS end_date,
  CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000) AS BIGINT) AS span_days FROM events"""


def _with_gaps(load):
    """Orders with a price for every third row only."""
    return load("orders").select(
        "o_orderkey", "o_orderpriority",
        F.when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 7 == 5, F.col("o_custkey").cast("double")).alias("customer"),
    )


def fill_sql(partition: str) -> str:
    return f"""
WITH t AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 7 = 5 THEN CAST(o_custkey AS DOUBLE) END AS customer FROM orders)
SELECT o_orderkey, o_orderpriority, last_value(price IGNORE NULLS) OVER w AS price,
  last_value(customer IGNORE NULLS) OVER w AS customer
FROM t WINDOW w AS ({partition} ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


ROW_SERIES = f"""
WITH sorted AS (
  SELECT row_number() OVER (ORDER BY o_orderdate NULLS LAST, price NULLS LAST) - 1 AS pos, price,
         count(*) OVER () AS n FROM (SELECT o_orderdate, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders)),
filled AS (SELECT pos, n, last_value(price IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM sorted),
smooth AS (
  SELECT *, CASE WHEN pos >= 15 AND pos <= n - 16 THEN
    (sum(value) OVER (ORDER BY pos ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING)
     + (lag(value, 15) OVER (ORDER BY pos) + lead(value, 15) OVER (ORDER BY pos)) / 2) / 30 END AS trend FROM filled),
phases AS (SELECT phase, m - avg(m) OVER () AS seasonal FROM (SELECT pos % 30 AS phase, avg(value - trend) AS m FROM smooth GROUP BY 1)),
rest AS (SELECT stddev_samp(value - trend - seasonal) AS sd FROM smooth JOIN phases ON phase = pos % 30)
SELECT 'trend' AS part, CAST(pos - (n - 20) AS BIGINT) AS idx, {r('trend', 4)} AS value FROM smooth WHERE pos BETWEEN n - 20 AND n - 16
UNION ALL SELECT 'seasonal', CAST(phase AS BIGINT), {r('seasonal', 4)} FROM phases WHERE phase < 5
UNION ALL SELECT 'residual_std', CAST(0 AS BIGINT), {r('sd', 4)} FROM rest"""

# Normal equations by elimination: after k steps the last entry is the residual of the model with the first k regressors.
def gram(name: str, rows: str, vector: str) -> str:
    return f"""{name}_vectors AS (SELECT metric, {vector} AS v FROM {rows}),
{name}_sizes AS (SELECT metric, max(len(v)) AS p FROM {name}_vectors GROUP BY metric),
{name}_sums AS (
  SELECT metric, i, j, sum(v[i] * v[j]) AS s FROM (SELECT metric, v, i, unnest(range(1, len(v) + 1)) AS j
    FROM (SELECT metric, v, unnest(range(1, len(v) + 1)) AS i FROM {name}_vectors)) GROUP BY ALL),
{name}_start AS (SELECT metric, list(s ORDER BY i, j) AS a FROM {name}_sums GROUP BY metric),
{name} AS (
  SELECT metric, p, 0 AS k, a FROM {name}_start JOIN {name}_sizes USING (metric)
  UNION ALL
  SELECT metric, p, k + 1, list_transform(range(p * p), lambda x: CASE WHEN x // p > k AND x % p > k
    THEN a[x + 1] - a[x - x % p + k + 1] * a[k * p + x % p + 1] / a[k * p + k + 1] ELSE a[x + 1] END)
  FROM {name} WHERE k < p - 1)"""


UNIT_ROOT = f"""levels AS (
  SELECT metric, spot, n, least(ceil(12 * pow(n / 100, 0.25)), n // 2 - 2)::INTEGER AS most, x FROM (
    SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY pos) - 1 AS spot, count(*) OVER (PARTITION BY metric) AS n,
      (value - avg(value) OVER (PARTITION BY metric)) / stddev_pop(value) OVER (PARTITION BY metric) AS x
    FROM series WHERE value IS NOT NULL)),
steps AS (
  SELECT metric, spot, n, most, lag(x) OVER w AS level, x - lag(x) OVER w AS change FROM levels WINDOW w AS (PARTITION BY metric ORDER BY spot)),
histories AS (
  SELECT *, list_reverse(list(change) OVER (PARTITION BY metric ORDER BY spot ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)) AS before
  FROM steps WHERE spot >= 1),
full_rows AS (SELECT * FROM histories WHERE spot > most),
{gram('lags', 'full_rows', 'list_concat([1.0, level], before[1:most], [change])')},
informed AS (
  SELECT metric, k - 2 AS lags, most, n, (n - 1 - most) * ln(a[p * p] / (n - 1 - most)) + 2 * k AS aic
  FROM lags JOIN (SELECT DISTINCT metric, n, most FROM levels) USING (metric) WHERE k >= 2),
best AS (SELECT metric, arg_min(lags, aic) AS lags, any_value(n) AS n FROM informed GROUP BY metric),
best_rows AS (SELECT h.*, b.lags AS chosen FROM histories h JOIN best b USING (metric) WHERE spot > b.lags),
{gram('fit', 'best_rows', 'list_concat([1.0], before[1:chosen], [level, change])')},
ends AS (
  SELECT metric, lags, n - 3 - 2 * lags AS freedom, a[(p - 2) * p + p - 1] AS xx, a[(p - 2) * p + p] AS xy, a[p * p] AS yy
  FROM fit JOIN best USING (metric) WHERE k = p - 2),
rooted AS (SELECT metric, lags, xy / xx / sqrt((yy - xy * xy / xx) / freedom / xx) AS t FROM ends),
surfaces AS (
  SELECT *, CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t
    ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END AS z FROM rooted),
adf AS (
  SELECT metric, lags, t, CASE WHEN t < -18.83 OR z < -8 THEN 0.0 WHEN t > 2.74 THEN 1.0 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi())
    * list_sum(list_transform(range(150), lambda k: exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))) END AS p
  FROM surfaces)"""
RECURSIVE = ON_ORDERS.replace("WITH ", "WITH RECURSIVE ", 1)

QUERIES = [
    Query(
        "daily_series",
        lambda load: rounded(series.daily_series(_cents(load), "o_orderdate", CENTS_NUMBERS), 4),
        ON_ORDERS + "\n" + SERIES.format(value=r("value", 4), table="gaps"),
    ),
    Query(
        "interpolate_linear",
        lambda load: rounded(_orders(load), 4),
        ON_ORDERS + "\n" + SERIES.format(value=r("value", 4), table="series"),
    ),
    Query("forward_fill", lambda load: ordered.forward_fill(_with_gaps(load), "o_orderkey", ["price", "customer"]), fill_sql("")),
    Query(
        "forward_fill_by_key",
        lambda load: ordered.forward_fill(_with_gaps(load), "o_orderkey", ["price", "customer"], ["o_orderpriority"]),
        fill_sql("PARTITION BY o_orderpriority"),
    ),
    Query("linear_trend", lambda load: rounded(series.linear_trend(_orders(load)), 4, slope=5), ON_ORDERS + TREND),
    Query("volatility", lambda load: rounded(series.volatility(_orders(load)), 5), ON_ORDERS + VOLATILITY),
    Query("change_points", lambda load: rounded(series.change_points(_orders(load)), 4), ON_ORDERS + CHANGE_POINTS),
    Query("date_span", lambda load: rounded(series.date_span(load("events"), "ts")), DATE_SPAN),
    Query("acf", lambda load: rounded(series.acf(_orders(load))), ON_ORDERS + ACF),
    Query(
        "lag1_autocorr",
        lambda load: rounded(series.lag1_autocorr(_orders(load)), 5),
        ON_ORDERS + f",\n{LAG1} SELECT metric, {r('lag1', 5)} AS lag1, abs(lag1) > 0.7 AS has_strong_autocorr FROM links",
    ),
    Query(
        "seasonal_decompose",
        lambda load: rounded(seasonal.seasonal_decompose(_orders(load)), 3),
        ON_ORDERS + ",\n" + DECOMPOSED + DECOMPOSE_ROWS,
    ),
    Query(
        "seasonal_decompose_odd",
        lambda load: rounded(seasonal.seasonal_decompose(_events(load)), 3),
        ON_EVENTS + ",\n" + DECOMPOSED + DECOMPOSE_ROWS,
    ),
    Query(
        "decomposition_table",
        lambda load: rounded(seasonal.decomposition_table(_cents(load), "o_orderdate"), 3),
        LARGEST_DECOMPOSED,
    ),
    Query(
        "seasonality_strength",
        lambda load: rounded(seasonal.seasonality_strength(seasonal.seasonal_decompose(_orders(load))), 5),
        ON_ORDERS + f",\n{DECOMPOSED},\n{STRENGTH} SELECT metric, {r('strength', 5)} AS strength, strength > 0.5 AS has_seasonality FROM strengths",
    ),
    Query(
        "seasonal_extremes",
        lambda load: rounded(seasonal.seasonal_extremes(seasonal.seasonal_decompose(_orders(load))), 4),
        ON_ORDERS + ",\n" + DECOMPOSED + EXTREMES,
    ),
    Query(
        "seasonal_trend",
        lambda load: rounded(seasonal.seasonal_trend(seasonal.seasonal_decompose(_orders(load))), 5),
        ON_ORDERS + ",\n" + DECOMPOSED + SEASONAL_TREND,
    ),
    Query(
        "dominant_periods",
        lambda load: rounded(seasonal.dominant_periods(_orders(load)), 2),
        ON_ORDERS + f",\n{PERIODS} SELECT metric, rank, k, period, {r('magnitude', 2)} AS magnitude FROM periods",
    ),
    Query(
        "kruskal_by_phase",
        lambda load: rounded(seasonal.kruskal_by_phase(_orders(load)), 4),
        ON_ORDERS + f",\n{KRUSKAL} SELECT metric, {r('statistic', 4)} AS statistic FROM kruskal",
    ),
    Query(
        "seasonality",
        lambda load: rounded(seasonal.seasonality(_events(load)), 5, statistic=4),
        ON_EVENTS + f",\n{DECOMPOSED},\n{STRENGTH},\n{PERIODS},\n{KRUSKAL}" + SEASONALITY,
    ),
    Query(
        "row_series_profile",
        lambda load: rounded(ordered.row_series_profile(
            load("orders").select("o_orderdate", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price")),
            "o_orderdate"), 4),
        ROW_SERIES,
    ),
    Query(
        "adf_test", lambda load: rounded(forecast.adf_test(_orders(load)), 5),
        RECURSIVE + f""",\n{UNIT_ROOT}
SELECT metric, {r('t', 5)} AS statistic, lags::BIGINT AS lags, {r('p', 5)} AS p_value, p < 0.05 AS is_stationary, p >= 0.05 AS needs_differencing FROM adf""",
    ),
    Query(
        "forecast_readiness",
        lambda load: rounded(forecast.forecast_readiness(_orders(load), stationarity=False), 5, missing_ratio=6),
        ON_ORDERS + f",\n{DECOMPOSED},\n{STRENGTH},\n{LAG1}" + READINESS,
    ),
    Query(
        "forecast_readiness_full", lambda load: rounded(forecast.forecast_readiness(_orders(load)), 5, missing_ratio=6),
        RECURSIVE + f""",\n{DECOMPOSED},\n{STRENGTH},\n{LAG1},\n{UNIT_ROOT}
SELECT ready.*, {r('p', 5)} AS p_value, p < 0.05 AS is_stationary, p >= 0.05 AS needs_differencing FROM ({READINESS}) AS ready JOIN adf USING (metric)""",
    ),
    Query(
        "suggest_forecast_models",
        lambda load: rounded(forecast.suggest_forecast_models(_orders(load))),
        ON_ORDERS + f",\n{DECOMPOSED},\n{STRENGTH}" + MODELS,
    ),
]
