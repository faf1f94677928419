"""Is a daily series fit for forecasting, and with what kind of model."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.expressions import ratio
from plumbline.functions.storage import stored
from plumbline.operators.seasonal import seasonal_decompose, seasonality_strength
from plumbline.operators.series import lag1_autocorr, series_ids

# Response surface of the unit-root p-value with a constant
# (MacKinnon 1994), polynomial coefficients from the constant term up.
TAU_MIN, TAU_STAR, TAU_MAX = -18.83, -1.61, 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
SIGNIFICANCE = 0.05

# Fixed values of the suitability rule and the model suggestions.
ENOUGH_DAYS, MISSING_LIMIT, TREND_SHARE = 30, 0.2, 0.1


# Terms of the series for the normal distribution; more than enough for eight deviations.
NORMAL_TERMS = 150


def _normal(z: Column) -> Column:
    """The normal distribution function: 1/2 plus the density times z + z^3/3 + z^5/15 + ..."""
    near = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    empty = F.struct(near.alias("term"), near.alias("total"))

    def more(state: Column, k: Column) -> Column:
        term = state["term"] * near * near / (2 * k + 1)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(NORMAL_TERMS)), empty, more)["total"]
    return 0.5 + total * F.exp(-near * near / 2) / math.sqrt(2 * math.pi)


def unit_root_p(t: Column) -> Column:
    """p-value of a unit-root statistic."""

    def surface(coefficients: Sequence[float]) -> Column:
        z = F.lit(0.0)
        for c in reversed(coefficients):
            z = z * t + c
        return z

    z = F.when(t <= TAU_STAR, surface(SMALL_P)).otherwise(surface(LARGE_P))
    return F.when(t < TAU_MIN, 0.0).when(t > TAU_MAX, 1.0).when(t.isNotNull(), _normal(z))


# The factor of a symmetric matrix whose lower triangle is the flat array ``g``, row by row; ``size`` rows. The last entry
# of a row is its length beside the rows above; a row that depends on them has none.
_DOT = "aggregate(zip_with({a}, slice({b}, 1, size({a})), (x, y) -> x * y), 0D, (s, x) -> s + x)"
_FACTOR = f"""aggregate(sequence(0, size - 1), cast(array() AS array<array<double>>), (rows, i) -> array_append(rows,
  aggregate(sequence(0, i), cast(array() AS array<double>), (own, j) -> array_append(own, CASE
    WHEN j = i THEN sqrt(greatest(g[int(i * (i + 1) div 2 + j)] - {_DOT.format(a='own', b='own')}, 0D))
    WHEN rows[j][j] > 1e-9 * sqrt(g[int(j * (j + 1) div 2 + j)])
      THEN (g[int(i * (i + 1) div 2 + j)] - {_DOT.format(a='own', b='rows[j]')}) / rows[j][j]
    ELSE 0D END))))"""


def _factors(rows: DataFrame, ids: list[str], vector: Column) -> DataFrame:
    """(ids, factor, size): the Cholesky factor of the sums of products of the vectors' entries, one aggregate per pair of entries."""
    products = rows.select(*ids, vector.alias("v")).select(*ids, "v", F.posexplode("v").alias("i", "a")).select(
        *ids, "i", F.posexplode(F.expr("transform(slice(v, 1, i + 1), b -> a * b)")).alias("j", "ab")
    )
    sums = products.groupBy(*ids, "i", "j").agg(F.sum("ab").alias("s"))
    flat = sums.groupBy(*ids).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "s"))), lambda p: p["s"]).alias("g"), (F.max("i") + 1).alias("size")
    )
    return flat.select(*ids, F.expr(_FACTOR).alias("factor"), "size")


def adf_test(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, statistic, lags, p_value, is_stationary, needs_differencing).

    Augmented Dickey-Fuller test with a constant. The sums of products of the level and the lagged changes are one
    aggregate; the factor of their matrix grows by one lag at a time, so it gives the residuals of all models at once, and the
    number of lags with the least AIC is read from it. A second aggregate, over all days that the chosen
    lags leave, gives the statistic. Constant or too short series give nulls.
    """
    ids = series_ids(keys)
    days, every = W.partitionBy(*ids).orderBy("at"), W.partitionBy(*ids)
    known = series.where("value is not null").select(
        *ids, "value", (F.row_number().over(W.partitionBy(*ids).orderBy("pos")) - 1).alias("at")
    )
    sized = known.select(
        *ids, "at", F.count(F.lit(1)).over(every).alias("n"),
        # In deviations from the mean; the statistic does not depend on either.
        ratio(F.col("value") - F.avg("value").over(every), F.nullif(F.stddev_pop("value").over(every), F.lit(0.0))).alias("x"),
        (F.max("value").over(every) > F.min("value").over(every)).alias("varied"),
    )
    most = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2).cast("int")
    longest = math.ceil(12 * (max(known.groupBy(*ids).count().agg(F.max("count")).first()[0] or 1, 1) / 100) ** 0.25)
    changes = sized.where("varied").select(
        *ids, "at", "n", most.alias("most"), F.lag("x").over(days).alias("level"), (F.col("x") - F.lag("x").over(days)).alias("change")
    )
    before = F.collect_list("change").over(days.rowsBetween(-longest, -1))
    rows = stored(changes.select("*", before.alias("before")).where("at >= 1 AND most >= 0"))

    def lagged(lags: str) -> Column:
        return F.expr(f"if({lags} = 0, cast(array() AS array<double>), reverse(slice(before, -greatest({lags}, 1), greatest({lags}, 1))))")

    one, level, change = F.array(F.lit(1.0)), F.array("level"), F.array("change")
    factors = _factors(rows.where("at > most"), ids, F.concat(one, level, lagged("most"), change))
    # The last row holds the response; what the first entries leave of it is the residual of the model with as many regressors.
    facts = rows.groupBy(*ids).agg(F.first("most").alias("most"), F.first("n").alias("n"))
    size = F.col("n") - 1 - F.col("most")
    rest = F.expr("aggregate(slice(last, lags + 3, size(last)), 0D, (s, x) -> s + x * x)")
    models = (
        factors.join(facts, ids).withColumn("last", F.element_at("factor", -1))
        .select(*ids, "n", "most", "last", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("lags"))
        .withColumn("aic", size * F.log(F.greatest(rest, F.lit(1e-300)) / size) + 2 * (F.col("lags") + 2))
    )
    chosen = models.groupBy(*ids).agg(F.min(F.struct("aic", "lags"))["lags"].alias("lags"), F.first("n").alias("n"))
    fitted = _factors(
        rows.join(chosen.select(*ids, "lags"), ids).where("at > lags"), ids, F.concat(one, lagged("lags"), level, change)
    ).join(chosen, ids)
    response = F.element_at("factor", -1)
    freedom = F.col("n") - 1 - F.col("lags") - (F.col("lags") + 2)
    # The last but one entry of the response's row belongs to the level, the last one is the residual.
    statistic = ratio(F.element_at(response, -2), F.nullif(F.element_at(response, -1), F.lit(0.0)) / F.sqrt(F.greatest(freedom, F.lit(1))))
    tested = series.select(*ids).distinct().join(
        fitted.where(freedom > 0).select(*ids, statistic.alias("statistic"), F.col("lags").cast("int").alias("lags")), ids, "left"
    )
    p = unit_root_p(F.col("statistic"))
    stationary = F.coalesce(F.col("p_value") < SIGNIFICANCE, F.lit(False))
    return tested.select(*ids, "statistic", F.when(F.col("statistic").isNotNull(), F.col("lags")).alias("lags"), p.alias("p_value")).withColumn(
        "is_stationary", stationary).withColumn("needs_differencing", ~stationary)


def _strength(series: DataFrame, keys: Sequence[str], decomposed: DataFrame | None) -> DataFrame:
    return seasonality_strength(seasonal_decompose(series, keys) if decomposed is None else decomposed, keys)


def series_quality(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, data_points, missing_ratio, frequency)."""
    return series.groupBy(*series_ids(keys)).agg(
        F.count(F.lit(1)).alias("data_points"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing_ratio"),
        F.first(F.lit("daily")).alias("frequency"),
    )


def forecast_readiness(
    series: DataFrame, keys: Sequence[str] = (), stationarity: bool = True, decomposed: DataFrame | None = None
) -> DataFrame:
    """Quality, autocorrelation, seasonality, stationarity and suitability per series. The series is read by each part, so it is stored unless
    the caller has done so, as its decomposition shows."""
    ids = series_ids(keys)
    if decomposed is None:
        series = stored(series)
    ready = (
        series_quality(series, keys)
        .join(lag1_autocorr(series, keys), ids)
        .join(_strength(series, keys, decomposed), ids, "left")
    )
    if stationarity:
        ready = ready.join(adf_test(series, keys).drop("statistic", "lags"), ids)
    suitable = (
        (F.col("data_points") >= ENOUGH_DAYS)
        & (F.col("missing_ratio") < MISSING_LIMIT)
        & F.col("has_strong_autocorr")
    )
    return (
        ready.withColumn("has_seasonality", F.coalesce("has_seasonality", F.lit(False)))
        .withColumnRenamed("strength", "seasonality_strength")
        .withColumn("suitable_for_forecasting", suitable)
    )


def suggest_forecast_models(
    series: DataFrame, keys: Sequence[str] = (), decomposed: DataFrame | None = None
) -> DataFrame:
    """(metric, position, model): kinds of model in order of mention."""
    ids = series_ids(keys)
    facts = (
        series.groupBy(*ids)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_slope("value", F.col("pos").cast("double")).alias("slope"),
            F.stddev_samp("value").alias("deviation"),
        )
        .join(_strength(series, keys, decomposed), ids, "left")
    )
    n = F.col("n")
    trended = (n >= 10) & (F.abs("slope") > TREND_SHARE * F.col("deviation"))
    models = F.array_compact(
        F.array(
            F.lit("ARIMA"),
            F.when((n >= ENOUGH_DAYS) & F.col("has_seasonality"), "SARIMA"),
            F.when(trended, "Prophet"),
            F.when(trended, "Exponential Smoothing"),
            F.when(n >= 100, "LSTM"),
            F.when(n >= 1000, "Neural Prophet"),
        )
    )
    return facts.select(*ids, F.posexplode(models).alias("position", "model"))
