"""Daily series: resampling, gaps, trend, volatility, change points.

A series is a table (metric, *keys, day, pos, value) with one row per calendar
day. Rows are reduced to days before any window runs, so a window partition is
as long as the calendar, never as long as the table; ``keys`` split the work
into one series per key and metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.expressions import col, number, numeric_columns, ratio

# Fixed value: a volatility below this is called stable.
STABLE = 0.1
# Fixed value: day-to-day changes beyond this many deviations are significant.
SIGNIFICANT = 2.0


def series_ids(keys: Sequence[str]) -> list[str]:
    return ["metric", *keys]


def in_order(keys: Sequence[str] = ()):
    return W.partitionBy(*series_ids(keys)).orderBy("pos")


def whole(keys: Sequence[str] = ()):
    return W.partitionBy(*series_ids(keys))


def daily_series(
    df: DataFrame,
    date_column: str,
    metrics: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    first: int | None = None,
) -> DataFrame:
    """Mean per calendar day; days without rows are present with a null value.

    All numeric columns unless ``metrics`` names some or ``first`` limits them.

    Rows without a date are ignored. Gap days come from the next observed day,
    so no calendar table is joined.
    """
    metrics = numeric_columns(df)[:first] if metrics is None else list(metrics)
    days = (
        df.where(col(date_column).isNotNull())
        .groupBy(*[col(k) for k in keys], F.to_date(col(date_column)).alias("day"))
        .agg(*[F.avg(number(m)).alias(f"v{i}") for i, m in enumerate(metrics)])
    )
    values = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"v{i}").alias("value")) for i, m in enumerate(metrics)]
    )
    long = days.select(*[col(k) for k in keys], "day", F.inline(values))
    by_day = W.partitionBy(*series_ids(keys)).orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), F.col("day"))
    stretched = long.select(
        "*",
        F.min("day").over(by_day).alias("start"),  # running minimum in day order: the first day
        until.alias("until"),
    )
    filled = stretched.select(
        "*", F.explode(F.sequence("day", "until", F.expr("interval 1 day"))).alias("date")
    )
    return filled.select(
        *series_ids(keys),
        F.col("date").alias("day"),
        F.datediff("date", "start").alias("pos"),
        F.when(F.col("date") == F.col("day"), F.col("value")).alias("value"),
    )


def interpolate_linear(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fill gaps on the line between their neighbours; leading gaps stay null,
    trailing ones repeat the last value."""
    ids = series_ids(keys)
    known = F.when(F.col("value").isNotNull(), F.struct("pos", "value"))
    forwards = W.partitionBy(*ids).orderBy("pos")
    backwards = W.partitionBy(*ids).orderBy(F.desc("pos"))
    # The look-ahead runs over the reversed order: a running frame costs one step per row.
    neighbours = series.select(
        "*",
        F.last(known, ignorenulls=True).over(forwards).alias("before"),
        F.last(known, ignorenulls=True).over(backwards).alias("after"),
    )
    step = ratio(
        F.col("after.value") - F.col("before.value"), F.col("after.pos") - F.col("before.pos")
    )
    # Slope first, as linear interpolation is customarily computed: ties depend on the rounding.
    line = step * (F.col("pos") - F.col("before.pos")) + F.col("before.value")
    value = (
        F.when(F.col("value").isNotNull(), F.col("value"))
        .when(F.col("before").isNull(), F.lit(None))
        .when(F.col("after").isNull(), F.col("before.value"))
        .otherwise(line)
    )
    return neighbours.select(*ids, "day", "pos", value.alias("value"))


def daily_metrics(
    df: DataFrame, date_column: str, metrics: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """The daily series without gaps, on which the analyses below work."""
    return interpolate_linear(daily_series(df, date_column, metrics, keys), keys)


def date_span(df: DataFrame, date_column: str) -> DataFrame:
    """(start_date, end_date, span_days): whole days between first and last moment."""
    moment = col(date_column)
    return df.agg(F.min(moment).alias("first"), F.max(moment).alias("last")).select(
        F.to_date("first").alias("start_date"),
        F.to_date("last").alias("end_date"),
        F.timestamp_diff("DAY", F.col("first"), F.col("last")).alias("span_days"),
    )


def _per_series(series: DataFrame, keys: Sequence[str]):
    return series.groupBy(*series_ids(keys))


def linear_trend(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, slope, direction, total_change, percent_change): least squares on
    the day offset, last value against first."""
    fitted = _per_series(series, keys).agg(
        F.regr_slope("value", F.col("pos").cast("double")).alias("slope"),
        F.min_by("value", "pos").alias("first"),
        F.max_by("value", "pos").alias("last"),
    )
    return fitted.select(
        *series_ids(keys),
        "slope",
        F.when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("direction"),
        (F.col("last") - F.col("first")).alias("total_change"),
        ((ratio(F.col("last"), F.col("first")) - 1) * 100).alias("percent_change"),
    )


def with_change(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The series with its first difference in ``change``."""
    return series.withColumn(
        "change", F.col("value") - F.lag("value").over(in_order(keys))
    )


def volatility(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, volatility, momentum, stability): deviation over mean, mean daily
    change. A negative mean makes the ratio negative and therefore "stable"."""
    measured = _per_series(with_change(series, keys), keys).agg(
        ratio(F.stddev_samp("value"), F.avg("value")).alias("volatility"),
        F.avg("change").alias("momentum"),
    )
    return measured.withColumn(
        "stability", F.when(F.col("volatility") < STABLE, "stable").otherwise("volatile")
    )


def change_points(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, max_increase, max_decrease, significant_changes)."""
    changes = with_change(series, keys).withColumn(
        "deviation", F.stddev_samp("change").over(whole(keys))
    )
    large = F.abs("change") > SIGNIFICANT * F.col("deviation")
    return _per_series(changes, keys).agg(
        F.max("change").alias("max_increase"),
        F.min("change").alias("max_decrease"),
        F.count(F.when(large, 1)).alias("significant_changes"),
    )


def acf(series: DataFrame, lags: Sequence[int] = (1, 7, 30), keys: Sequence[str] = ()) -> DataFrame:
    """(metric, lag, acf): biased autocorrelation, null where the series is too short."""
    centred = series.where("value is not null").select(
        *series_ids(keys), "pos", (F.col("value") - F.avg("value").over(whole(keys))).alias("x")
    )
    lagged = centred.select(
        "*", *[F.lag("x", k).over(in_order(keys)).alias(f"lag{k}") for k in lags]
    )
    sums = _per_series(lagged, keys).agg(
        F.sum(F.col("x") * F.col("x")).alias("squares"),
        *[F.sum(F.col("x") * F.col(f"lag{k}")).alias(f"s{k}") for k in lags],
    )
    rows = F.array(
        *[F.struct(F.lit(k).alias("lag"), ratio(F.col(f"s{k}"), F.col("squares")).alias("acf")) for k in lags]
    )
    return sums.select(*series_ids(keys), F.inline(rows))


def lag1_autocorr(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, lag1, has_strong_autocorr): Pearson r of a day with the day before."""
    pairs = series.select(
        *series_ids(keys), F.col("value").alias("x"), F.lag("value").over(in_order(keys)).alias("y")
    ).where("x is not null and y is not null")
    measured = _per_series(pairs, keys).agg(
        ratio(
            F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")
        ).alias("lag1")
    )
    # Series with fewer than two pairs still get their row.
    return series.select(*series_ids(keys)).distinct().join(measured, series_ids(keys), "left").withColumn(
        "has_strong_autocorr", F.coalesce(F.abs("lag1") > 0.7, F.lit(False))
    )
