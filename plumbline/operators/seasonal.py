"""Seasonality of daily series: decomposition, periods, tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.expressions import ratio
from plumbline.functions.storage import stored
from plumbline.operators.series import daily_metrics, in_order, series_ids, whole
from plumbline.operators.stats import max_variance_column

# Longest seasonal period in days, strength that counts as seasonal,
# number of leading frequencies, number of interleaved groups in the rank test.
LONGEST_PERIOD = 30
SEASONAL = 0.5
LEADING = 5
PHASES = 12
ENOUGH_FOR_RANKS = 24


def seasonal_decompose(
    series: DataFrame, keys: Sequence[str] = (), longest_period: int = LONGEST_PERIOD
) -> DataFrame:
    """(metric, day, pos, observed, trend, seasonal, residual, period).

    Classical additive decomposition: centred moving average over one period
    (half weights at the ends of an even period), mean detrended value per
    phase centred to zero, rest. Trend and residual are null near the ends.
    All steps are windows over the series, so one shuffle by series is enough.
    """
    half = longest_period // 2
    period, h = F.col("period"), F.col("h")
    sized = (
        series.withColumn("n", F.count(F.lit(1)).over(whole(keys)))
        .where("n >= 4")
        .withColumn("period", F.least(F.lit(longest_period), F.floor(F.col("n") / 2)).cast("int"))
        .withColumn("h", F.floor(period / 2).cast("int"))
        .withColumn(
            "near",
            F.collect_list(F.struct("pos", "value")).over(in_order(keys).rowsBetween(-half, half)),
        )
    )

    def weighted(point: Column) -> Column:
        distance = F.abs(point["pos"] - F.col("pos"))
        edge = F.when(period % 2 == 0, 0.5).otherwise(1.0)
        weight = F.when(distance < h, 1.0).when(distance == h, edge).otherwise(0.0)
        return F.when(distance > h, F.lit(0.0)).otherwise(weight * point["value"])

    total = F.aggregate("near", F.lit(0.0), lambda acc, point: acc + weighted(point))
    inside = (F.col("pos") >= h) & (F.col("pos") <= F.col("n") - 1 - h)
    trended = sized.withColumn("trend", F.when(inside, total / period)).withColumn(
        "phase", F.col("pos") % period
    )
    by_phase = W.partitionBy(*series_ids(keys), "phase")
    phased = trended.withColumn("phase_mean", F.avg(F.col("value") - F.col("trend")).over(by_phase))
    centre = F.avg(F.when(F.col("pos") < period, F.col("phase_mean"))).over(whole(keys))
    seasonal = phased.withColumn("seasonal", F.col("phase_mean") - centre)
    return seasonal.select(
        *series_ids(keys), "day", "pos",
        F.col("value").alias("observed"),
        "trend", "seasonal",
        (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"),
        "period",
    )


def seasonality_strength(decomposed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, strength, has_seasonality): mean abs(seasonal) over mean abs(residual)."""
    return decomposed.groupBy(*series_ids(keys)).agg(
        ratio(F.avg(F.abs("seasonal")), F.avg(F.abs("residual"))).alias("strength")
    ).withColumn("has_seasonality", F.coalesce(F.col("strength") > SEASONAL, F.lit(False)))


def seasonal_extremes(decomposed: DataFrame, k: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, kind, rank, day, seasonal): the k highest and lowest days, earliest first on ties."""
    parts = []
    for kind, order in (("peak", F.desc("seasonal")), ("trough", F.asc("seasonal"))):
        best = W.partitionBy(*series_ids(keys)).orderBy(order, "day")
        parts.append(
            decomposed.where("seasonal is not null")
            .withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k)
            .select(*series_ids(keys), F.lit(kind).alias("kind"), "rank", "day", "seasonal")
        )
    return parts[0].unionByName(parts[1])


def seasonal_trend(decomposed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, direction, strength): last known trend value against the first."""
    known = F.when(F.col("trend").isNotNull(), F.col("pos"))
    ends = decomposed.groupBy(*series_ids(keys)).agg(
        F.min_by("trend", known).alias("first"),
        F.max_by("trend", known).alias("last"),
        F.stddev_samp("observed").alias("deviation"),
    )
    rise = F.col("last") - F.col("first")
    return ends.select(
        *series_ids(keys),
        F.when(rise > 0, "increasing").otherwise("decreasing").alias("direction"),
        ratio(F.abs(rise), F.col("deviation")).alias("strength"),
    )


# A series is summed up in two stages if its length has factors whose sum is at most this many times its root.
EVEN_FACTORS = 16


def _turned(re: Column, im: Column, number: Column, of: Column) -> list[Column]:
    """A complex value times exp(-2 pi i number / of); the angle is taken from whole numbers, so that it stays exact."""
    angle = 2 * math.pi * (number % of) / of
    return [(re * F.cos(angle) + im * F.sin(angle)).alias("re"), (im * F.cos(angle) - re * F.sin(angle)).alias("im")]


def _transform(points: DataFrame, ids: Sequence[str], half: bool) -> DataFrame:
    """(ids, n, k, re, im) of points (ids, n, n1, at, re, im): the discrete Fourier transform of length n = n1 * n2 in two stages.

    Sums over every n2-th point, a turn, and sums over those: n * (n1 + n2) rows instead of n * n. Absent points are
    zero. With ``half`` only k up to n / 2.
    """
    key = [*ids, "n", "n1"]
    n, n1, n2 = F.col("n"), F.col("n1"), F.expr("n div n1")
    re, im = F.col("re"), F.col("im")
    sums = [F.sum("re").alias("re"), F.sum("im").alias("im")]
    first = (
        points.select(*key, (F.col("at") % n2).alias("j2"), F.expr("at div (n div n1)").alias("j1"), "re", "im",
                      F.explode(F.sequence(F.lit(0).cast("long"), n1 - 1)).alias("k1"))
        .select(*key, "j2", "k1", *_turned(re, im, F.col("j1") * F.col("k1"), n1))
        .groupBy(*key, "j2", "k1").agg(*sums)
        .select(*key, "j2", "k1", *_turned(re, im, F.col("j2") * F.col("k1"), n))
    )
    # The last k2 of k = k1 + n1 * k2 that is wanted.
    last = F.expr("(n div 2 - k1) div n1") if half else n2 - 1
    reach = first.where("k1 <= n div 2") if half else first
    return (
        reach.select(*key, "k1", "j2", "re", "im", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k2"))
        .select(*key, "k1", "k2", *_turned(re, im, F.col("j2") * F.col("k2"), n2))
        .groupBy(*key, "k1", "k2").agg(*sums)
        .select(*ids, "n", (F.col("k1") + n1 * F.col("k2")).alias("k"), "re", "im")
    )


def _chirped(points: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The transform of lengths without good factors, as a product of transforms of a longer length that has them (Bluestein)."""
    n, at, k = F.col("n"), F.col("at"), F.col("k")
    re, im = F.col("re"), F.col("im")
    # The longer length, at least 2 n - 1, and its first factor.
    side = F.ceil(F.sqrt(2 * n - 1)).cast("long")
    longer = side * F.ceil((2 * n - 1) / side).cast("long")
    signal = points.select(*ids, n.alias("own"), side.alias("n1"), longer.alias("n"), "at", *_turned(re, im, at * at, 2 * n))
    one = [F.lit(1.0), F.lit(0.0)]
    chirp = (
        points.select("n").distinct().select("n", F.explode(F.sequence(1 - n, n - 1)).alias("d"))
        .select(n.alias("own"), side.alias("n1"), longer.alias("n"), F.pmod("d", longer).alias("at"), *_turned(*one, -(F.col("d") * F.col("d")), 2 * n))
    )
    a = _transform(signal, [*ids, "own"], half=False)
    b = _transform(chirp, ["own"], half=False).select("own", "k", F.col("re").alias("bre"), F.col("im").alias("bim"))
    side_of = F.ceil(F.sqrt(2 * F.col("own") - 1)).cast("long")
    # The inverse transform is the transform of the conjugate, conjugated.
    product = a.join(b, ["own", "k"]).select(
        *ids, "own", "n", side_of.alias("n1"), k.alias("at"),
        (re * F.col("bre") - im * F.col("bim")).alias("re"), (-(re * F.col("bim") + im * F.col("bre"))).alias("im"),
    )
    back = _transform(product, [*ids, "own"], half=False).where("k <= own div 2")
    return back.select(
        *ids, F.col("own").alias("n"), "k", (re / n).alias("re"), (-im / n).alias("im")
    ).select(*ids, "n", "k", *_turned(re, im, k * k, 2 * n))


def spectrum(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, k, n, magnitude) of the discrete Fourier transform, 0 <= k <= n/2.

    Days without a value are left out. The work of a series of n days is about n to the power 1.5, whatever its
    length, and spreads over the tasks.
    """
    ids = series_ids(keys)
    factors = "filter(sequence(1L, cast(floor(sqrt(n)) AS bigint)), d -> n % d = 0)"
    known = stored(series.where("value is not null").select(
        *ids, F.col("value").alias("re"), F.lit(0.0).alias("im"),
        (F.row_number().over(W.partitionBy(*ids).orderBy("pos")) - 1).cast("long").alias("at"),
        F.count(F.lit(1)).over(W.partitionBy(*ids)).alias("n"),
    ).withColumn("n1", F.array_max(F.expr(factors))))
    even = F.col("n1") + F.expr("n div n1") <= EVEN_FACTORS * F.sqrt("n")
    found = _transform(known.where(even), ids, half=True)
    if not known.where(~even).isEmpty():
        found = found.unionByName(_chirped(known.where(~even), ids))
    return found.select(*ids, "k", "n", F.hypot("re", "im").alias("magnitude"))


def dominant_periods(series: DataFrame, keys: Sequence[str] = (), leading: int = LEADING) -> DataFrame:
    """(metric, rank, k, period, magnitude), weakest first as rank 1.

    The ``leading`` strongest of all n frequencies are taken; the positive ones
    among them give periods, kept between 2 days and a third of the series.
    A frequency and its mirror image are equally strong, the positive one first.
    """
    alone = (F.col("k") == 0) | (2 * F.col("k") == F.col("n"))
    signs = F.when(alone, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(-1)))
    slots = spectrum(series, keys).select("*", F.explode(signs).alias("sign"))
    strongest = W.partitionBy(*series_ids(keys)).orderBy(
        F.desc("magnitude"), F.desc("sign"), "k"
    )
    kept = (
        slots.withColumn("slot", F.row_number().over(strongest))
        .where((F.col("slot") <= leading) & (F.col("sign") > 0))
        .withColumn("period", F.floor(F.col("n") / F.col("k")))
        .where((F.col("period") >= 2) & (F.col("period") <= F.floor(F.col("n") / 3)))
    )
    weakest = W.partitionBy(*series_ids(keys)).orderBy(F.desc("slot"))
    return kept.select(
        *series_ids(keys), F.row_number().over(weakest).alias("rank"), "k", "period", "magnitude"
    )


def kruskal_by_phase(series: DataFrame, phases: int = PHASES, keys: Sequence[str] = ()) -> DataFrame:
    """(metric, statistic): Kruskal-Wallis H of the groups pos % phases, null for
    series of fewer than 24 days or of one value only."""
    ids = series_ids(keys)
    values = series.where("value is not null")
    by_value = W.partitionBy(*ids).orderBy("value")
    equal = W.partitionBy(*ids, "value")
    ranked = values.select(
        *ids,
        (F.col("pos") % phases).alias("phase"),
        F.count(F.lit(1)).over(equal).cast("double").alias("ties"),
        F.rank().over(by_value).alias("low_rank"),
    ).withColumn("mean_rank", F.col("low_rank") + (F.col("ties") - 1) / 2)
    groups = ranked.groupBy(*ids, "phase").agg(
        F.sum("mean_rank").alias("rank_sum"),
        F.count(F.lit(1)).cast("double").alias("size"),
        # Each of t tied values adds t^2 - 1, so a tied set adds t^3 - t.
        F.sum(F.col("ties") * F.col("ties") - 1).alias("tied"),
    )
    n = F.sum("size")
    h = 12 / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("size")) - 3 * (n + 1)
    return groups.groupBy(*ids).agg(n.alias("n"), h.alias("h"), F.sum("tied").alias("tied")).select(
        *ids,
        F.when(
            F.col("n") >= ENOUGH_FOR_RANKS,
            ratio(F.col("h"), 1 - F.col("tied") / (F.col("n") * F.col("n") * F.col("n") - F.col("n"))),
        ).alias("statistic"),
    )


def seasonality(
    series: DataFrame, keys: Sequence[str] = (), decomposed: DataFrame | None = None
) -> DataFrame:
    """(metric, strength, n_periods, statistic, is_seasonal): a strong component
    and at least one dominant period."""
    ids = series_ids(keys)
    if decomposed is None:
        # The parts read the series several times; it is as long as its calendar.
        series = stored(series)
        decomposed = seasonal_decompose(series, keys)
    periods = dominant_periods(series, keys).groupBy(*ids).agg(F.count(F.lit(1)).alias("n_periods"))
    return (
        seasonality_strength(decomposed, keys)
        .join(periods, ids, "left")
        .join(kruskal_by_phase(series, keys=keys), ids, "left")
        .select(
            *ids,
            "strength",
            F.coalesce("n_periods", F.lit(0)).alias("n_periods"),
            "statistic",
            (F.col("has_seasonality") & F.col("n_periods").isNotNull()).alias("is_seasonal"),
        )
    )


def decomposition_table(df: DataFrame, date_column: str, column: str | None = None) -> DataFrame:
    """Decomposition of the column with the largest variance, or of a named one."""
    if column is None:
        column = max_variance_column(df).first()["column"]  # one row
    return seasonal_decompose(daily_metrics(df, date_column, [column]))
