"""Descriptive statistics: one row per column, all columns in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.expressions import (
    col,
    group_key,
    number,
    numeric_columns,
    per_column,
    ratio,
    unfold,
)
from plumbline.operators.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)
# Fixed value: how many quartile ranges beyond the quartiles a value is an outlier.
FENCE = 1.5
# Fixed value: z-scores beyond this are outliers.
Z_LIMIT = 3.0


def table_shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns, column, column_pos, dtype), one row per column."""
    columns = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    wide = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(columns)).alias("n_columns"),
        *[F.lit(types[c]).alias(f"dtype_{i}") for i, c in enumerate(columns)],
    )
    return unfold(wide, columns, ["dtype"], ["n_rows", "n_columns"])


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, column_pos, n_null, n_rows)."""
    return per_column(
        df,
        list(columns or df.columns),
        {"n_null": lambda c: F.count(F.when(col(c).isNull(), 1))},
        {"n_rows": F.count(F.lit(1))},
    )


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: 1 minus the mean over columns of the share of nulls."""
    columns = list(columns or df.columns)
    nulls = sum((F.count(F.when(col(c).isNull(), 1)) for c in columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(columns)
    return df.agg((1 - ratio(nulls, cells)).alias("completeness"))


SUMMARY_SCHEMA = (
    "column string, column_pos int, count bigint, mean double, std double, "
    "min double, q25 double, q50 double, q75 double, max double"
)


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample std, minimum, quartiles and maximum per numeric column.

    The result has one row per column, whatever the size of the table.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    spark = df.sparkSession
    if not columns:
        return spark.createDataFrame([], SUMMARY_SCHEMA)
    moments = per_column(
        df,
        columns,
        {
            "count": lambda c: F.count(number(c)),
            "mean": lambda c: F.avg(number(c)),
            "std": lambda c: F.stddev_samp(number(c)),
            "min": lambda c: F.min(number(c)),
            "max": lambda c: F.max(number(c)),
        },
    ).collect()  # one row per column
    extent = {r["column"]: (r["count"], r["min"], r["max"]) for r in moments}
    quartiles = exact_quantiles(df, columns, QUARTILES, extent)
    return spark.createDataFrame(
        [
            (r["column"], r["column_pos"], r["count"], r["mean"], r["std"], r["min"],
             *quartiles[r["column"]], r["max"])
            for r in moments
        ],
        SUMMARY_SCHEMA,
    )


def quartile_bounds(summary: DataFrame, fence: float = FENCE) -> dict[str, dict[str, float]]:
    """Outlier bounds per column from a numeric summary; columns without values are left out."""
    bounds = {}
    for r in summary.select("column", "q25", "q75").collect():  # one row per column
        if r["q25"] is not None:
            spread = r["q75"] - r["q25"]
            bounds[r["column"]] = {
                "q1": r["q25"],
                "q3": r["q75"],
                "lower": r["q25"] - fence * spread,
                "upper": r["q75"] + fence * spread,
            }
    return bounds


def _outside(c: str, b: dict[str, float]) -> Column:
    return (number(c) < b["lower"]) | (number(c) > b["upper"])


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, summary: DataFrame | None = None
) -> DataFrame:
    """(column, column_pos, q1, q3, lower, upper, n_outliers, pct, n_rows).

    ``pct`` is the share of all rows, nulls included. ``summary`` may pass a
    numeric summary that was computed before.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    bounds = quartile_bounds(numeric_summary(df, columns) if summary is None else summary)

    def bound(name: str):
        return lambda c: F.first(F.lit(bounds.get(c, {}).get(name)).cast("double"))

    counted = per_column(
        df,
        columns,
        {
            **{name: bound(name) for name in ("q1", "q3", "lower", "upper")},
            "n_outliers": lambda c: (
                F.count(F.when(_outside(c, bounds[c]), 1)) if c in bounds else F.count(F.lit(None))
            ),
        },
        {"n_rows": F.count(F.lit(1))},
    )
    return counted.withColumn("pct", ratio(F.col("n_outliers") * 100, F.col("n_rows")))


def outlier_rows(df: DataFrame, column: str, summary: DataFrame | None = None) -> DataFrame:
    """The rows whose value lies outside the quartile bounds; null never does."""
    bounds = quartile_bounds(numeric_summary(df, [column]) if summary is None else summary)
    if column not in bounds:
        return df.limit(0)
    return df.where(_outside(column, bounds[column]))


def boxplot_stats(
    df: DataFrame, columns: Sequence[str] | None = None, summary: DataFrame | None = None
) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the bounds) and number of fliers."""
    columns = numeric_columns(df) if columns is None else list(columns)
    summary = numeric_summary(df, columns) if summary is None else summary
    bounds = quartile_bounds(summary)
    columns = [c for c in columns if c in bounds]

    def inside(c: str) -> Column:
        return F.when(~_outside(c, bounds[c]), number(c))

    whiskers = per_column(
        df,
        columns,
        {
            "whisker_low": lambda c: F.min(inside(c)),
            "whisker_high": lambda c: F.max(inside(c)),
            "n_fliers": lambda c: F.count(F.when(_outside(c, bounds[c]), 1)),
        },
    )
    quartiles = summary.select(
        "column", F.col("q25").alias("q1"), F.col("q50").alias("median"), F.col("q75").alias("q3")
    )
    return whiskers.join(quartiles, "column")


def top_outlier_columns(outliers: DataFrame, k: int = 5) -> DataFrame:
    """The k columns with most outliers; ties keep the column order."""
    return outliers.orderBy(F.desc("n_outliers"), "column_pos").limit(k)


def variances(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, column_pos, variance): sample variance of the non-null values."""
    columns = numeric_columns(df) if columns is None else list(columns)
    return per_column(df, columns, {"variance": lambda c: F.var_samp(number(c))})


def max_variance_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (
        variances(df, columns)
        .where("variance is not null")
        .orderBy(F.desc("variance"), "column_pos")
        .limit(1)
    )


def distinct_counts(
    df: DataFrame, columns: Sequence[str] | None = None, rsd: float | None = None
) -> DataFrame:
    """(column, column_pos, n_distinct, n_rows), nulls not counted.

    Exact by default; ``rsd`` asks for a sketch with that relative error.
    """
    columns = list(columns or df.columns)

    def count(c: str) -> Column:
        if rsd is not None:
            return F.approx_count_distinct(col(c), rsd)
        return F.count_distinct(group_key(df, c))

    return per_column(df, columns, {"n_distinct": count}, {"n_rows": F.count(F.lit(1))})


def zscore_outlier_ratio(df: DataFrame, column: str, limit: float = Z_LIMIT) -> DataFrame:
    """Share of the non-null values further than ``limit`` population deviations
    from the mean; null where the deviation is zero."""
    x = number(column)
    mean, sd = df.agg(F.avg(x), F.stddev_pop(x)).first()
    if not sd:
        return df.agg(F.lit(None).cast("double").alias("outlier_ratio"))
    far = F.abs(x - mean) / sd > limit
    return df.agg(ratio(F.count(F.when(far, 1)), F.count(x)).alias("outlier_ratio"))


def histogram(df: DataFrame, column: str | Column, bins: int = 50) -> DataFrame:
    """Equal-width histogram (bin, left, right, n); empty bins are present."""
    value = number(column) if isinstance(column, str) else column.cast("double")
    x = df.select(value.alias("x")).where("x is not null")
    lo, hi = x.agg(F.min("x"), F.max("x")).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, left double, right double, n bigint")
    if lo == hi:  # one value: a unit-wide range around it
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    counts = x.groupBy(
        F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("left"),
        (lo + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def normal_fit(df: DataFrame, column: str, points: int = 100, bins: int = 50) -> DataFrame:
    """Normal density over the range of a column, scaled to a ``bins``-bin histogram."""
    x = number(column)
    n_rows, lo, hi, mean, sd = df.agg(
        F.count(F.lit(1)), F.min(x), F.max(x), F.avg(x), F.stddev_pop(x)
    ).first()
    spark = df.sparkSession
    if not sd:
        return spark.createDataFrame([], "point int, x double, density double")
    at = lo + F.col("id") * ((hi - lo) / (points - 1))
    z = (F.col("x") - mean) / sd
    scale = n_rows * (hi - lo) / bins / sd
    return spark.range(points).select(F.col("id").cast("int").alias("point"), at.alias("x")).select(
        "point", "x", (F.exp(-z * z / 2) / F.sqrt(2 * F.pi()) * scale).alias("density")
    )


