"""Places: statistics by region, location tables, coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.expressions import col, number, numeric_columns, per_column, ratio, unfold
from plumbline.operators.frequency import value_counts
from plumbline.operators.roles import coordinate_columns, location_columns

REGIONAL_SCHEMA = (
    "metric string, location string, mean double, std double, min double, max double, n bigint, rank int"
)


def regional_stats(
    df: DataFrame,
    location: str | None = None,
    metrics: Sequence[str] | None = None,
    k: int = 10,
    first: int | None = None,
) -> DataFrame:
    """(metric, location, mean, std, min, max, n): per metric the k largest regions.

    All numeric columns unless ``metrics`` names some or ``first`` limits them;
    without a location column or a metric there are no rows.

    All metrics are aggregated in one group-by; the pre-aggregated groups, not
    the rows, are unfolded and ranked, ties by location name.
    """
    location = location or next(iter(location_columns(df)), None)
    metrics = numeric_columns(df)[:first] if metrics is None else list(metrics)
    if location is None or not metrics:
        return df.sparkSession.createDataFrame([], REGIONAL_SCHEMA)
    wide = (
        df.where(col(location).isNotNull())
        .groupBy(col(location).alias("location"))
        .agg(
            *[
                e
                for i, m in enumerate(metrics)
                for e in (
                    F.avg(number(m)).alias(f"mean_{i}"),
                    F.stddev_samp(number(m)).alias(f"std_{i}"),
                    F.min(number(m)).alias(f"min_{i}"),
                    F.max(number(m)).alias(f"max_{i}"),
                    F.count(number(m)).alias(f"n_{i}"),
                )
            ]
        )
    )
    rows = unfold(wide, metrics, ["mean", "std", "min", "max", "n"], ["location"], label="metric")
    best = W.partitionBy("metric_pos").orderBy(F.desc("n"), "location")
    return (
        rows.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("metric", "location", "mean", "std", "min", "max", "n", "rank")
    )


def location_stats(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10, top: int = 5) -> DataFrame:
    """(column, value, n, rank, n_locations, concentration) of the location columns.

    ``concentration`` is the share of all rows that the ``top`` largest hold.
    """
    columns = location_columns(df) if columns is None else list(columns)
    largest = value_counts(df, columns, max(k, top))
    overall = per_column(
        df,
        columns,
        {"n_locations": lambda c: F.count_distinct(col(c))},
        {"n_rows": F.count(F.lit(1))},
    ).select("column", "n_locations", "n_rows")
    held = W.partitionBy("column")
    return (
        largest.join(F.broadcast(overall), "column")  # one row per location column
        .withColumn(
            "concentration",
            ratio(F.sum(F.when(F.col("rank") <= top, F.col("n"))).over(held), F.col("n_rows")),
        )
        .where(F.col("rank") <= k)
        .select("column", "value", "n", "rank", "n_locations", "concentration")
    )


def _placed(df: DataFrame, latitude: str | None, longitude: str | None) -> DataFrame:
    """Rows with both coordinates, as (lat, lon)."""
    if latitude is None or longitude is None:
        found = coordinate_columns(df)
        if found is None:
            raise ValueError("the table has no latitude and longitude columns")
        latitude, longitude = found
    return df.select(number(latitude).alias("lat"), number(longitude).alias("lon")).dropna()


def coordinate_stats(df: DataFrame, latitude: str | None = None, longitude: str | None = None) -> DataFrame:
    """One row: centre, spread (sample std) and bounds of the located rows."""
    return _placed(df, latitude, longitude).agg(
        F.avg("lat").alias("center_latitude"),
        F.avg("lon").alias("center_longitude"),
        F.stddev_samp("lat").alias("latitude_std"),
        F.stddev_samp("lon").alias("longitude_std"),
        F.max("lat").alias("north"),
        F.min("lat").alias("south"),
        F.max("lon").alias("east"),
        F.min("lon").alias("west"),
    )


def spatial_points(df: DataFrame, latitude: str | None = None, longitude: str | None = None) -> DataFrame:
    return _placed(df, latitude, longitude)


def density_grid(
    df: DataFrame, latitude: str | None = None, longitude: str | None = None, cells: int = 20
) -> DataFrame:
    """(row, col, south, west, n): located rows per cell of a cells x cells grid."""
    points = _placed(df, latitude, longitude)
    south, north, west, east = points.agg(
        F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")
    ).first()
    if south is None:
        return df.sparkSession.createDataFrame(
            [], "row int, col int, south double, west double, n bigint"
        )
    height, width = (north - south) / cells or 1.0, (east - west) / cells or 1.0

    def cell(name: str, low: float, size: float):
        return F.least(F.floor((F.col(name) - low) / size), F.lit(cells - 1)).cast("int")

    counts = points.groupBy(
        cell("lat", south, height).alias("row"), cell("lon", west, width).alias("col")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "row", "col",
        (south + F.col("row") * height).alias("south"),
        (west + F.col("col") * width).alias("west"),
        "n",
    )


# Rows from which contours are drawn, their number, the share of rows outside the outermost one, and how many
# bandwidths the grid reaches beyond the rows.
ENOUGH_FOR_CONTOURS, CONTOURS, OUTSIDE, BEYOND = 100, 5, 0.05, 3


def density_contours(
    df: DataFrame, latitude: str | None = None, longitude: str | None = None, cells: int = 50, levels: int = CONTOURS
) -> DataFrame:
    """(row, col, lat, lon, density, level): a Gaussian kernel density at the centres of a cells x cells grid.

    Rows are counted by cell, so the density costs the same whatever their number; the kernel is spread along the columns and
    then along the rows. The bandwidth of a side is its deviation times n to the power -1/6. ``level`` counts the contours that a
    cell lies on or inside; contour i leaves a share of the mass outside that rises evenly from 5 % to all of it. Fewer
    than two rows, or rows on a line, give nothing.
    """
    points = _placed(df, latitude, longitude)
    n, sd_lat, sd_lon, south, north, west, east = points.agg(
        F.count(F.lit(1)), F.stddev_samp("lat"), F.stddev_samp("lon"), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")
    ).first()
    if not sd_lat or not sd_lon:
        return df.sparkSession.createDataFrame([], "row int, col int, lat double, lon double, density double, level int")
    wide_lat, wide_lon = sd_lat * n ** (-1 / 6), sd_lon * n ** (-1 / 6)
    low, left = south - BEYOND * wide_lat, west - BEYOND * wide_lon
    height, width = (north - south + 2 * BEYOND * wide_lat) / cells, (east - west + 2 * BEYOND * wide_lon) / cells
    counts = points.groupBy(
        F.floor((F.col("lat") - low) / height).cast("int").alias("from_row"), F.floor((F.col("lon") - left) / width).cast("int").alias("from_col")
    ).agg(F.count(F.lit(1)).cast("double").alias("mass"))

    def spread(table: DataFrame, side: str, other: str, step: float, wide: float) -> DataFrame:
        """Every cell's mass goes to all cells of its row or column."""
        away = (F.col(side) - F.col(f"from_{side}")) * step / wide
        return table.select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias(side)).groupBy(other, side).agg(
            F.sum(F.col("mass") * F.exp(-away * away / 2) / (math.sqrt(2 * math.pi) * wide)).alias("mass")
        )

    smooth = spread(spread(counts, "col", "from_row", width, wide_lon), "row", "col", height, wide_lat)
    # One row per cell of the grid.
    falling = W.orderBy(F.desc("mass"), "row", "col")
    ranked = smooth.select(
        "row", "col", (F.col("mass") / n).alias("density"),
        (F.sum("mass").over(falling.rowsBetween(W.unboundedPreceding, W.currentRow)) / F.sum("mass").over(W.partitionBy())).alias("inside"),
    )
    shares = [OUTSIDE + (1 - OUTSIDE) * i / (levels - 1) for i in range(levels)] if levels > 1 else [OUTSIDE]
    heights = [F.max(F.when(F.col("inside") >= 1 - share, F.col("density"))).over(W.partitionBy()) for share in shares]
    level = sum(((F.col("density") >= h).cast("int") for h in heights), F.lit(0))
    return ranked.select(
        "row", "col", (low + (F.col("row") + 0.5) * height).alias("lat"), (left + (F.col("col") + 0.5) * width).alias("lon"),
        "density", level.alias("level"),
    )
