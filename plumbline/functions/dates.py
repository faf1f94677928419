"""Dates held as text: parsing with one format per column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.expressions import col
from plumbline.functions.lexicon import DATE_FORMATS


def _shape(fmt: str) -> str:
    """The characters that a text in the format consists of, as a regular expression."""
    if fmt == "iso":
        return r"\d{4}(-\d{1,2}(-\d{1,2}([T ].*)?)?)?"
    parts = re.findall(r"y+|M+|d+|[^yMd]+", fmt)
    shapes = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": "[A-Za-z]{3,9}", "MMM": "[A-Za-z]{3}", "M": r"\d{1,2}", "d": r"\d{1,2}"}
    return "".join(shapes.get(part, re.escape(part)) for part in parts)


def looks_dated(text: Column) -> Column:
    """Whether the text has the shape of any supported format."""
    shapes = "|".join(_shape(fmt) for fmt in DATE_FORMATS)
    return F.coalesce(F.trim(text).rlike(f"^({shapes})$"), F.lit(False))


def parsed_as(text: Column, fmt: str) -> Column:
    """The text as a timestamp in one format, null where it does not fit.

    Texts are matched against the shape of the format first: a failing date
    parser costs an exception per cell, a failing match next to nothing.
    """
    trimmed = F.trim(text)
    shaped = F.when(trimmed.rlike(f"^{_shape(fmt)}$"), trimmed)
    if fmt == "iso":
        return shaped.try_cast("timestamp")
    moment = F.try_to_timestamp(shaped, F.lit(fmt))
    if "yyyy" in fmt:
        return moment
    # Two-digit years: 69 to 99 belong to the last century.
    return F.when(F.year(moment) >= 2069, moment - F.expr("interval 100 years")).otherwise(moment)


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(
        df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def parse_date(df: DataFrame, column: str, fmt: str = "iso", alias: str | None = None) -> DataFrame:
    """Add (or replace) a timestamp column parsed with ``fmt``; bad values become null."""
    alias = alias or column
    if is_temporal(df, column):
        return df.withColumn(alias, col(column).cast("timestamp"))
    return df.withColumn(alias, parsed_as(col(column), fmt))
