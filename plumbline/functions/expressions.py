"""Column expressions and small plan shapes shared by every operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)
FLOATING_TYPES = (T.FloatType, T.DoubleType)
CATEGORICAL_TYPES = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)

# Strings of this length or more are grouped by their 64-character SHA-256
# digest. Shorter strings are their own key, so the two can never be confused.
DIGEST_LENGTH = 64

# Fixed value: every character that str.split() and str.strip() treat as white space.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def col(name: str) -> Column:
    """Reference a column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """A numeric column as double, so that decimals and integers behave alike;
    NaN and infinities are missing values."""
    x = col(name).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of an ANSI error on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC_TYPES)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, CATEGORICAL_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, FLOATING_TYPES)]


def group_key(df: DataFrame, name: str) -> Column:
    """Equality-preserving key for grouping: long strings shrink to a digest."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.length(col(name)) < DIGEST_LENGTH, col(name)).otherwise(
            F.sha2(col(name), 256)
        )
    return col(name)


def words(text: Column) -> Column:
    """White-space separated tokens; an empty text has none.

    All white space is mapped to the plain space first: splitting at one
    character is several times faster than at a regular expression.
    """
    spaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.filter(F.split(spaced, " "), lambda token: token != "")


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: dict[str, Callable[[str], Column]],
    table_measures: dict[str, Column] | None = None,
) -> DataFrame:
    """One aggregate over the table, turned into one row per column.

    All measures of all columns share a single scan; only the one-row result
    is unfolded. ``table_measures`` are repeated on every output row.
    """
    table_measures = table_measures or ({} if columns else {"none": F.count(F.lit(1))})
    wide = df.agg(
        *[e.alias(name) for name, e in table_measures.items()],
        *[
            make(c).alias(f"{name}_{i}")
            for i, c in enumerate(columns)
            for name, make in measures.items()
        ],
    )
    return unfold(wide, columns, list(measures), list(table_measures))


def unfold(
    wide: DataFrame,
    columns: Sequence[str],
    measures: Sequence[str],
    shared: Sequence[str] = (),
    label: str = "column",
) -> DataFrame:
    """Turn measure_0, measure_1, ... into rows (label, label_pos, measure...)."""
    rows = [
        F.struct(
            F.lit(c).alias(label),
            F.lit(i).alias(f"{label}_pos"),
            *[F.col(f"{name}_{i}").alias(name) for name in measures],
        )
        for i, c in enumerate(columns)
    ]
    kept = list(shared)
    if not rows:
        fields = ", ".join([f"{label} string", f"{label}_pos int"] + [f"{m} double" for m in measures])
        none = F.lit(None).cast(f"array<struct<{fields}>>")
        return wide.select(F.inline(none), *kept)
    return wide.select(F.inline(F.array(*rows)), *kept)
