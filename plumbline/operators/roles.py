"""What each column is for: numeric, categorical, date, place, text, target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.dates import is_temporal, looks_dated, parsed_as
from plumbline.functions.expressions import (
    categorical_columns,
    col,
    numeric_columns,
    string_columns,
    unfold,
)
from plumbline.functions.lexicon import (
    DATE_FORMATS,
    GEOGRAPHIC_TERMS,
    LATITUDE_TERMS,
    LOCATION_TERMS,
    LONGITUDE_TERMS,
)

# Fixed values of the role rules.
DATE_SHARE = 0.5
TEXT_LENGTH = 50
FEW_CLASSES = 10
MANY_VALUES = 10
MANY_COLUMNS = 5
# Sketched distinct counts at or above this are certain to exceed both limits;
# below it the few remaining values are counted exactly.
CERTAIN = 100


def column_roles(df: DataFrame) -> DataFrame:
    """(column, column_pos, dtype, role): numeric, categorical or none, from the schema."""
    numeric, categorical = set(numeric_columns(df)), set(categorical_columns(df))
    return df.sparkSession.createDataFrame(
        [
            (f.name, i, f.dataType.simpleString(),
             "numeric" if f.name in numeric else "categorical" if f.name in categorical else "none")
            for i, f in enumerate(df.schema)
        ],
        "column string, column_pos int, dtype string, role string",
    )


def named_like(columns: Sequence[str], terms: Sequence[str]) -> list[str]:
    """Columns whose lower-cased name holds any of the terms as a substring."""
    return [c for c in columns if any(t in c.lower() for t in terms)]


def location_columns(df: DataFrame) -> list[str]:
    return named_like(categorical_columns(df), LOCATION_TERMS)


def geographic_columns(df: DataFrame) -> list[str]:
    return named_like(categorical_columns(df), GEOGRAPHIC_TERMS)


def coordinate_columns(df: DataFrame) -> tuple[str, str] | None:
    """The first latitude and the first longitude column, or None if one is lacking."""
    numeric = numeric_columns(df)
    lat, lon = named_like(numeric, LATITUDE_TERMS), named_like(numeric, LONGITUDE_TERMS)
    return (lat[0], lon[0]) if lat and lon else None


def detect_geo_columns(df: DataFrame) -> DataFrame:
    """(column, is_location, is_geographic) of the categorical columns, by name."""
    location, geographic = location_columns(df), geographic_columns(df)
    return df.sparkSession.createDataFrame(
        [(c, c in location, c in geographic) for c in categorical_columns(df)],
        "column string, is_location boolean, is_geographic boolean",
    )


def detect_coordinates(df: DataFrame) -> DataFrame:
    """One row (latitude, longitude) of column names, or none."""
    found = coordinate_columns(df)
    return df.sparkSession.createDataFrame(
        [found] if found else [], "latitude string, longitude string"
    )


def may_be_target(name: str, numeric: bool) -> bool:
    lowered = name.lower()
    return "id" not in lowered and not (numeric and "index" in lowered)


def role_evidence(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Everything the role rules ask of the data, one row per column.

    (column, column_pos, role, n_rows, date_format, date_share, any_date,
    mean_length, is_date, is_text, is_class_target, is_regression_target).
    One scan collects date-like cells, lengths and sketched distinct counts;
    only columns near a limit are counted exactly, only date-like ones parsed.
    ``exclude`` names columns that may not become targets.
    """
    columns = df.columns
    strings, numeric = set(string_columns(df)), set(numeric_columns(df))
    categorical = set(categorical_columns(df))
    candidates = [
        c for c in columns
        if c not in exclude and (c in categorical or c in numeric) and may_be_target(c, c in numeric)
    ]

    aggregates: list[Column] = [F.count(F.lit(1)).alias("n_rows"), *_dated_cells(df)]
    for i, c in enumerate(columns):
        if c in strings:
            aggregates.append(F.avg(F.length(col(c))).alias(f"length{i}"))
        if c in candidates:
            aggregates.append(F.approx_count_distinct(col(c)).alias(f"distinct{i}"))
    row = df.agg(*aggregates).first().asDict()

    distinct = {c: row[f"distinct{i}"] for i, c in enumerate(columns) if c in candidates}
    unsure = [c for c, n in distinct.items() if n < CERTAIN]
    if unsure:
        exact = df.agg(
            *[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(unsure)]
        ).first()
        distinct.update({c: exact[f"d{i}"] for i, c in enumerate(unsure)})
    dates = _date_formats(df, row)

    n_rows = row["n_rows"]
    evidence = []
    for i, c in enumerate(columns):
        hits, fmt = dates.get(c, (0, None))
        length = row.get(f"length{i}")
        share = hits / n_rows if n_rows else None
        values = distinct.get(c)
        evidence.append(
            (
                c, i,
                "numeric" if c in numeric else "categorical" if c in categorical else "none",
                n_rows, fmt, share, hits > 0, length,
                share is not None and share > DATE_SHARE,
                c in strings and length is not None and length > TEXT_LENGTH,
                c in categorical and values is not None and values < FEW_CLASSES,
                c in numeric and values is not None and values > MANY_VALUES,
            )
        )
    return df.sparkSession.createDataFrame(
        evidence,
        "column string, column_pos int, role string, n_rows bigint, date_format string, "
        "date_share double, any_date boolean, mean_length double, is_date boolean, "
        "is_text boolean, is_class_target boolean, is_regression_target boolean",
    )


def _dated_cells(df: DataFrame) -> list[Column]:
    """Per column that may hold dates, the number of cells that look like one."""
    strings = set(string_columns(df))
    cells = []
    for i, c in enumerate(df.columns):
        if c in strings:
            cells.append(F.count_if(looks_dated(col(c))).alias(f"dated{i}"))
        elif is_temporal(df, c):
            cells.append(F.count(col(c)).alias(f"dated{i}"))
    return cells


def _date_formats(df: DataFrame, dated: dict) -> dict[str, tuple[int, str]]:
    """(parsed cells, format) per column, from the counts of date-like cells.

    Only text columns with a date-like cell are parsed at all, in one scan for
    all columns and formats; the first of equally good formats wins.
    """
    found = {c: (dated[f"dated{i}"], "native") for i, c in enumerate(df.columns) if is_temporal(df, c)}
    texts = [c for i, c in enumerate(df.columns) if c not in found and dated.get(f"dated{i}")]
    if texts:
        hits = df.agg(
            *[
                F.count(parsed_as(col(c), fmt)).alias(f"h{i}_{j}")
                for i, c in enumerate(texts)
                for j, fmt in enumerate(DATE_FORMATS)
            ]
        ).first()
        for i, c in enumerate(texts):
            per_format = [hits[f"h{i}_{j}"] for j in range(len(DATE_FORMATS))]
            best = max(per_format)
            found[c] = (best, DATE_FORMATS[per_format.index(best)])
    return {c: (n, fmt) for c, (n, fmt) in found.items() if n}


def detect_date_columns(df: DataFrame, mode: str = "majority") -> DataFrame:
    """(column, column_pos, date_format, date_share).

    ``majority`` asks that more than half of all rows parse in the column's
    best format, ``any`` that at least one does.
    """
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *_dated_cells(df)).first().asDict()
    least = DATE_SHARE if mode == "majority" else 0
    rows = [
        (c, df.columns.index(c), fmt, hits / row["n_rows"])
        for c, (hits, fmt) in _date_formats(df, row).items()
        if hits / row["n_rows"] > least
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, column_pos int, date_format string, date_share double"
    )


def detect_text_columns(df: DataFrame) -> DataFrame:
    """(column, column_pos, mean_length): strings of more than 50 characters on average."""
    strings = string_columns(df)
    wide = df.agg(*[F.avg(F.length(col(c))).alias(f"mean_length_{i}") for i, c in enumerate(strings)] or [F.lit(1)])
    return unfold(wide, strings, ["mean_length"]).where(F.col("mean_length") > TEXT_LENGTH)


def detect_class_targets(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, column_pos): categorical, fewer than 10 values, no "id" in the name."""
    return role_evidence(df, exclude).where("is_class_target").select("column", "column_pos")


def detect_regression_targets(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, column_pos): numeric, more than 10 values, neither "id" nor "index" in the name."""
    return role_evidence(df, exclude).where("is_regression_target").select("column", "column_pos")


# Fixed value: the labels in their order.
DATASET_TYPES = [
    "time_series", "geographic", "text_heavy", "classification", "regression", "high_dimensional",
]


def dataset_type_names(df: DataFrame, evidence: DataFrame | None = None) -> list[str]:
    rows = (role_evidence(df) if evidence is None else evidence).collect()  # one row per column
    holds = {
        "time_series": any(r["is_date"] for r in rows),
        "geographic": bool(geographic_columns(df)),
        "text_heavy": any(r["is_text"] for r in rows),
        "classification": any(r["is_class_target"] for r in rows),
        "regression": any(r["is_regression_target"] for r in rows),
        "high_dimensional": len(numeric_columns(df)) > MANY_COLUMNS,
    }
    return [name for name in DATASET_TYPES if holds[name]]


def dataset_types(df: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(position, dataset_type), the labels that hold in their fixed order."""
    names = dataset_type_names(df, evidence)
    return df.sparkSession.createDataFrame(
        list(enumerate(names)), "position int, dataset_type string"
    )
