"""Catalogue: what columns and tables are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.catalog.base import PLACES, Query, places, r, rounded, union
from plumbline.functions.dates import parse_date
from plumbline.operators import roles, stats
from plumbline.plans import profile

# Name, numeric columns, categorical columns, text columns, date columns of sample tables.
TABLES = {
    "lineitem": (
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        ["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linestatus"], ["l_shipdate"]),
    "orders": (
        ["o_orderkey", "o_custkey", "o_totalprice"],
        ["o_orderstatus", "o_orderpriority"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]),
    "documents": (["doc_id", "n_chars"], ["text", "lang", "source"], ["text", "lang", "source"], []),
    "places": (
        ["c_acctbal", "c_custkey", "latitude", "longitude"],
        ["region", "country", "c_mktsegment"], ["region", "country", "c_mktsegment"], []),
    "part": (
        ["p_partkey", "p_size", "p_retailprice"],
        ["p_name", "p_brand", "p_type"], ["p_name", "p_brand", "p_type"], []),
}


def _any(conditions: list[str]) -> str:
    return "(" + (" OR ".join(conditions) or "false") + ")"


def types_sql() -> str:
    """CTE text: (tbl, position, dataset_type), the rules written out per table."""
    parts = []
    for name, (numeric, categorical, texts, dates) in TABLES.items():
        geographic = any(t in c for c in [*categorical, *dates] for t in ("country", "city", "state", "region", "location", "lat", "long"))
        classes = [c for c in [*categorical, *dates] if "id" not in c]
        numbers = [c for c in numeric if "id" not in c and "index" not in c]
        iso = [f"avg(CASE WHEN TRY_CAST({c} AS DATE) IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.5" for c in texts]
        rules = [
            ("time_series", _any([f"count({c}) / count(*) > 0.5" for c in dates] + iso)),
            ("geographic", str(geographic).lower()),
            ("text_heavy", _any([f"avg(length({c})) > 50" for c in texts])),
            ("classification", _any([f"count(DISTINCT {c}) < 10" for c in classes])),
            ("regression", _any([f"count(DISTINCT {c}) > 10" for c in numbers])),
            ("high_dimensional", str(len(numeric) > 5).lower()),
        ]
        for i, (label, rule) in enumerate(rules):
            parts.append(f"SELECT '{name}' AS tbl, {i} AS pos, '{label}' AS dataset_type, count(*) > 0 AND {rule} AS holds FROM {name}")
    rows = "\nUNION ALL\n".join(parts)
    return (
        f"{PLACES},\ntypes AS (SELECT tbl, row_number() OVER (PARTITION BY tbl ORDER BY pos) - 1 AS position, dataset_type "
        f"FROM ({rows}) WHERE holds)"
    )


def _tables(load) -> dict[str, DataFrame]:
    return {name: places(load) if name == "places" else load(name) for name in TABLES}


def _labelled(load, make) -> DataFrame:
    parts = [make(df).select(F.lit(name).alias("tbl"), "*") for name, df in _tables(load).items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return rounded(result)


PLAN = """
, chosen AS (
  SELECT DISTINCT tbl, 0 AS ord, 'basic_stats' AS analysis FROM types
  UNION ALL SELECT DISTINCT tbl, 1, 'outliers' FROM types
  UNION ALL SELECT DISTINCT tbl, 2, 'correlations' FROM types
  UNION ALL SELECT tbl, 3, unnest(['clustering', 'dimensionality']) FROM types WHERE dataset_type = 'high_dimensional'
  UNION ALL SELECT tbl, 5, unnest(['seasonality', 'trend', 'forecasting']) FROM types WHERE dataset_type = 'time_series'
  UNION ALL SELECT tbl, 8, unnest(['spatial', 'regional']) FROM types WHERE dataset_type = 'geographic'
  UNION ALL SELECT tbl, 10, unnest(['text', 'sentiment']) FROM types WHERE dataset_type = 'text_heavy'
  UNION ALL SELECT DISTINCT tbl, 12, 'feature_importance' FROM types WHERE dataset_type IN ('classification', 'regression')
  UNION ALL SELECT DISTINCT tbl, 13, 'predictive_power' FROM types WHERE dataset_type IN ('classification', 'regression')),
named AS (SELECT tbl, analysis, list_position(['basic_stats', 'outliers', 'correlations', 'clustering', 'dimensionality',
  'seasonality', 'trend', 'forecasting', 'spatial', 'regional', 'text', 'sentiment', 'feature_importance', 'predictive_power'], analysis) AS ord
  FROM chosen)
SELECT tbl, row_number() OVER (PARTITION BY tbl ORDER BY ord) - 1 AS position, analysis FROM named"""

# Orders dates as text in several formats, with values that are no dates.
DATES_SQL = """dated AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d-%b-%y') ELSE 'pending' END AS short_name,
    CASE WHEN o_orderkey % 9 = 0 THEN '?' ELSE strftime(o_orderdate, '%d-%b-%y') END AS name_year,
    CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS us,
    o_orderpriority, o_orderdate
  FROM orders)"""


def _dated(load):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    return load("orders").select(
        key,
        F.when(key % 10 == 0, "unknown").when(key % 7 == 0, None).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("iso"),
        F.when(key % 3 == 0, F.date_format(day, "dd-MMM-yy")).otherwise("pending").alias("short_name"),
        F.when(key % 9 == 0, "?").otherwise(F.date_format(day, "dd-MMM-yy")).alias("name_year"),
        F.when(key % 4 == 0, "none").otherwise(F.date_format(day, "MM/dd/yyyy")).alias("us"),
        "o_orderpriority",
        day,
    )


PARSED = {
    "iso": "TRY_CAST(iso AS DATE)",
    "short_name": "try_strptime(short_name, '%d-%b-%y')",
    "name_year": "try_strptime(name_year, '%d-%b-%y')",
    "us": "try_strptime(us, '%m/%d/%Y')",
    "o_orderpriority": "TRY_CAST(o_orderpriority AS DATE)",
    "o_orderdate": "o_orderdate",
}
FORMATS = {"iso": "iso", "short_name": "d-MMM-yy", "name_year": "d-MMM-yy", "us": "M/d/yyyy",
           "o_orderpriority": "iso", "o_orderdate": "native"}


def date_columns_sql(limit: str) -> str:
    return f"WITH {DATES_SQL}\nSELECT * FROM (" + union(list(PARSED), lambda i, c: (
        f"SELECT '{c}' AS \"column\", CAST({i + 1} AS BIGINT) AS column_pos, '{FORMATS[c]}' AS date_format, "
        f"{r(f'count({PARSED[c]}) / count(*)')} AS date_share FROM dated"
    )) + f") WHERE date_share > {limit}"


def _parsed(load):
    df = _dated(load)
    for name in ("iso", "short_name", "name_year", "us"):
        df = parse_date(df, name, FORMATS[name])
    return rounded(df.select("o_orderkey", "iso", "short_name", "name_year", "us"))


def _targets(kind: str) -> str:
    parts = []
    for name, (numeric, categorical, _, dates) in TABLES.items():
        names = numeric if kind == "regression" else [*categorical, *dates]
        compare = "> 10" if kind == "regression" else "< 10"
        for c in names:
            if "id" not in c and not (kind == "regression" and "index" in c):
                parts.append(f"SELECT '{name}' AS tbl, '{c}' AS \"column\" FROM {name} HAVING count(DISTINCT {c}) {compare}")
    return f"WITH {PLACES}\n" + "\nUNION ALL\n".join(parts)


def _geo(load):
    df = places(load)
    return roles.detect_geo_columns(df).join(
        stats.distinct_counts(df, ["region", "country", "c_mktsegment"]).select("column", "n_distinct"), "column")


GEO = f"WITH {PLACES}\n" + union(["region", "country", "c_mktsegment"], lambda i, c: (
    f"SELECT '{c}' AS \"column\", {str(i < 2).lower()} AS is_location, {str(i < 2).lower()} AS is_geographic, "
    f"count(DISTINCT {c}) AS n_distinct FROM places"))

def _coordinates(load):
    df = places(load)
    return rounded(stats.null_counts(df, list(roles.detect_coordinates(df).first())))


COORDINATES = f"WITH {PLACES}\n" + union(["latitude", "longitude"], lambda i, c: (
    f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS column_pos, count(*) - count({c}) AS n_null, count(*) AS n_rows FROM places"))

QUERIES = [
    Query("dataset_types", lambda load: _labelled(load, roles.dataset_types), f"WITH {types_sql()}\nSELECT * FROM types"),
    Query("plan_analyses", lambda load: _labelled(load, profile.plan_analyses), f"WITH {types_sql()}" + PLAN),
    Query(
        "detect_text_columns",
        lambda load: rounded(roles.detect_text_columns(load("documents")).select("column", "mean_length"), 4),
        "SELECT * FROM (" + union(["text", "lang", "source"], lambda i, c: (
            f"SELECT '{c}' AS \"column\", {r(f'avg(length({c}))', 4)} AS mean_length FROM documents"))
        + ") WHERE mean_length > 50",
    ),
    Query(
        "detect_class_targets",
        lambda load: _labelled(load, lambda df: roles.detect_class_targets(df).select("column")),
        _targets("class"),
    ),
    Query(
        "detect_regression_targets",
        lambda load: _labelled(load, lambda df: roles.detect_regression_targets(df).select("column")),
        _targets("regression"),
    ),
    Query("detect_geo_columns", _geo, GEO),
    Query("detect_coordinates", _coordinates, COORDINATES),
    Query(
        "detect_date_columns",
        lambda load: rounded(roles.detect_date_columns(_dated(load))),
        date_columns_sql("0.5"),
    ),
    Query(
        "detect_date_columns_any",
        lambda load: rounded(roles.detect_date_columns(_dated(load), "any")),
        date_columns_sql("0"),
    ),
    Query(
        "parse_date",
        _parsed,
        f"WITH {DATES_SQL}\nSELECT o_orderkey, " + ", ".join(
            f"CAST(CAST({PARSED[c]} AS DATE) AS VARCHAR) AS {c}" for c in ("iso", "short_name", "name_year", "us"))
        + " FROM dated",
    ),
]
