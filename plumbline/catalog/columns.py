"""Catalogue: statistics of columns, frequencies, cleaning, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import (
    LINEITEM_NUMBERS,
    LINEITEM_WITH_NULLS,
    NULLED_NUMBERS,

    Query,
    lineitem_non_finite,
    lineitem_with_nulls,
    r,
    rounded,
    union,
)
from plumbline.operators import clean, frequency, readiness, roles, stats

NULLED = [*NULLED_NUMBERS, "l_returnflag"]
LINEITEM = [*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


def _column_roles(load):
    df = load("lineitem")
    return rounded(
        roles.column_roles(df).select("column", "column_pos", "role").join(
            stats.null_counts(df).select("column", "n_null", "n_rows"), "column"
        )
    )


COLUMN_ROLES = union(LINEITEM, lambda i, c: (
    f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS column_pos, "
    f"'{'numeric' if c in LINEITEM_NUMBERS else 'categorical'}' AS role, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(*) AS n_rows FROM lineitem"
))

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
TABLE_SHAPE = union(ORDERS, lambda i, c: (
    f"SELECT (SELECT count(*) FROM orders) AS n_rows, CAST({len(ORDERS)} AS BIGINT) AS n_columns, "
    f"'{c}' AS \"column\", CAST({i} AS BIGINT) AS column_pos"
))

NULL_COUNTS = f"WITH {LINEITEM_WITH_NULLS}\n" + union(NULLED, lambda i, c: (
    f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS column_pos, "
    f"count(*) - count({c}) AS n_null, count(*) AS n_rows FROM lineitem_with_nulls"
))

COMPLETENESS = (
    f"WITH {LINEITEM_WITH_NULLS} SELECT "
    + r("1 - (" + " + ".join(f"(count(*) - count({c}))" for c in NULLED) + f") / (count(*) * {len(NULLED)}.0)")
    + " AS completeness FROM lineitem_with_nulls"
)


def summary_sql(table: str, columns: list[str]) -> str:
    return union(columns, lambda i, c: (
        f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS column_pos, count({c}) AS count, "
        f"{r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})')} AS min, "
        f"{r(f'quantile_cont({c}, 0.25)')} AS q25, {r(f'quantile_cont({c}, 0.5)')} AS q50, "
        f"{r(f'quantile_cont({c}, 0.75)')} AS q75, {r(f'max({c})')} AS max FROM {table}"
    ))


def bounds_sql(table: str, columns: list[str]) -> str:
    """CTE text: (column, column_pos, q1, median, q3, lower, upper) per column."""
    return "bounds AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (\n" + union(
        columns, lambda i, c: (
            f"SELECT '{c}' AS \"column\", {i} AS column_pos, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, "
            f"CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median, "
            f"CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3 FROM {table}")
    ) + "))"


def outliers_sql(table: str, columns: list[str], with_clause: str = "") -> str:
    return f"WITH {with_clause}{bounds_sql(table, columns)},\noutliers AS (" + union(columns, lambda i, c: (
        f"SELECT \"column\", CAST(column_pos AS BIGINT) AS column_pos, {r('any_value(q1)')} AS q1, "
        f"{r('any_value(q3)')} AS q3, {r('any_value(lower)')} AS lower, {r('any_value(upper)')} AS upper, "
        f"count(*) FILTER (WHERE t.{c} < lower OR t.{c} > upper) AS n_outliers, count(*) AS n_rows, "
        f"{r(f'100.0 * count(*) FILTER (WHERE t.{c} < lower OR t.{c} > upper) / count(*)')} AS pct "
        f"FROM {table} t, bounds WHERE \"column\" = '{c}' GROUP BY ALL"
    )) + ")\n"


def boxplot_sql(table: str, columns: list[str]) -> str:
    return f"WITH {bounds_sql(table, columns)}\n" + union(columns, lambda i, c: (
        f"SELECT \"column\", CAST(column_pos AS BIGINT) AS column_pos, {r('any_value(q1)')} AS q1, "
        f"{r('any_value(median)')} AS median, {r('any_value(q3)')} AS q3, "
        f"{r(f'min({c}) FILTER (WHERE {c} BETWEEN lower AND upper)')} AS whisker_low, "
        f"{r(f'max({c}) FILTER (WHERE {c} BETWEEN lower AND upper)')} AS whisker_high, "
        f"count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS n_fliers "
        f"FROM {table}, bounds WHERE \"column\" = '{c}' GROUP BY ALL"
    ))


BOXPLOT = boxplot_sql("lineitem", LINEITEM_NUMBERS)

OUTLIER_ROWS = """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, user_id, event_type, value FROM events, b
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"""

VARIANCES = union(LINEITEM_NUMBERS, lambda i, c: (
    f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS column_pos, {r(f'var_samp({c})', 2)} AS variance FROM lineitem"
))

DISTINCT = union(LINEITEM, lambda i, c: (
    f"SELECT '{c}' AS \"column\", CAST({i} AS BIGINT) AS column_pos, count(DISTINCT {c}) AS n_distinct, "
    f"count(*) AS n_rows FROM lineitem"
))


def counts_sql(table: str, columns: list[str], k: int) -> str:
    """Top values, ties by value."""
    cells = union(columns, lambda i, c: (
        f"SELECT '{c}' AS \"column\", {i} AS column_pos, CAST({c} AS VARCHAR) AS value "
        f"FROM {table} WHERE {c} IS NOT NULL"
    ))
    return f"""SELECT "column", CAST(column_pos AS BIGINT) AS column_pos, value, n, rank FROM (
  SELECT "column", column_pos, value, count(*) AS n,
         row_number() OVER (PARTITION BY column_pos ORDER BY count(*) DESC, value) AS rank
  FROM ({cells}) GROUP BY "column", column_pos, value) WHERE rank <= {k}"""


DEDUP_COLUMNS = "text, lang, source, n_chars"


def _sparse(load):
    return load("orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("double")).alias("half"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("third"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("two_thirds"),
    )


SPARSE = """
WITH t AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) END AS half,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS two_thirds FROM orders)
SELECT * FROM t"""


def _infinite(load):
    df = load("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 1, float("inf"))
        .when(F.col("l_linenumber") == 2, float("-inf"))
        .otherwise(F.col("l_extendedprice")).alias("price"),
    )
    return rounded(clean.nullify_infinite(df))


def _cleaned(load):
    df = load("documents").select(
        "text", "lang", "source",
        F.when(F.col("n_chars") % 2 == 0, float("inf")).otherwise(F.col("n_chars").cast("double")).alias("chars"),
        F.when(F.col("n_chars") < 500, F.col("n_chars")).alias("short"),
    )
    return clean.clean(df)


CLEANED = """
WITH t AS (SELECT DISTINCT text, lang, source, CASE WHEN n_chars % 2 <> 0 THEN CAST(n_chars AS DOUBLE) END AS chars,
  CASE WHEN n_chars < 500 THEN n_chars END AS short FROM documents)
SELECT text, lang, source, chars FROM t"""

RECOMMENDATIONS = """
WITH c AS (
  SELECT 0 AS pos, 'c_name' AS name, count(DISTINCT c_name) AS d, count(c_name) AS present, count(*) AS n,
         (SELECT max(k) FROM (SELECT count(*) AS k FROM customer GROUP BY c_name)) AS lead FROM customer
  UNION ALL
  SELECT 1, 'c_mktsegment', count(DISTINCT c_mktsegment), count(c_mktsegment), count(*),
         (SELECT max(k) FROM (SELECT count(*) AS k FROM customer GROUP BY c_mktsegment)) FROM customer),
notes AS (
  SELECT 1 AS part, pos, 'High cardinality in ' || name || ' might need grouping' AS recommendation FROM c WHERE d / n > 0.5
  UNION ALL
  SELECT 2, pos, 'Consider addressing imbalance in ' || name FROM c WHERE lead / present > 0.8)
SELECT row_number() OVER (ORDER BY part, pos) - 1 AS position, recommendation FROM notes"""

WARNINGS = f"""
SELECT 'high_cardinality' AS kind, 'c_name' AS "column", CAST(NULL AS VARCHAR) AS other,
       {r('count(DISTINCT c_name) / count(*)')} AS value FROM customer HAVING count(DISTINCT c_name) / count(*) > 0.5
UNION ALL
SELECT 'high_cardinality', 'c_mktsegment', NULL, {r('count(DISTINCT c_mktsegment) / count(*)')}
FROM customer HAVING count(DISTINCT c_mktsegment) / count(*) > 0.5
UNION ALL
SELECT 'high_correlation', 'c_custkey', 'double_balance', {r('abs(corr(c_custkey, c_acctbal * 2))')}
FROM customer HAVING abs(corr(c_custkey, c_acctbal * 2)) > 0.95
UNION ALL
SELECT 'high_correlation', 'c_acctbal', 'double_balance', {r('abs(corr(c_acctbal, c_acctbal * 2))')}
FROM customer HAVING abs(corr(c_acctbal, c_acctbal * 2)) > 0.95"""

HISTOGRAM = f"""
WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
bins AS (SELECT generate_series AS bin FROM generate_series(0, 49)),
counted AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin, count(*) AS n
  FROM lineitem, e GROUP BY 1)
SELECT CAST(b.bin AS BIGINT) AS bin, {r('lo + b.bin * ((hi - lo) / 50)', 4)} AS "left",
       {r('lo + (b.bin + 1) * ((hi - lo) / 50)', 4)} AS "right", coalesce(n, 0) AS n
FROM bins b CROSS JOIN e LEFT JOIN counted c ON b.bin = c.bin"""

NORMAL_FIT = f"""
WITH e AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
  avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders),
p AS (SELECT generate_series AS point, lo + generate_series * ((hi - lo) / 99) AS x, n, lo, hi, m, sd
  FROM e, generate_series(0, 99))
SELECT CAST(point AS BIGINT) AS point, {r('x', 4)} AS x,
  {r('exp(-((x - m) / sd) * ((x - m) / sd) / 2) / sqrt(2 * pi()) * (n * (hi - lo) / 50 / sd)', 4)} AS density FROM p"""

CATEGORICAL_ORDERS = ["o_orderstatus", "o_orderdate", "o_orderpriority"]

QUERIES = [
    Query("column_roles", _column_roles, COLUMN_ROLES),
    Query("table_shape", lambda load: rounded(stats.table_shape(load("orders")).drop("dtype")), TABLE_SHAPE),
    Query("null_counts", lambda load: rounded(stats.null_counts(lineitem_with_nulls(load))), NULL_COUNTS),
    Query("completeness", lambda load: rounded(stats.completeness(lineitem_with_nulls(load))), COMPLETENESS),
    Query(
        "numeric_summary",
        lambda load: rounded(stats.numeric_summary(load("lineitem")), mean=4, std=4),
        summary_sql("lineitem", LINEITEM_NUMBERS),
    ),
    Query(
        "numeric_summary_with_nulls",
        lambda load: rounded(stats.numeric_summary(lineitem_with_nulls(load)), mean=4, std=4),
        f"WITH {LINEITEM_WITH_NULLS}\n" + summary_sql("lineitem_with_nulls", NULLED_NUMBERS),
    ),
    Query(
        "iqr_outliers",
        lambda load: rounded(stats.iqr_outliers(load("lineitem"))),
        outliers_sql("lineitem", LINEITEM_NUMBERS) + "SELECT * FROM outliers",
    ),
    Query(
        "iqr_outliers_with_nulls",
        lambda load: rounded(stats.iqr_outliers(lineitem_with_nulls(load))),
        outliers_sql("lineitem_with_nulls", NULLED_NUMBERS, LINEITEM_WITH_NULLS + ",\n") + "SELECT * FROM outliers",
    ),
    Query(
        "top_outlier_columns",
        lambda load: rounded(stats.top_outlier_columns(stats.iqr_outliers(load("lineitem")))),
        outliers_sql("lineitem", LINEITEM_NUMBERS)
        + "SELECT * FROM outliers ORDER BY n_outliers DESC, column_pos LIMIT 5",
    ),
    Query(
        "outlier_rows",
        lambda load: stats.outlier_rows(load("events"), "value").select("event_id", "user_id", "event_type", "value"),
        OUTLIER_ROWS,
    ),
    Query("boxplot_stats", lambda load: rounded(stats.boxplot_stats(load("lineitem"))), BOXPLOT),
    Query("variances", lambda load: rounded(stats.variances(load("lineitem")), 2), VARIANCES),
    Query(
        "max_variance_column",
        lambda load: rounded(stats.max_variance_column(load("lineitem")), 2),
        f"SELECT * FROM ({VARIANCES}) ORDER BY variance DESC, column_pos LIMIT 1",
    ),
    Query("distinct_counts", lambda load: rounded(stats.distinct_counts(load("lineitem"))), DISTINCT),
    Query(
        "categorical_summary",
        lambda load: rounded(frequency.categorical_summary(load("orders"))),
        counts_sql("orders", CATEGORICAL_ORDERS, 5),
    ),
    Query(
        "value_counts",
        lambda load: rounded(frequency.value_counts(load("documents"), ["text", "lang", "source"])),
        counts_sql("documents", ["text", "lang", "source"], 10),
    ),
    Query(
        "value_shares",
        lambda load: rounded(frequency.value_shares(load("customer"), "c_mktsegment")),
        f"SELECT c_mktsegment AS value, count(*) AS n, {r('count(*) / (SELECT count(c_mktsegment) FROM customer)')} "
        "AS share FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1",
    ),
    Query(
        "numeric_summary_non_finite",
        lambda load: rounded(stats.numeric_summary(lineitem_non_finite(load)), mean=4, std=4),
        f"WITH {LINEITEM_WITH_NULLS}\n" + summary_sql("lineitem_with_nulls", NULLED_NUMBERS),
    ),
    Query(
        "iqr_outliers_non_finite",
        lambda load: rounded(stats.iqr_outliers(lineitem_non_finite(load))),
        outliers_sql("lineitem_with_nulls", NULLED_NUMBERS, LINEITEM_WITH_NULLS + ",\n") + "SELECT * FROM outliers",
    ),
    Query(
        "histogram_non_finite",
        lambda load: rounded(stats.histogram(lineitem_non_finite(load), "l_extendedprice"), 4),
        HISTOGRAM.replace("FROM lineitem", "FROM (SELECT * FROM lineitem WHERE l_linenumber > 1) AS lineitem"),
    ),
    Query("histogram", lambda load: rounded(stats.histogram(load("lineitem"), "l_extendedprice"), 4), HISTOGRAM),
    Query("normal_fit", lambda load: rounded(stats.normal_fit(load("orders"), "o_totalprice"), 4), NORMAL_FIT),
    Query("drop_sparse_columns", lambda load: clean.drop_sparse_columns(_sparse(load)), SPARSE),
    Query(
        "dedup_rows",
        lambda load: clean.dedup_rows(load("documents").select(*DEDUP_COLUMNS.split(", "))),
        f"SELECT DISTINCT {DEDUP_COLUMNS} FROM documents",
    ),
    Query(
        "duplicate_count",
        lambda load: clean.duplicate_count(load("documents").drop("doc_id")),
        f"SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates "
        f"FROM (SELECT count(*) AS n FROM documents GROUP BY {DEDUP_COLUMNS})",
    ),
    Query(
        "nullify_infinite",
        _infinite,
        f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
        f"{r('CASE WHEN l_linenumber > 2 THEN l_extendedprice END')} AS price FROM lineitem",
    ),
    Query("clean", _cleaned, CLEANED),
    Query(
        "quality_recommendations",
        lambda load: rounded(readiness.quality_recommendations(load("customer"))),
        RECOMMENDATIONS,
    ),
    Query(
        "quality_warnings",
        lambda load: rounded(readiness.quality_warnings(
            load("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment",
                                    (F.col("c_acctbal") * 2).alias("double_balance")))),
        WARNINGS,
    ),
    Query(
        "quality_warnings_one_column",
        lambda load: rounded(readiness.quality_warnings(load("customer").select("c_name"))),
        f"""SELECT 'one_column' AS kind, CAST(NULL AS VARCHAR) AS "column", CAST(NULL AS VARCHAR) AS other, 1.0::DOUBLE AS value
UNION ALL SELECT 'no_numeric_column', NULL, NULL, 0.0
UNION ALL SELECT 'high_cardinality', 'c_name', NULL, {r('count(DISTINCT c_name) / count(*)')} FROM customer HAVING count(DISTINCT c_name) / count(*) > 0.5""",
    ),
]
