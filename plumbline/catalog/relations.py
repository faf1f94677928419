"""Catalogue: correlations and importance."""

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
from plumbline.operators import correlate


def matrix_sql(table: str, columns: list[str]) -> str:
    """CTE text: (var1, var2, pos1, pos2, r); r is null for constant columns."""
    rows = union(
        [f"{a} {b}" for a in columns for b in columns],
        lambda i, pair: _pair(table, columns, *pair.split()),
    )
    return f"matrix AS ({rows})"


def _pair(table: str, columns: list[str], a: str, b: str) -> str:
    value = f"corr({a}, {b})" if a != b else f"CASE WHEN var_samp({a}) > 0 THEN 1.0 END"
    return (
        f"SELECT '{a}' AS var1, '{b}' AS var2, CAST({columns.index(a)} AS BIGINT) AS pos1, "
        f"CAST({columns.index(b)} AS BIGINT) AS pos2, "
        f"CASE WHEN isnan({value}) THEN NULL ELSE CAST({value} AS DOUBLE) END AS r FROM {table}"
    )


# Five numeric columns of which several pairs are strong.
LINKED = ["price", "discounted", "quantity", "tax", "part"]
LINKED_SQL = """linked AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS discounted,
  l_quantity + l_tax * 400 AS quantity, l_tax AS tax, l_partkey AS part FROM lineitem)"""


def _linked(load):
    return load("lineitem").select(
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("discounted"),
        (F.col("l_quantity") + F.col("l_tax") * 400).alias("quantity"),
        F.col("l_tax").alias("tax"),
        F.col("l_partkey").alias("part"),
    )


def _linked_matrix(load):
    return correlate.correlation_matrix(_linked(load))


WITH_LINKED = f"WITH {LINKED_SQL},\n{matrix_sql('linked', LINKED)}\n"
WITH_LINEITEM = f"WITH {matrix_sql('lineitem', LINEITEM_NUMBERS)}\n"
TOP = "SELECT var1, avg(abs(r)) AS m, any_value(pos1) AS pos FROM matrix GROUP BY var1 ORDER BY m DESC, pos LIMIT 5"

IMPUTED = "imputed AS (SELECT " + ", ".join(
    f"coalesce({c}, (SELECT avg({c}) FROM lineitem_with_nulls)) AS {c}" for c in NULLED_NUMBERS
) + " FROM lineitem_with_nulls)"

TARGET_LINKS = f"""
, links AS (SELECT var2 AS variable, abs(r) AS a, row_number() OVER (ORDER BY abs(r) DESC, pos2) AS rank
  FROM matrix WHERE var1 = 'price')
SELECT variable, {r('a', 5)} AS abs_r, rank, a > 0.3 AS is_strong,
  (SELECT count(*) FROM links WHERE a > 0.3) - 1 AS n_strong_predictors,
  {r('(SELECT a FROM links WHERE rank = 2)', 5)} AS max_correlation FROM links"""

QUERIES = [
    Query(
        "correlation_matrix",
        lambda load: rounded(correlate.correlation_matrix(load("lineitem")), 5),
        WITH_LINEITEM + f"SELECT var1, var2, pos1, pos2, {r('r', 5)} AS r FROM matrix",
    ),
    Query(
        "correlation_matrix_non_finite",
        lambda load: rounded(correlate.correlation_matrix(lineitem_non_finite(load)), 5),
        f"WITH {LINEITEM_WITH_NULLS},\n{matrix_sql('lineitem_with_nulls', NULLED_NUMBERS)}\n"
        f"SELECT var1, var2, pos1, pos2, {r('r', 5)} AS r FROM matrix",
    ),
    Query(
        "correlation_matrix_with_nulls",
        lambda load: rounded(correlate.correlation_matrix(lineitem_with_nulls(load)), 5),
        f"WITH {LINEITEM_WITH_NULLS},\n{matrix_sql('lineitem_with_nulls', NULLED_NUMBERS)}\n"
        f"SELECT var1, var2, pos1, pos2, {r('r', 5)} AS r FROM matrix",
    ),
    Query(
        "strong_correlations",
        lambda load: rounded(correlate.strong_correlations(_linked_matrix(load)), 5),
        WITH_LINKED + f"SELECT var1, var2, {r('r', 5)} AS r FROM matrix WHERE pos1 < pos2 AND abs(r) > 0.5",
    ),
    Query(
        "redundant_pairs",
        lambda load: rounded(correlate.redundant_pairs(_linked_matrix(load)), 5),
        WITH_LINKED + f"SELECT var1, var2, {r('abs(r)', 5)} AS r FROM matrix WHERE pos1 < pos2 AND abs(r) > 0.8",
    ),
    Query(
        "target_correlations",
        lambda load: rounded(correlate.target_correlations(_linked_matrix(load), "quantity"), 5),
        WITH_LINKED + f"SELECT var2 AS variable, {r('r', 5)} AS r FROM matrix "
        "WHERE var1 = 'quantity' AND var2 <> 'quantity' AND abs(r) > 0.3",
    ),
    Query(
        "target_relationships",
        lambda load: rounded(correlate.target_relationships(_linked_matrix(load), "price"), 5),
        WITH_LINKED + TARGET_LINKS,
    ),
    Query(
        "top_correlated_features",
        lambda load: rounded(correlate.top_correlated_features(correlate.correlation_matrix(load("lineitem")), 5), 5),
        WITH_LINEITEM + f"SELECT var1 AS variable, CAST(pos AS BIGINT) AS variable_pos, {r('m', 5)} AS mean_abs_r FROM ({TOP})",
    ),
    Query(
        "heatmap_table",
        lambda load: rounded(correlate.heatmap_table(correlate.correlation_matrix(load("lineitem")), 5), 5),
        WITH_LINEITEM + f", top AS ({TOP}) SELECT var1, var2, pos1, pos2, {r('r', 5)} AS r FROM matrix "
        "WHERE var1 IN (SELECT var1 FROM top) AND var2 IN (SELECT var1 FROM top)",
    ),
    Query(
        "correlation_importance",
        lambda load: rounded(correlate.correlation_importance(lineitem_with_nulls(load)), 5),
        f"WITH {LINEITEM_WITH_NULLS},\n{IMPUTED},\n{matrix_sql('imputed', NULLED_NUMBERS)}\n"
        f"SELECT var1 AS variable, {r('avg(abs(r))', 5)} AS importance FROM matrix GROUP BY var1",
    ),
    Query(
        "variance_importance",
        lambda load: rounded(correlate.variance_importance(lineitem_with_nulls(load)), 2),
        f"WITH {LINEITEM_WITH_NULLS},\n{IMPUTED}\n" + union(
            NULLED_NUMBERS, lambda i, c: f"SELECT '{c}' AS variable, {r(f'var_samp({c})', 2)} AS importance FROM imputed"),
    ),
]
