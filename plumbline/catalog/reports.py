"""Catalogue: summaries of a profile and ad-hoc questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.base import LINEITEM_NUMBERS, PLACES, Query, places, r, rounded, union
from plumbline.catalog.columns import HISTOGRAM, NORMAL_FIT, boxplot_sql, counts_sql, outliers_sql
from plumbline.catalog.kinds import _labelled, types_sql
from plumbline.catalog.daily import LARGEST_DECOMPOSED, ROW_SERIES, _cents
from plumbline.catalog.geography import CONTOURS, GRID
from plumbline.catalog.modelling import LINE, SUGGESTED, _on_a_line
from plumbline.catalog.relations import WITH_LINKED, _linked, _linked_matrix, matrix_sql
from plumbline.catalog.texts import LENGTHS
from plumbline.operators import models, readiness, stats
from plumbline.plans import profile, report


def _key_stats(load):
    df = load("lineitem")
    summary = stats.numeric_summary(df)
    return rounded(report.key_stats(summary, stats.iqr_outliers(df, summary=summary)), mean=4, std=4)


KEY_STATS = outliers_sql("lineitem", LINEITEM_NUMBERS) + ", moments AS (" + union(LINEITEM_NUMBERS, lambda i, c: (
    f"SELECT '{c}' AS \"column\", {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, "
    f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max FROM lineitem"
)) + f""") SELECT m."column", mean, std, min, max, n_outliers, {r('pct', 2)} AS pct FROM moments m JOIN outliers o ON m."column" = o."column" """


def _key_patterns(load):
    features = models.Features(load("part"))
    return rounded(report.key_patterns(models.cluster_profile(features), models.dimensionality(features)))


def _key_patterns_groups(load):
    features = models.Features(_on_a_line(load))
    return rounded(report.key_patterns(models.cluster_profile(features), models.dimensionality(features)))


# All columns lie on one line, so that one component has all of the variance.
KEY_PATTERNS_GROUPS = f"""WITH RECURSIVE {LINE}
SELECT 'clusters' AS pattern, 'count' AS key, count(*)::DOUBLE AS value FROM chosen
UNION ALL SELECT 'clusters', 'size_' || cluster, size::DOUBLE FROM chosen
UNION ALL SELECT 'dimensionality', 'components_95', 1.0 UNION ALL SELECT 'dimensionality', 'reduction_ratio', {r('1 / 3.0')}"""


def _implications(load):
    part = load("part")
    classes = readiness.classification_readiness(part, "p_type")
    numbers = readiness.regression_readiness(part, "p_retailprice")
    return report.implications(
        part, readiness.predictive_readiness(part), readiness.suggest_models(classes, numbers),
        readiness.quality_recommendations(part))


def _distribution(load):
    orders = load("orders")
    parts = [
        report.drill_down(orders, "analyze_column_distribution", {"column_name": c}).withColumn("column", F.lit(c))
        for c in ("o_totalprice", "o_orderpriority")
    ]
    return rounded(parts[0].unionByName(parts[1]), 4)


DISTRIBUTION = outliers_sql("orders", ["o_totalprice"]) + ", d AS (" + counts_sql("orders", ["o_orderpriority"], 10) + ") " + "\nUNION ALL\n".join(
    [
        f"SELECT 'o_totalprice' AS \"column\", 'numeric' AS type, 'statistics' AS section, '{item}' AS item, {r(value, 4)} AS value FROM orders"
        for item, value in [
            ("count", "count(o_totalprice)"), ("mean", "avg(o_totalprice)"), ("std", "stddev_samp(o_totalprice)"),
            ("min", "min(o_totalprice)"), ("q25", "quantile_cont(o_totalprice, 0.25)"),
            ("q50", "quantile_cont(o_totalprice, 0.5)"), ("q75", "quantile_cont(o_totalprice, 0.75)"), ("max", "max(o_totalprice)"),
        ]
    ]
    + [
        f"SELECT 'o_totalprice', 'numeric', 'has_outliers', 'has_outliers', {r('CASE WHEN n_outliers > 0 THEN 1 ELSE 0 END')} FROM outliers",
        f"SELECT 'o_orderpriority', 'categorical', 'value_counts', value, {r('n')} FROM d",
        f"SELECT 'o_orderpriority', 'categorical', 'unique_values', 'unique_values', {r('count(DISTINCT o_orderpriority)')} FROM orders",
    ]
)

IMPLICATIONS = f"""
WITH suggested AS ({SUGGESTED})
SELECT 'data_quality' AS topic, 'completeness' AS key,
  CAST(1 - avg((CASE WHEN p_partkey IS NULL THEN 1.0 ELSE 0.0 END + CASE WHEN p_name IS NULL THEN 1.0 ELSE 0.0 END
    + CASE WHEN p_brand IS NULL THEN 1.0 ELSE 0.0 END + CASE WHEN p_type IS NULL THEN 1.0 ELSE 0.0 END
    + CASE WHEN p_size IS NULL THEN 1.0 ELSE 0.0 END + CASE WHEN p_retailprice IS NULL THEN 1.0 ELSE 0.0 END) / 6) AS VARCHAR) AS value
FROM part
UNION ALL SELECT 'data_quality', 'consistency', 'true'
UNION ALL SELECT 'predictive_potential', 'suitable_for_ml', CASE WHEN count(*) >= 100 THEN 'true' ELSE 'false' END FROM part
UNION ALL SELECT 'predictive_potential', 'suggested_approach', suggestion FROM suggested
UNION ALL """ + union(["p_name", "p_brand", "p_type"], lambda i, c: (
    f"SELECT 'data_quality', 'recommendation', 'High cardinality in {c} might need grouping' "
    f"FROM part HAVING count(DISTINCT {c}) / count(*) > 0.5 UNION ALL "
    f"SELECT 'data_quality', 'recommendation', 'Consider addressing imbalance in {c}' "
    f"FROM (SELECT count(*) AS n FROM part GROUP BY {c}) HAVING max(n) / sum(n) > 0.8"))

SUMMARY = f"""{outliers_sql('linked', ['price', 'discounted', 'quantity', 'tax', 'part'], WITH_LINKED.removeprefix('WITH ') + ',')}
SELECT (SELECT count(*) FROM linked) AS n_rows, CAST(5 AS BIGINT) AS n_columns, CAST(5 AS BIGINT) AS n_numeric,
  CAST(0 AS BIGINT) AS n_categorical, false AS has_missing, (SELECT bool_or(n_outliers > 0) FROM outliers) AS has_outliers,
  (SELECT count(*) FROM matrix WHERE pos1 < pos2 AND abs(r) > 0.5) AS n_strong_correlations, CAST(0 AS BIGINT) AS n_clusters,
  '' AS patterns"""

# The late elbow rule chooses one cluster more than the groups that the rows fall into.
GROUPED = """grouped AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 10.0 ELSE 5.0 END + (o_orderkey % 7) / 100.0 AS x,
  CASE o_custkey % 3 WHEN 2 THEN 8.66 ELSE 0.0 END + (o_orderkey % 11) / 100.0 AS y FROM orders)"""
SUMMARY_CLUSTERS = f"""{outliers_sql('grouped', ['x', 'y'], f"{GROUPED}, {matrix_sql('grouped', ['x', 'y'])},")}
SELECT (SELECT count(*) FROM grouped) AS n_rows, CAST(2 AS BIGINT) AS n_columns, CAST(2 AS BIGINT) AS n_numeric,
  CAST(0 AS BIGINT) AS n_categorical, false AS has_missing, (SELECT bool_or(n_outliers > 0) FROM outliers) AS has_outliers,
  (SELECT count(*) FROM matrix WHERE pos1 < pos2 AND abs(r) > 0.5) AS n_strong_correlations,
  (SELECT count(DISTINCT o_custkey % 3) + 1 FROM orders) AS n_clusters, '' AS patterns"""


def _grouped_summary(load):
    """Orders as three groups of points, by customer."""
    group = F.col("o_custkey") % 3
    df = load("orders").select(
        (F.when(group == 0, 0.0).when(group == 1, 10.0).otherwise(5.0) + F.col("o_orderkey") % 7 / 100.0).alias("x"),
        (F.when(group == 2, 8.66).otherwise(0.0) + F.col("o_orderkey") % 11 / 100.0).alias("y"),
    )
    return rounded(report.analysis_summary(df, n_clusters=models.cluster(df).best))


PATTERNS = f"WITH {PLACES}\nSELECT 'geographic' AS pattern, \"column\" AS item, value AS key, CAST(n AS VARCHAR) AS value FROM ({counts_sql('places', ['region', 'country'], 10)})"

def _dated_patterns(load):
    """Values that are numbers apart from those that are not."""
    found = report.detect_patterns(load("orders"))
    number_ = F.expr("try_cast(value AS double)")
    return rounded(found.select("pattern", "item", "key", F.when(number_.isNull(), F.col("value")).alias("value"), number_.alias("number")), 2)


DATED_PATTERNS = f"""SELECT 'time_series' AS pattern, 'o_orderdate' AS item, part || '_' || idx AS key, NULL AS value, {r('value', 2)} AS number
FROM ({ROW_SERIES.replace("CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price", "o_orderkey::DOUBLE AS price")})
UNION ALL SELECT 'time_series', 'o_orderdate', 'start_date', min(o_orderdate)::DATE::VARCHAR, NULL FROM orders
UNION ALL SELECT 'time_series', 'o_orderdate', 'end_date', max(o_orderdate)::DATE::VARCHAR, NULL FROM orders
UNION ALL SELECT 'time_series', 'o_orderdate', 'span_days', NULL, {r("date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)", 2)} FROM orders"""

CHARTS = f"""WITH {types_sql()},
second AS (SELECT tbl, CASE
    WHEN bool_or(dataset_type = 'high_dimensional') THEN 'clustering_pca' WHEN bool_or(dataset_type = 'time_series') THEN 'seasonality'
    WHEN bool_or(dataset_type = 'geographic') THEN 'spatial_distribution' WHEN bool_or(dataset_type = 'text_heavy') THEN 'text_length_dist'
    WHEN bool_or(dataset_type = 'classification') THEN 'class_distribution' ELSE 'target_distribution' END AS chart FROM types GROUP BY tbl)
SELECT tbl, CAST(position AS BIGINT) AS position, chart FROM (
  SELECT tbl, 0 AS position, 'correlation_heatmap' AS chart FROM second
  UNION ALL SELECT tbl, 1, chart FROM second
  UNION ALL SELECT tbl, 2, 'outliers_boxplot' FROM second)"""


def _charts(load):
    return _labelled(load, report.select_chart_tables).drop("operator")


def _visualization(load):
    """Suggestions for the column that varies most together with a class column."""
    orders = load("orders")
    varied = stats.max_variance_column(orders).first()["column"]
    return rounded(report.suggest_visualization(orders, [varied, "o_orderstatus"]).withColumn("column", F.lit(varied)))


VISUALIZATION = """
WITH v AS (SELECT CASE WHEN var_samp(o_totalprice) >= greatest(var_samp(o_orderkey), var_samp(o_custkey)) THEN 'o_totalprice'
  WHEN var_samp(o_orderkey) >= var_samp(o_custkey) THEN 'o_orderkey' ELSE 'o_custkey' END AS name FROM orders)
SELECT CAST(0 AS BIGINT) AS position, 'box plot' AS chart, 'Show distribution by category' AS description, name AS "column" FROM v
UNION ALL SELECT CAST(1 AS BIGINT), 'violin plot', 'Show detailed distribution by category', name FROM v"""


def _run(load):
    orders = load("orders")
    return profile.run_profile(orders.sparkSession, orders)


RUN = """SELECT CAST(position AS BIGINT) AS position, analysis, 'ok' AS status FROM (VALUES (0, 'load'), (1, 'basic_stats'),
  (2, 'outliers'), (3, 'correlations'), (4, 'seasonality'), (5, 'trend'), (6, 'forecasting'), (7, 'feature_importance'),
  (8, 'predictive_power')) AS t(position, analysis) WHERE (SELECT count(*) FROM orders) > 0"""

FINDINGS = """
WITH n AS (SELECT count(*) AS rows FROM (SELECT DISTINCT * FROM orders))
SELECT 'dataset' AS section, 'rows' AS key, CAST(rows AS VARCHAR) AS value FROM n
UNION ALL SELECT 'dataset', 'columns', '6' UNION ALL SELECT 'dataset', 'numeric_features', '3'
UNION ALL SELECT 'dataset', 'categorical_features', '3'
UNION ALL SELECT 'dataset_types', 'time_series', 'true' FROM orders HAVING count(o_orderdate) / count(*) > 0.5
UNION ALL SELECT 'dataset_types', 'classification', 'true' FROM orders
  HAVING count(DISTINCT o_orderstatus) < 10 OR count(DISTINCT o_orderpriority) < 10 OR count(DISTINCT o_orderdate) < 10
UNION ALL SELECT 'dataset_types', 'regression', 'true' FROM orders
  HAVING count(DISTINCT o_orderkey) > 10 OR count(DISTINCT o_custkey) > 10 OR count(DISTINCT o_totalprice) > 10"""

def _chart(table, name: str, decimals: int = 5, drop=(), **special: int):
    """The data of a chart as the profile of a table holds them."""
    def run(load):
        df = load(table) if isinstance(table, str) else table(load)
        return rounded(profile.run_profile(df.sparkSession, df, only=[]).tables[f"chart_{name}"].drop(*drop), decimals, **special)
    return run


def _balances(load):
    """A number to learn, and nothing else that calls for a chart."""
    return load("customer").select("c_name", "c_acctbal")


ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
HEATMAP = f"WITH {matrix_sql('orders', ORDER_NUMBERS)} SELECT var1, var2, pos1, pos2, {r('r', 5)} AS r FROM matrix"
CLASS_CHART = "SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1"


def _wide_findings(load):
    """All that the types of lineitem call for; the number of clusters is left to the query on groups."""
    lineitem = load("lineitem")
    return report.report_findings(profile.run_profile(lineitem.sparkSession, lineitem)).where("section <> 'clustering'")


WIDE_FINDINGS = f"""
WITH n AS (SELECT count(*) AS rows FROM (SELECT DISTINCT * FROM lineitem))
SELECT 'dataset' AS section, 'rows' AS key, CAST(rows AS VARCHAR) AS value FROM n
UNION ALL SELECT 'dataset', 'columns', '11' UNION ALL SELECT 'dataset', 'numeric_features', '{len(LINEITEM_NUMBERS)}'
UNION ALL SELECT 'dataset', 'categorical_features', '3'
UNION ALL SELECT 'dimensionality', 'total_features', '{len(LINEITEM_NUMBERS)}'
UNION ALL SELECT 'dataset_types', 'time_series', 'true' FROM lineitem HAVING count(l_shipdate) / count(*) > 0.5
UNION ALL SELECT 'dataset_types', 'classification', 'true' FROM lineitem
  HAVING count(DISTINCT l_returnflag) < 10 OR count(DISTINCT l_linestatus) < 10 OR count(DISTINCT l_shipdate) < 10
UNION ALL SELECT 'dataset_types', 'regression', 'true' FROM lineitem
  HAVING {' OR '.join(f'count(DISTINCT {c}) > 10' for c in LINEITEM_NUMBERS)}
UNION ALL SELECT 'dataset_types', 'high_dimensional', 'true' FROM n WHERE {len(LINEITEM_NUMBERS)} > 5"""


def _group_findings(load):
    """Rows in groups on a line, told apart by a text."""
    x = F.col("a")
    line = _on_a_line(load, "o_orderkey").select(
        F.concat(F.lit("o"), "o_orderkey").alias("name"), "a", "b", "c", *[(x * k + 1).alias(f"d{k}") for k in range(2, 6)])
    return report.report_findings(profile.run_profile(line.sparkSession, line))


GROUP_FINDINGS = f"""WITH RECURSIVE {LINE}
SELECT 'dataset' AS section, 'rows' AS key, count(DISTINCT o_orderkey)::VARCHAR AS value FROM orders
UNION ALL SELECT 'dataset', 'columns', '8' UNION ALL SELECT 'dataset', 'numeric_features', '7'
UNION ALL SELECT 'dataset', 'categorical_features', '1' UNION ALL SELECT 'dataset_types', 'high_dimensional', 'true'
UNION ALL SELECT 'clustering', 'optimal_clusters', k::VARCHAR FROM best UNION ALL SELECT 'dimensionality', 'total_features', '7'"""

QUERIES = [
    Query("key_stats", _key_stats, KEY_STATS),
    Query("key_patterns", _key_patterns),
    Query("key_patterns_groups", _key_patterns_groups, KEY_PATTERNS_GROUPS),
    Query(
        "key_relationships",
        lambda load: rounded(report.key_relationships(_linked_matrix(load)), 3),
        WITH_LINKED + f"SELECT var1, var2, {r('r', 3)} AS strength FROM matrix WHERE pos1 < pos2 AND abs(r) > 0.5",
    ),
    Query("implications", _implications, IMPLICATIONS),
    Query("column_distribution", _distribution, DISTRIBUTION),
    Query(
        "find_correlations",
        lambda load: rounded(report.drill_down(_linked(load), "find_correlations", '{"target_column": "price"}'), 5),
        WITH_LINKED + f"SELECT var2 AS variable, {r('r', 5)} AS r FROM matrix WHERE var1 = 'price' AND var2 <> 'price' AND abs(r) > 0.3",
    ),
    Query("suggest_visualization", _visualization, VISUALIZATION),
    Query("select_chart_tables", _charts, CHARTS),
    Query("analysis_summary", lambda load: rounded(report.analysis_summary(_linked(load))), SUMMARY),
    Query("analysis_summary_clusters", _grouped_summary, SUMMARY_CLUSTERS),
    Query("detect_patterns", lambda load: report.detect_patterns(places(load)), PATTERNS),
    Query("detect_patterns_dated", _dated_patterns, DATED_PATTERNS),
    Query("run_profile", lambda load: rounded(_run(load).status.drop("message")), RUN),
    Query("profile_heatmap", _chart("orders", "correlation_heatmap"), HEATMAP),
    Query("profile_boxplot", _chart("orders", "outliers_boxplot", 6, drop=["column_pos"]), f"SELECT * EXCLUDE column_pos FROM ({boxplot_sql('orders', ORDER_NUMBERS)})"),
    Query("profile_seasonality", _chart(_cents, "seasonality", 3), LARGEST_DECOMPOSED),
    Query("profile_classes", _chart(lambda load: load("orders").drop("o_orderdate"), "class_distribution"), CLASS_CHART),
    Query("profile_text_lengths", _chart("documents", "text_length_dist", 4), LENGTHS),
    Query("profile_target", _chart(_balances, "target_distribution", 4), HISTOGRAM.replace("l_extendedprice", "c_acctbal").replace("lineitem", "customer")),
    Query("profile_target_fit", _chart(_balances, "target_distribution_fit", 4), NORMAL_FIT.replace("o_totalprice", "c_acctbal").replace("orders", "customer")),
    Query("profile_density_grid", _chart(places, "spatial_distribution"), GRID),
    Query("profile_contours", _chart(places, "spatial_distribution_contours", density=9), CONTOURS),
    Query("report_findings", lambda load: report.report_findings(_run(load)), FINDINGS),
    Query("report_findings_wide", _wide_findings, WIDE_FINDINGS),
    Query("report_findings_groups", _group_findings, GROUP_FINDINGS),
]
