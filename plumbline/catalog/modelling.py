"""Catalogue: imputation, scaling, clusters, components, readiness for modelling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from plumbline.catalog.base import (
    LINEITEM_NUMBERS,
    LINEITEM_WITH_NULLS,
    NULLED_NUMBERS,
    Query,
    lineitem_with_nulls,
    r,
    rounded,
    union,
)
from plumbline.catalog.columns import summary_sql
from plumbline.catalog.relations import IMPUTED, LINKED, LINKED_SQL, _linked, matrix_sql
from plumbline.operators import models, readiness, stats

KEYED = ["order_key", "line"]
# Every numeric column of lineitem, some of them with gaps, and a constant: column -> (Spark, SQL).
GAPS = {
    "l_quantity": (lambda: F.when(F.col("l_quantity") < 40, F.col("l_quantity").cast("int")), "CASE WHEN l_quantity < 40 THEN CAST(l_quantity AS INTEGER) END"),
    "l_extendedprice": (lambda: F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice")), "CASE WHEN l_linenumber > 1 THEN l_extendedprice END"),
    "l_discount": (lambda: F.nullif("l_discount", F.lit(0.05)), "nullif(l_discount, 0.05)"),
    "l_tax": (lambda: F.when(F.col("l_quantity") < 40, F.col("l_tax")), "CASE WHEN l_quantity < 40 THEN l_tax END"),
    "constant": (lambda: F.lit(3.0), "CAST(3.0 AS DOUBLE)"),
}
MEASURED = [*LINEITEM_NUMBERS, "constant"]


def _keyed(load):
    """All numeric columns next to the row keys, which are in the table a second time."""
    return load("lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        *[(GAPS[c][0]() if c in GAPS else F.col(c)).alias(c) for c in MEASURED],
    )


KEYED_SQL = "keyed AS (SELECT l_orderkey AS order_key, l_linenumber AS line, " + ", ".join(
    f"{GAPS[c][1] if c in GAPS else c} AS {c}" for c in MEASURED) + " FROM lineitem)"
FILLED = "filled AS (SELECT order_key, CAST(line AS BIGINT) AS line, " + ", ".join(
    f"coalesce({c}, (SELECT avg({c}) FROM keyed)) AS {c}" for c in MEASURED) + " FROM keyed)"
STANDARDIZED = ", ".join(
    f"{r(f'coalesce(({c} - (SELECT avg({c}) FROM filled)) / nullif((SELECT stddev_pop({c}) FROM filled), 0), 0)', 5)} AS {c}"
    for c in MEASURED
)


def _matrix(load):
    found = models.feature_matrix(_keyed(load), MEASURED).select(*KEYED, vector_to_array("features").alias("f"))
    return rounded(found.select(*KEYED, *[F.col("f")[i].alias(c) for i, c in enumerate(MEASURED)]), 5)


BALANCE = f"""
SELECT count(*) AS n_classes, {r('min(n) / max(n)')} AS ratio,
  CASE WHEN min(n) / max(n) > 0.3 THEN 'balanced' ELSE 'imbalanced' END AS interpretation,
  min(n) AS smallest_class, min(n) >= 30 AS sufficient FROM (SELECT count(*) AS n FROM conversations GROUP BY role)"""

# The published formulas of the two normal scores, written out for SQL.
SHAPE = """shape AS (
  SELECT CAST(count({x}) AS DOUBLE) AS n, skewness({x}) AS skew, kurtosis_pop({x}) + 3 AS b2, min({x}) AS lo, max({x}) AS hi,
         stddev_samp({x}) AS sd FROM {table}),
scores AS (
  SELECT *, skew * (n - 2) / sqrt(n * (n - 1)) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
    -1 + sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) AS w2,
    (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM shape),
more AS (
  SELECT *, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a, sqrt(2 / (w2 - 1)) AS alpha FROM scores),
last AS (
  SELECT *, ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) / sqrt(0.5 * ln(w2)) AS z1, 1 + x * sqrt(2 / (a - 4)) AS d FROM more),
tested AS (
  SELECT *, (1 - 2 / (9 * a) - sign(d) * cbrt((1 - 2 / a) / abs(d))) / sqrt(2 / (9 * a)) AS z2 FROM last)"""
SHAPE_COLUMNS = (
    f"{r('skew')} AS skewness, {r('exp(-(z1 * z1 + z2 * z2) / 2)')} AS normality_p, "
    f"exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal, {r('lo')} AS min, {r('hi')} AS max, {r('sd', 4)} AS std"
)

Z_RATIO = """(SELECT avg(CASE WHEN abs({x} - m) / s > 3 THEN 1.0 ELSE 0.0 END)
  FROM {table}, (SELECT avg({x}) AS m, stddev_pop({x}) AS s FROM {table}) WHERE {x} IS NOT NULL)"""


def quality_sql(table: str, x: str) -> str:
    return (
        f"{r(f'(SELECT 1 - count({x}) / count(*) FROM {table})')} AS missing_ratio, "
        f"{r(f'(SELECT count(DISTINCT {x}) / count(*) FROM {table})')} AS unique_ratio, "
        f"{r(Z_RATIO.format(x=x, table=table))} AS outlier_ratio"
    )


CLASSES = f"""
SELECT 'p_type' AS target, count(*) AS n_classes, {r('min(n) / max(n)')} AS ratio,
  CASE WHEN min(n) / max(n) > 0.3 THEN 'balanced' ELSE 'imbalanced' END AS interpretation, min(n) AS smallest_class,
  min(n) >= 30 AS sufficient, CAST(3 AS BIGINT) AS numeric_features, CAST(3 AS BIGINT) AS categorical_features,
  CAST(0 AS DOUBLE) AS missing_value_impact FROM (SELECT count(*) AS n FROM part GROUP BY p_type)"""

REGRESSION = f"""WITH {LINKED_SQL},
{matrix_sql('linked', LINKED)},
{SHAPE.format(x='price', table='linked')},
links AS (SELECT var2, abs(r) AS a, row_number() OVER (ORDER BY abs(r) DESC, pos2) AS rank FROM matrix WHERE var1 = 'price')
SELECT 'price' AS target, {SHAPE_COLUMNS}, (SELECT count(*) FROM links WHERE a > 0.3) - 1 AS n_strong_predictors,
  {r('(SELECT a FROM links WHERE rank = 2)', 5)} AS max_correlation, {quality_sql('linked', 'price')} FROM tested"""

PREDICTIVE = f"""WITH {LINEITEM_WITH_NULLS},
f AS (SELECT count(*) AS n, 1 - ({' + '.join(f'(count(*) - count({c}))' for c in NULLED_NUMBERS)}) / (count(*) * {len(NULLED_NUMBERS)}.0) AS c
  FROM lineitem_with_nulls)
SELECT n AS n_samples, CAST({len(NULLED_NUMBERS)} AS BIGINT) AS n_features, {r(f'n / {len(NULLED_NUMBERS)}')} AS samples_per_feature,
  n >= 100 AND n >= {10 * len(NULLED_NUMBERS)} AS sufficient_volume, {r('c')} AS feature_completeness,
  {r(f'c * least(1.0, n / {10 * len(NULLED_NUMBERS)}.0)')} AS quality_score, n >= 100 AND c > 0.7 AS suitable_for_ml FROM f"""

SUGGESTED = f"""WITH {SHAPE.format(x='p_retailprice', table='part')},
classes AS (SELECT count(*) AS k, min(n) / max(n) AS ratio FROM (SELECT count(*) AS n FROM part GROUP BY p_type)),
p AS (SELECT exp(-(z1 * z1 + z2 * z2) / 2) > 0.05 AS is_normal FROM tested)
SELECT unnest(list_distinct(list_filter([
  CASE WHEN k = 2 THEN 'logistic_regression' END, 'random_forest_classifier', 'gradient_boosting_classifier',
  CASE WHEN k <> 2 THEN 'neural_network_classifier' END,
  CASE WHEN ratio < 0.3 THEN 'smote_balancing' END, CASE WHEN ratio < 0.3 THEN 'weighted_models' END,
  'random_forest_regressor', 'gradient_boosting_regressor',
  CASE WHEN NOT is_normal THEN 'target_transformation' END, CASE WHEN NOT is_normal THEN 'quantile_regression' END],
  lambda m: m IS NOT NULL))) AS suggestion FROM classes, p"""


def _suggested(load):
    part = load("part")
    return readiness.suggest_models(
        readiness.classification_readiness(part, "p_type"),
        readiness.regression_readiness(part, "p_retailprice"),
    )


def _pca_moments(load):
    """Sums of powers of the variance shares: the traces of powers of the correlation matrix."""
    shares = models.pca_variance(load("lineitem"))
    return rounded(shares.agg(
        F.count("ratio").alias("n"), *[F.sum(F.pow("ratio", F.lit(k))).alias(f"power_{k}") for k in (1, 2, 3, 4)]), 5)


SCALED = f"""WITH {matrix_sql('lineitem', LINEITEM_NUMBERS)},
m AS (SELECT pos1 AS i, pos2 AS j, r / {len(LINEITEM_NUMBERS)} AS v FROM matrix),
squared AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY a.i, b.j)
SELECT CAST({len(LINEITEM_NUMBERS)} AS BIGINT) AS n, {r('(SELECT sum(v) FROM m WHERE i = j)', 5)} AS power_1,
  {r('(SELECT sum(v) FROM squared WHERE i = j)', 5)} AS power_2,
  {r('(SELECT sum(a.v * b.v) FROM squared a JOIN m b ON a.j = b.i AND a.i = b.j)', 5)} AS power_3,
  {r('(SELECT sum(a.v * b.v) FROM squared a JOIN squared b ON a.j = b.i AND a.i = b.j)', 5)} AS power_4"""

def jacobi(table: str, columns: list[str], sweeps: int = 8) -> str:
    """Eigenvalues and eigenvectors of the correlation matrix by Jacobi rotations, one pair of columns after the other:
    eigen (component, value), loadings (component, pos, loading)."""
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]

    def turned(m: str) -> str:
        """Columns p and q of a matrix turned."""
        return (
            f"list_transform(range({n * n}), lambda x: CASE WHEN x % {n} = p THEN c * {m}[x - x % {n} + p + 1] - s * {m}[x - x % {n} + q + 1] "
            f"WHEN x % {n} = q THEN s * {m}[x - x % {n} + p + 1] + c * {m}[x - x % {n} + q + 1] ELSE {m}[x + 1] END)"
        )

    flipped = lambda m: f"list_transform(range({n * n}), lambda x: {m}[(x % {n}) * {n} + x // {n} + 1])"
    return f"""{matrix_sql(table, columns)},
jac AS (
  SELECT 0 AS step, list(coalesce(r, 0.0)::DOUBLE ORDER BY pos1, pos2) AS a,
    list_transform(range({n * n}), lambda x: CASE WHEN x // {n} = x % {n} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM matrix
  UNION ALL
  SELECT step + 1, {turned(flipped('b'))} AS a, v FROM (
    SELECT step, p, q, c, s, {turned('a')} AS b, {turned('v')} AS v FROM (
      SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s FROM (
        SELECT *, CASE WHEN abs(a[p * {n} + q + 1]) < 1e-300 THEN 0.0
            ELSE (CASE WHEN a[q * {n} + q + 1] < a[p * {n} + p + 1] THEN -1 ELSE 1 END)
              / (abs((a[q * {n} + q + 1] - a[p * {n} + p + 1]) / (2 * a[p * {n} + q + 1]))
                + sqrt(1 + pow((a[q * {n} + q + 1] - a[p * {n} + p + 1]) / (2 * a[p * {n} + q + 1]), 2)))
              * sign(a[p * {n} + q + 1]) END AS t
        FROM (SELECT *, {[i for i, _ in pairs]}[step % {len(pairs)} + 1] AS p, {[j for _, j in pairs]}[step % {len(pairs)} + 1] AS q
              FROM jac WHERE step < {sweeps * len(pairs)}))))),
last AS (SELECT a, v FROM jac ORDER BY step DESC LIMIT 1),
eigen AS (
  SELECT row_number() OVER (ORDER BY value DESC) AS component, i, value
  FROM (SELECT unnest(range({n})) AS i, a FROM last) AS d, LATERAL (SELECT greatest(a[i * {n} + i + 1], 0) AS value)),
loadings AS (
  SELECT component, unnest(range({n})) AS pos, i, v FROM eigen, last),
shares AS (
  SELECT component, value / sum(value) OVER () AS ratio, sum(value) OVER (ORDER BY component) / sum(value) OVER () AS cumulative FROM eigen)"""


def dimensions_sql(n: int) -> str:
    return f"""SELECT CAST({n} AS BIGINT) AS total_features, c95 AS components_95, c90 AS components_90, {r(f'c95 / {n}')} AS reduction_ratio,
  c95 < {n} * 0.3 AS high_potential
FROM (SELECT min(component) FILTER (cumulative >= 0.95) AS c95, min(component) FILTER (cumulative >= 0.90) AS c90 FROM shares)"""


PCA = "WITH RECURSIVE " + jacobi("lineitem", LINEITEM_NUMBERS)
PCA_WEIGHTS = PCA + f"""
SELECT names."column", names.column_pos::BIGINT AS column_pos, weight FROM (
  SELECT pos, {r(f'avg(abs(v[pos * {len(LINEITEM_NUMBERS)} + i + 1]))', 5)} AS weight, avg(abs(v[pos * {len(LINEITEM_NUMBERS)} + i + 1])) AS exact
  FROM loadings WHERE component <= 3 GROUP BY pos) AS w
JOIN (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(LINEITEM_NUMBERS))}) AS names("column", column_pos) ON pos = column_pos
ORDER BY exact DESC, column_pos LIMIT 5"""

# Five groups of rows on a line, so that the best clusters are runs of neighbouring groups.
SPOTS = [0.0, 1.0, 40.0, 90.0, 200.0]


def _on_a_line(load, *more: str):
    x = F.element_at(F.array(*[F.lit(v) for v in SPOTS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return load("orders").select(*more, x.alias("a"), (x * 3 + 1).alias("b"), (100 - x).alias("c"))


LINE = f"""spots AS (SELECT row_number() OVER (ORDER BY x) AS j, x, n FROM (
  SELECT {SPOTS}[o_orderkey % 5 + 1] AS x, count(*) AS n FROM orders GROUP BY 1)),
spread AS (SELECT sum(n * x) / sum(n) AS m, sqrt(sum(n * x * x) / sum(n) - pow(sum(n * x) / sum(n), 2)) AS sd FROM spots),
runs AS (
  SELECT a.j AS first, b.j AS last, sum(s.n) AS size, sum(s.n * s.x) / sum(s.n) AS center,
    3 * (sum(s.n * s.x * s.x) - pow(sum(s.n * s.x), 2) / sum(s.n)) / pow(any_value(sd), 2) AS cost
  FROM spots a, spots b, spots s, spread WHERE s.j BETWEEN a.j AND b.j GROUP BY a.j, b.j),
ways AS (
  SELECT 1 AS k, last, greatest(cost, 0)::DOUBLE AS cost, [last] AS ends FROM runs WHERE first = 1
  UNION ALL SELECT k + 1, r.last, w.cost + greatest(r.cost, 0), list_append(ends, r.last) FROM ways w JOIN runs r ON r.first = w.last + 1),
parted AS (SELECT k, min(cost) AS cost, arg_min(ends, cost) AS ends FROM ways WHERE last = (SELECT max(j) FROM spots) GROUP BY k),
costs AS (SELECT ks.k, coalesce(cost, 0) AS inertia FROM (SELECT unnest(range(2, 11)) AS k) AS ks LEFT JOIN parted USING (k)),
bends AS (
  SELECT k, inertia, lead(inertia) OVER (ORDER BY k) - 2 * inertia + lag(inertia) OVER (ORDER BY k) AS bend FROM costs),
best AS (SELECT k + 1 AS k FROM bends WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1),
chosen AS (
  SELECT row_number() OVER (ORDER BY r.last) - 1 AS cluster, size, center FROM parted p JOIN best USING (k)
  JOIN runs r ON list_contains(p.ends, r.last)
    AND r.first = coalesce(list_max(list_filter(p.ends, lambda e: e < r.last)), 0) + 1)"""

CAUSES = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _caused(load):
    """A target that follows from the line number alone, next to columns that have nothing to do with it."""
    return load("lineitem").select(*CAUSES, (F.col("l_linenumber") * F.col("l_linenumber") % 11).alias("target"))


# A column that determines the target takes all of the importance if no other one does.
CAUSED = "WITH caused AS (SELECT " + ", ".join(CAUSES) + ", l_linenumber * l_linenumber % 11 AS target FROM lineitem)\n" + union(
    CAUSES, lambda i, c: f"""SELECT '{c}' AS "column", CASE WHEN max(n) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS importance
  FROM (SELECT count(DISTINCT target) AS n FROM caused GROUP BY {c})""")

QUERIES = [
    Query(
        "impute_mean",
        lambda load: rounded(models.impute_mean(_keyed(load), MEASURED), 4),
        f"WITH {KEYED_SQL},\n{FILLED}\nSELECT order_key, line, " + ", ".join(f"{r(c, 4)} AS {c}" for c in MEASURED) + " FROM filled",
    ),
    Query(
        "impute_mean_summary",
        lambda load: rounded(
            stats.numeric_summary(models.impute_mean(lineitem_with_nulls(load)), NULLED_NUMBERS), mean=4, std=4),
        f"WITH {LINEITEM_WITH_NULLS},\n{IMPUTED}\n" + summary_sql("imputed", NULLED_NUMBERS),
    ),
    Query(
        "standardize",
        lambda load: rounded(models.standardize(_keyed(load), MEASURED), 5),
        f"WITH {KEYED_SQL},\n{FILLED}\nSELECT order_key, line, {STANDARDIZED} FROM filled",
    ),
    Query(
        "feature_matrix",
        _matrix,
        f"WITH {KEYED_SQL},\n{FILLED}\nSELECT order_key, line, {STANDARDIZED} FROM filled",
    ),
    Query("kmeans_elbow", lambda load: rounded(models.kmeans_elbow(load("orders")))),
    Query("cluster_profile", lambda load: rounded(models.cluster_profile(load("orders")))),
    Query(
        "kmeans_elbow_groups", lambda load: rounded(models.kmeans_elbow(_on_a_line(load)), 4),
        f"""WITH RECURSIVE {LINE}
SELECT k, {r('inertia', 4)} AS inertia, {r('bend', 4)} AS second_difference, k = (SELECT k FROM best) AS is_chosen FROM bends""",
    ),
    Query(
        "cluster_profile_groups", lambda load: rounded(models.cluster_profile(_on_a_line(load))),
        f"""WITH RECURSIVE {LINE}
SELECT cluster, size::BIGINT AS size, name AS "column", pos AS column_pos, {r('CASE pos WHEN 0 THEN center WHEN 1 THEN center * 3 + 1 ELSE 100 - center END')} AS center
FROM chosen, (VALUES ('a', 0::BIGINT), ('b', 1), ('c', 2)) AS names(name, pos)""",
    ),
    Query(
        "pca_projection_groups",
        lambda load: rounded(models.pca_projection(_on_a_line(load)).groupBy(
            "kind", "cluster", F.round(F.abs("pc1"), 5).alias("pc1"), F.round(F.abs("pc2"), 5).alias("pc2"), "pct1", "pct2").count(), 5),
        f"""WITH RECURSIVE {LINE},
places AS (
  SELECT 'center' AS kind, cluster, center AS x, 1 AS n FROM chosen
  UNION ALL SELECT 'row', arg_min(cluster, abs(center - x)), x, any_value(n) FROM chosen, spots GROUP BY x)
SELECT kind, cluster, {r('sqrt(3) * abs(x - m) / sd', 5)} AS pc1, 0.0::DOUBLE AS pc2, 100.0::DOUBLE AS pct1, 0.0::DOUBLE AS pct2, sum(n)::BIGINT AS count
FROM places, spread GROUP BY ALL""",
    ),
    Query("pca_variance", lambda load: rounded(models.pca_variance(load("lineitem")), 5), PCA + f"\nSELECT component, {r('ratio', 5)} AS ratio, {r('cumulative', 5)} AS cumulative FROM shares"),
    Query("pca_moments", _pca_moments, SCALED),
    Query("dimensionality", lambda load: rounded(models.dimensionality(load("lineitem"))), PCA + "\n" + dimensions_sql(len(LINEITEM_NUMBERS))),
    Query("pca_feature_weights", lambda load: rounded(models.pca_feature_weights(load("lineitem")), 5), PCA_WEIGHTS),
    Query("pca_projection", lambda load: models.pca_projection(load("part"))),
    Query("forest_importance", lambda load: models.forest_importance(load("lineitem"), "l_extendedprice")),
    Query("forest_importance_caused", lambda load: rounded(models.forest_importance(_caused(load), "target")), CAUSED),
    Query(
        "class_distribution",
        lambda load: readiness.class_distribution(load("conversations"), "role"),
        "SELECT role AS value, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY role",
    ),
    Query("class_balance", lambda load: rounded(readiness.class_balance(load("conversations"), "role")), BALANCE),
    Query(
        "target_shape",
        lambda load: rounded(readiness.target_shape(load("customer"), "c_acctbal"), std=4),
        f"WITH {SHAPE.format(x='c_acctbal', table='customer')}\nSELECT {SHAPE_COLUMNS} FROM tested",
    ),
    Query(
        "target_quality",
        lambda load: rounded(readiness.target_quality(load("events"), "value")),
        f"SELECT {quality_sql('events', 'value')}",
    ),
    Query(
        "zscore_outlier_ratio",
        lambda load: rounded(stats.zscore_outlier_ratio(load("events"), "value")),
        f"SELECT {r(Z_RATIO.format(x='value', table='events'))} AS outlier_ratio",
    ),
    Query("classification_readiness", lambda load: rounded(readiness.classification_readiness(load("part"))), CLASSES),
    Query(
        "regression_readiness",
        lambda load: rounded(readiness.regression_readiness(_linked(load), "price"), max_correlation=5, std=4),
        REGRESSION,
    ),
    Query("predictive_readiness", lambda load: rounded(readiness.predictive_readiness(lineitem_with_nulls(load))), PREDICTIVE),
    Query("suggest_models", _suggested, SUGGESTED),
]
