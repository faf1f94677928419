"""Catalogue: places."""

from __future__ import annotations

from plumbline.catalog.base import PLACES, Query, places, r, rounded, union
from plumbline.operators import geo

METRICS = ["c_acctbal", "c_custkey", "latitude"]

REGIONAL = f"WITH {PLACES}\nSELECT * FROM (" + union(METRICS, lambda i, m: (
    f"SELECT '{m}' AS metric, country AS location, {r(f'avg({m})', 4)} AS mean, {r(f'stddev_samp({m})', 4)} AS std, "
    f"{r(f'min({m})', 4)} AS min, {r(f'max({m})', 4)} AS max, count({m}) AS n, "
    f"row_number() OVER (ORDER BY count({m}) DESC, country) AS rank FROM places WHERE country IS NOT NULL GROUP BY country"
)) + ") WHERE rank <= 10"

LOCATIONS = f"WITH {PLACES}\nSELECT * FROM (" + union(["region", "country"], lambda i, c: (
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank, "
    f"(SELECT count(DISTINCT {c}) FROM places) AS n_locations, "
    f"{r(f'(SELECT sum(k) FROM (SELECT count(*) AS k FROM places WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k DESC LIMIT 5)) / (SELECT count(*) FROM places)')} "
    f"AS concentration FROM places WHERE {c} IS NOT NULL GROUP BY {c}"
)) + ") WHERE rank <= 10"

COORDINATES = f"""WITH {PLACES}
SELECT {r('avg(latitude)', 5)} AS center_latitude, {r('avg(longitude)', 5)} AS center_longitude,
  {r('stddev_samp(latitude)', 5)} AS latitude_std, {r('stddev_samp(longitude)', 5)} AS longitude_std,
  {r('max(latitude)', 5)} AS north, {r('min(latitude)', 5)} AS south, {r('max(longitude)', 5)} AS east, {r('min(longitude)', 5)} AS west
FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""

GRID = f"""WITH {PLACES},
p AS (SELECT latitude AS lat, longitude AS lon FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
e AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM p),
c AS (SELECT least(CAST(floor((lat - s) / ((n - s) / 20)) AS BIGINT), 19) AS row,
             least(CAST(floor((lon - w) / ((e - w) / 20)) AS BIGINT), 19) AS col, s, w, n, e FROM p, e)
SELECT row, col, {r('any_value(s) + row * (any_value(n) - any_value(s)) / 20', 5)} AS south,
  {r('any_value(w) + col * (any_value(e) - any_value(w)) / 20', 5)} AS west, count(*) AS n FROM c GROUP BY row, col"""

CONTOURS = f"""WITH {PLACES},
p AS (SELECT latitude AS lat, longitude AS lon FROM places WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
e AS (
  SELECT n, wy, wx, s - 3 * wy AS s, w - 3 * wx AS w, (t - s + 6 * wy) / 50 AS h, (e - w + 6 * wx) / 50 AS b FROM (
    SELECT count(*) AS n, stddev_samp(lat) * pow(count(*), -1 / 6.0) AS wy, stddev_samp(lon) * pow(count(*), -1 / 6.0) AS wx,
      min(lat) AS s, max(lat) AS t, min(lon) AS w, max(lon) AS e FROM p)),
counts AS (SELECT floor((lat - s) / h) AS i, floor((lon - w) / b) AS j, count(*) AS m FROM p, e GROUP BY 1, 2),
cells AS (SELECT r.generate_series AS row, c.generate_series AS col FROM generate_series(0, 49) AS r, generate_series(0, 49) AS c),
smooth AS (
  SELECT row, col, sum(m * exp(-pow((row - i) * h / wy, 2) / 2 - pow((col - j) * b / wx, 2) / 2)) / any_value(2 * pi() * wx * wy * n) AS density
  FROM cells, counts, e GROUP BY row, col),
ranked AS (
  SELECT *, sum(density) OVER (ORDER BY density DESC, row, col ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(density) OVER () AS inside FROM smooth),
heights AS (
  SELECT max(density) FILTER (inside >= 1 - share) AS limit_ FROM ranked, (SELECT 0.05 + 0.95 * unnest(range(5)) / 4 AS share) GROUP BY share)
SELECT row, col, {r('s + (row + 0.5) * h', 5)} AS lat, {r('w + (col + 0.5) * b', 5)} AS lon, {r('density', 9)} AS density,
  (SELECT count(*) FROM heights WHERE density >= limit_) AS level FROM ranked, e"""

QUERIES = [
    Query("regional_stats", lambda load: rounded(geo.regional_stats(places(load), "country", METRICS), 4), REGIONAL),
    Query("location_stats", lambda load: rounded(geo.location_stats(places(load))), LOCATIONS),
    Query("coordinate_stats", lambda load: rounded(geo.coordinate_stats(places(load)), 5), COORDINATES),
    Query(
        "spatial_points",
        lambda load: rounded(geo.spatial_points(places(load))),
        f"WITH {PLACES} SELECT {r('latitude')} AS lat, {r('longitude')} AS lon FROM places "
        "WHERE latitude IS NOT NULL AND longitude IS NOT NULL",
    ),
    Query("density_grid", lambda load: rounded(geo.density_grid(places(load)), 5), GRID),
    Query("density_contours", lambda load: rounded(geo.density_contours(places(load)), 5, density=9), CONTOURS),
]
