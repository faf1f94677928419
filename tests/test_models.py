import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array

from plumbline.operators import clusters, forest, geo, models


@pytest.fixture(scope="module")
def blobs(spark):
    generator = np.random.default_rng(4)
    centers = np.array([[0, 0, 5], [9, 9, 0], [0, 9, 9], [9, 0, -5]])
    points = np.concatenate([c + generator.normal(scale=0.3, size=(60, 3)) for c in centers])
    pdf = pd.DataFrame(points, columns=["a", "b", "c"])
    pdf["d"] = pdf["a"] * 2 + pdf["b"] + generator.normal(size=len(pdf))
    return pdf, spark.createDataFrame(pdf)


def test_mean_of_integers_is_not_cut(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, None)], "i int, empty double")
    found = [r["i"] for r in models.impute_mean(df).collect()]
    assert sorted(found) == [1.0, 1.5, 2.0]


def test_standard_scores(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0), (8.0, 7.0)], "x double, k double")
    x = pd.Series([1.0, 3.0, 4.0, 8.0])
    wanted = ((x - x.mean()) / x.std(ddof=0)).tolist()
    rows = models.standardize(df).collect()
    assert [r["x"] for r in rows] == pytest.approx(wanted)
    assert [r["k"] for r in rows] == [0.0] * 4
    vectors = models.feature_matrix(df).select(vector_to_array("features").alias("f")).collect()
    assert [r["f"][0] for r in vectors] == pytest.approx(wanted)


@pytest.mark.parametrize("costs, late, centre", [
    ([10.0], 2, 2), ([10.0, 8.0], 2, 2), ([10.0, 4.0, 3.0], 4, 3), ([20.0, 18.0, 6.0, 5.0], 5, 4),
])
def test_elbow_rules(costs, late, centre):
    assert models.elbow(costs) == late and models.elbow(costs, "centre") == centre


def test_clusters(blobs):
    pdf, df = blobs
    features = models.Features(df)
    found = models.cluster(features, "centre")
    costs = [found.costs[k] for k in sorted(found.costs)]
    assert list(found.costs) == list(range(2, 11))
    assert all(b <= a * 1.1 for a, b in zip(costs, costs[1:]))
    profile = models.cluster_profile(features, found)
    sizes = profile.select("cluster", "size").distinct().agg({"size": "sum"}).first()[0]
    assert sizes == len(pdf) and profile.count() == found.best * 4
    elbow = models.kmeans_elbow(features, found)
    assert elbow.where("is_chosen").first()["k"] == found.best
    projected = models.pca_projection(features, found)
    assert projected.count() == len(pdf) + found.best
    features.release()


def test_passes_over_packed_rows(spark, monkeypatch):
    rng = np.random.default_rng(19)
    x = rng.normal(size=(500, 3))
    x[100:200] = x[:100]
    packed = clusters.packed(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))).persist()
    assert packed.count() < 500
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 64)
    # Of equal centres the first counts.
    sets = [x[:4], np.vstack([x[:2], x[:2]]), np.zeros((2, 3))]
    for centres, (count, total, cost) in zip(sets, clusters._sums(packed, sets)):
        away = ((x[:, None] - centres[None]) ** 2).sum(2)
        nearest = away.argmin(1)
        assert count.tolist() == np.bincount(nearest, minlength=len(centres)).tolist()
        assert total == pytest.approx(np.stack([x[nearest == i].sum(0) for i in range(len(centres))]))
        assert cost == pytest.approx(away.min(1).sum())
    seeds = np.vstack([x[:9], x[:9] + 1e-9])
    found = clusters._away(x.T, seeds)
    assert found == pytest.approx(clusters._distances(x, seeds).min(1), rel=1e-5, abs=1e-20) and (found[:9] == 0).all()
    packed.unpersist()


def test_components_against_eigenvalues(blobs):
    pdf, df = blobs
    features = models.Features(df)
    model = models.components(features)
    values, vectors = np.linalg.eigh(pdf.corr().to_numpy())
    values, vectors = values[::-1], vectors[:, ::-1]
    ratios = [r["ratio"] for r in models.pca_variance(features, model).orderBy("component").collect()]
    assert ratios == pytest.approx((values / 4).tolist()) and sum(ratios) == pytest.approx(1)
    weights = {r["column"]: r["weight"] for r in models.pca_feature_weights(features, model).collect()}
    wanted = np.abs(vectors[:, :3]).mean(axis=1)
    assert [weights[c] for c in pdf] == pytest.approx(wanted.tolist())
    summary = models.dimensionality(features, model).first()
    needed = int(np.argmax(np.cumsum(values / 4) >= 0.95)) + 1
    assert (summary["total_features"], summary["components_95"]) == (4, needed)
    assert summary["reduction_ratio"] == needed / 4
    features.release()


def test_forest_finds_the_cause(blobs):
    _, df = blobs
    found = models.forest_importance(df, "d", trees=10).collect()
    assert {r["column"] for r in found} == {"a", "b", "c"}
    assert sum(r["importance"] for r in found) == pytest.approx(1)


def test_forest_with_target_as_feature(spark):
    pdf = pd.DataFrame(np.random.default_rng(6).normal(size=(300, 2)), columns=["a", "b"])
    pdf["d"] = pdf["a"] * 2 + pdf["b"]
    found = models.forest_importance(spark.createDataFrame(pdf), "d", include_target=True, trees=10)
    assert found.first()["column"] == "d" and found.count() == 3


def test_forest_grows_below_the_fifth_level(spark):
    bits = pd.DataFrame([[n >> b & 1 for b in range(7)] for n in range(128)] * 4, columns=list("abcdefg"))
    bits["y"] = sum(bits[c] * 2.0**-i for i, c in enumerate("abcdefg"))
    found = models.forest_importance(spark.createDataFrame(bits), "y", trees=5).collect()
    assert {r["column"] for r in found if r["importance"] > 0} == set("abcdefg")


def plain_gains(x, y, w):
    """What each column brings to a tree that is grown node by node."""
    gains = np.zeros(len(x))

    def grow(rows):
        if len(rows) < 2 or y[rows].min() == y[rows].max():
            return
        weight, total, best = w[rows].sum(), (w * y)[rows].sum(), None
        for c in range(len(x)):
            o = rows[np.argsort(x[c][rows], kind="stable")]
            lw, ls = np.cumsum(w[o]), np.cumsum((w * y)[o])
            for i in np.flatnonzero(x[c][o][:-1] != x[c][o][1:]):
                gain = ls[i] ** 2 / lw[i] + (total - ls[i]) ** 2 / (weight - lw[i]) - total**2 / weight
                if best is None or gain > best[0] + 1e-9:
                    best = gain, c, o[: i + 1], o[i + 1:]
        if best is not None:
            gains[best[1]] += best[0]
            grow(best[2])
            grow(best[3])

    grow(np.arange(len(y)))
    return gains


@pytest.mark.parametrize("n", [1, 2, 7, 60, 400])
def test_trees_against_plain_ones(n):
    rng = np.random.default_rng(n)
    x = np.stack([rng.integers(0, 7, n).astype(float), rng.normal(size=n), rng.normal(size=n).round(1), np.ones(n)])
    y = x[1] * 2 + x[0] + rng.normal(size=n).round(1)
    w = rng.integers(1, 4, n).astype(float)
    y -= np.average(y, weights=w)
    assert forest.grown(x, y, w) == pytest.approx(plain_gains(x, y, w))


def test_draws_are_those_of_spark(spark):
    found = spark.range(3000).crossJoin(spark.range(3).selectExpr("int(id) AS tree")).selectExpr(
        "tree", "id", "xxhash64(7, tree) AS start", "pmod(xxhash64(7, tree, id), bigint(9007199254740992)) AS u").orderBy("tree", "id").toPandas()
    for tree, rows in found.groupby("tree"):
        w = forest._weights(int(rows["start"].iloc[0]), forest._rows_hashed(rows["id"].to_numpy()))
        assert w.tolist() == (rows["u"].to_numpy()[:, None] >= forest.DRAWS.astype(np.int64)).sum(axis=1).tolist()
        assert 0.9 < w.mean() < 1.1


def test_rows_with_equal_columns_are_one_row_of_a_tree():
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 4, (2, 5000)).astype(float), rng.normal(size=5000)
    merged, draws = forest._draws(x, y, np.arange(5000), [11, 12])
    for d, tree_hash in zip(draws, (11, 12)):
        w = forest._weights(tree_hash, forest._rows_hashed(np.arange(5000))).astype(float)
        assert len(d.at) == 16 and d.w.sum() == w.sum()
        seen = w > 0
        whole = forest.grown(x[:, seen], y[seen], w[seen])
        assert forest.grown(merged[:, d.at], d.y, d.w.astype(float), d.low, d.high) == pytest.approx(whole)


def test_blocks_of_nodes_grow_as_one(monkeypatch):
    rng = np.random.default_rng(10)
    x, w = rng.normal(size=(3, 3000)).round(2), rng.integers(1, 4, 3000).astype(float)
    y = x[0] * 2 + rng.normal(size=3000)
    whole = forest.grown(x, y, w)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 100)
    assert forest.grown(x, y, w) == pytest.approx(whole)


def test_columns_of_few_values_are_added_up_by_value(monkeypatch):
    rng = np.random.default_rng(12)
    x = np.stack([rng.integers(0, 3, 600).astype(float), rng.normal(size=600), rng.integers(0, 9, 600) * 0.5, rng.normal(size=600).round(1)])
    y, w = x[0] + x[2] * x[1] + rng.normal(size=600).round(1) + 5, rng.integers(1, 4, 600).astype(float)
    seen, level = set(), forest._level

    def watched(nodes, *rest):
        seen.add(sum(order is None for order in nodes.orders))
        return level(nodes, *rest)

    monkeypatch.setattr(forest, "_level", watched)
    monkeypatch.setattr(forest, "FLOORS", (300, 40, 12))
    for size in (60, 10_000):
        monkeypatch.setattr(forest, "BLOCK_ROWS", size)
        assert forest.grown(x, y, w) == pytest.approx(plain_gains(x, y - np.average(y, weights=w), w))
    # While nodes are large no column is sorted but the one by which rows stand, at the end all are.
    assert seen == {4, 3, 2, 1}
    few = x[[0, 2]]
    assert forest.grown(few, y, w) == pytest.approx(plain_gains(few, y - np.average(y, weights=w), w))


def test_rows_stay_where_they_are_while_nodes_are_split(monkeypatch):
    rng = np.random.default_rng(13)
    x, w = np.stack([rng.normal(size=900), rng.integers(0, 5, 900).astype(float), rng.normal(size=900)]), rng.integers(1, 4, 900).astype(float)
    y, level, seen = x[0] + x[1] * x[2], forest._level, []

    def watched(nodes, gains, least):
        large, small = level(nodes, gains, least)
        seen.append((large.x is nodes.x, len(small.sums) == small.sizes.sum()))
        return large, small

    monkeypatch.setattr(forest, "_level", watched)
    monkeypatch.setattr(forest, "FLOORS", (200, 30))
    assert forest.grown(x, y, w) == pytest.approx(plain_gains(x, y - np.average(y, weights=w), w))
    assert all(stay and packed for stay, packed in seen)


def test_nodes_of_one_target_are_leaves():
    rng = np.random.default_rng(14)
    x, w = rng.normal(size=(3, 500)), rng.integers(1, 9, 500).astype(float)
    # A third of a step of the target is no number of bits: sums of equal targets come near to nothing only.
    y = np.where(x[0] > 0.2, 1 / 3, np.where(x[1] > 0, -1e6 / 3, 1e-3 / 3))
    assert forest.grown(x, y, w) == pytest.approx(plain_gains(x, y - np.average(y, weights=w), w))
    assert forest.grown(x, y, w)[2] == 0
    assert forest.grown(x, np.full(500, 1e9 / 3), w).tolist() == [0, 0, 0]


def test_large_nodes_are_split_from_sums_by_value(monkeypatch):
    rng = np.random.default_rng(15)
    x = np.stack([rng.normal(size=700), rng.integers(0, 40, 700) * 0.5, rng.integers(0, 3, 700).astype(float), rng.normal(size=700).round(1)])
    w, level, seen = rng.integers(1, 4, 700).astype(float), forest._level, []

    def watched(nodes, *rest):
        seen.append(nodes.sizes.max())
        return level(nodes, *rest)

    monkeypatch.setattr(forest, "_level", watched)
    monkeypatch.setattr(forest, "FLOORS", (8,))
    monkeypatch.setattr(forest, "LARGE_ROWS", 30)
    # Cuts in the middle, cuts that take off the ends, few targets and one.
    for y in (x[0] + x[2] * x[1], np.exp(x[0]) + rng.normal(size=700), np.where(x[3] > 0.5, 1 / 3, x[2] * 1e5 / 3), np.full(700, 1 / 3)):
        for size in (50, 10_000):
            monkeypatch.setattr(forest, "BLOCK_ROWS", size)
            assert forest.grown(x, y, w) == pytest.approx(plain_gains(x, y - np.average(y, weights=w), w), rel=1e-6, abs=1e-6)
    # Their rows are not gone through for every cut that takes a few of them off.
    assert max(seen) <= 30


def test_large_nodes_of_rows_that_stand_for_several(monkeypatch):
    rng = np.random.default_rng(16)
    x, y = rng.integers(0, 12, (2, 5000)).astype(float), rng.normal(size=5000)
    merged, draws = forest._draws(x, y, np.arange(5000), [11])
    d = next(draws)
    whole = forest.grown(merged[:, d.at], d.y, d.w.astype(float), d.low, d.high)
    monkeypatch.setattr(forest, "LARGE_ROWS", 10)
    assert forest.grown(merged[:, d.at], d.y, d.w.astype(float), d.low, d.high) == pytest.approx(whole)


def test_nodes_split_by_spark_as_by_a_task(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({c: rng.integers(0, k, 3000).astype(float) for c, k in (("a", 9), ("b", 5), ("c", 3))})
    pdf["hot"] = (rng.random(3000) < 0.01).astype(float)
    pdf["y"] = pdf.a * pdf.b + 20 * pdf.hot + rng.normal(size=3000)
    df = spark.createDataFrame(pdf)
    whole = {r["column"]: r["importance"] for r in models.forest_importance(df, "y", trees=4).collect()}
    monkeypatch.setattr(forest, "TASK_ROWS", 150)
    split = {r["column"]: r["importance"] for r in models.forest_importance(df, "y", trees=4).collect()}
    assert split == pytest.approx(whole, rel=1e-6) and sum(split.values()) == pytest.approx(1)


def test_rows_are_dealt_as_coded_columns():
    rng = np.random.default_rng(20)
    x = np.stack([
        rng.integers(0, 7, 900) * 0.1, rng.permutation(900) - 450.0, rng.normal(size=900), rng.permutation(900) * 2.0**31, np.full(900, -3.5)])
    coded = [forest._coded(v) for v in x]
    assert [codes.itemsize for codes, _ in coded] == [1, 4, 8, 8, 1]
    for rows in (np.arange(900), np.array([5, 5, 899]), np.arange(0)):
        assert np.array_equal(forest._columns_read(pa.py_buffer(forest._written(coded, rows)), 5, len(rows)), x[:, rows])


def test_chunks_without_rows_of_large_nodes(spark, monkeypatch):
    rng = np.random.default_rng(17)
    pdf = pd.DataFrame(rng.normal(size=(3000, 2)), columns=["a", "b"])
    # Chunks are ranges of the first column, and so are the large nodes.
    pdf["y"] = np.exp(2 * pdf.a) + rng.normal(size=3000)
    df = spark.createDataFrame(pdf)
    whole = {r["column"]: r["importance"] for r in models.forest_importance(df, "y", trees=4).collect()}
    monkeypatch.setattr(forest, "TASK_ROWS", 800)
    split = {r["column"]: r["importance"] for r in models.forest_importance(df, "y", trees=4).collect()}
    # Of large nodes not every cut is tried.
    assert split == pytest.approx(whole, abs=0.02) and sum(split.values()) == pytest.approx(1)


def test_no_large_nodes_are_looked_for_among_few_different_rows(spark, monkeypatch):
    rng = np.random.default_rng(18)
    pdf = pd.DataFrame(rng.normal(size=(700, 2)), columns=["a", "b"]).sample(3000, replace=True, random_state=1)
    pdf["y"] = pdf.a + rng.normal(size=3000)
    df = spark.createDataFrame(pdf)
    whole = {r["column"]: r["importance"] for r in models.forest_importance(df, "y", trees=2).collect()}
    monkeypatch.setattr(forest, "TASK_ROWS", 1000)
    monkeypatch.setattr(forest, "_edges", None)
    assert {r["column"]: r["importance"] for r in models.forest_importance(df, "y", trees=2).collect()} == pytest.approx(whole)


def test_forest_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1.0, 2.0, None)] * 5, "a double, b double, c double")
    assert [tuple(r) for r in models.forest_importance(df, "b", trees=3).collect()] == [("a", 0.0)]
    assert models.forest_importance(df.select("b"), "b").collect() == []
    assert models.forest_importance(df.limit(0)).collect() == []


def test_too_few_columns(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    with pytest.raises(ValueError):
        models.cluster(df)
    with pytest.raises(ValueError):
        models.components(df)


def test_coordinates_need_both(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 9.0), (5.0, None), (3.0, 6.0)], "latitude double, longitude double")
    found = geo.coordinate_stats(df).first()
    assert (found["center_latitude"], found["north"], found["east"], found["west"]) == (2.0, 3.0, 6.0, 2.0)
    grid = geo.density_grid(df, cells=2).collect()
    assert sorted((r["row"], r["col"], r["n"]) for r in grid) == [(0, 0, 1), (1, 1, 1)]


def test_region_of_one_row_has_no_deviation(spark):
    df = spark.createDataFrame([("n", 1.0), ("s", 2.0), ("s", 4.0), (None, 9.0)], "region string, v double")
    found = {r["location"]: r for r in geo.regional_stats(df).collect()}
    assert set(found) == {"n", "s"}
    assert found["n"]["std"] is None and found["s"]["std"] == pytest.approx(2 ** 0.5)
    assert found["s"]["rank"] == 1
