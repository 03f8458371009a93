"""Clusters and components of vectors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, embedding


def unit(x):
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-8)


def lloyd(x, c, rounds=50):
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        c = np.stack([unit(x[at == j].mean(0)) if (at == j).any() else c[j] for j in range(len(c))])
    return c


def cost(x, c):
    return float((1 - (x @ c.T).max(1)).sum())


def blobs(seed, n=240, d=12, k=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(k, d)) * 3
    return (middle[rng.integers(0, k, n)] + rng.normal(size=(n, d)) * 0.6).astype(float)


def test_spherical_clusters_of_blobs_cost_as_little_as_numpy(spark):
    data = {name: blobs(i) for i, name in enumerate("ab")}
    rows = [(name, i, v.tolist()) for name, x in data.items() for i, v in enumerate(x)] + [("a", -1, None)]
    patches = spark.createDataFrame(rows, "uuid string, i int, vec array<double>")
    labels, fractions = clusters.cluster_blobs(patches, 5)
    got = labels.toPandas()
    assert got["cluster"].isna().sum() == 1
    for name, x in data.items():
        x = unit(x)
        mine = got[(got["uuid"] == name) & (got["i"] >= 0)].sort_values("i")["cluster"].to_numpy(int)
        centres = np.stack([unit(x[mine == j].mean(0)) for j in range(5)])
        best = min(cost(x, lloyd(x, x[np.random.default_rng(s).choice(len(x), 5, replace=False)])) for s in range(10))
        assert cost(x, centres) <= 1.01 * best
        told = {r["cluster"]: r for r in fractions.where(F.col("uuid") == name).collect()}
        assert set(told) == set(range(5)) and all(told[j]["n"] == (mine == j).sum() for j in range(5))
        assert abs(sum(r["fraction"] for r in told.values()) - 1) < 1e-9


def test_an_empty_cluster_gets_the_farthest_vector(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.05], [1.0, -0.05], [0.0, 1.0]])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    start = spark.createDataFrame([([[1.0, 0.0], [-1.0, 0.0]],)], f"centres {clusters.CENTRES}")
    centres = np.array(clusters.spherical_kmeans(df, "v", 2, start=start).first()["centres"])
    assert np.allclose(sorted(centres.tolist()), sorted([[1.0, 0.0], [0.0, 1.0]]), atol=1e-3)
    few = clusters.spherical_kmeans(df.limit(1), "v", 3).first()["centres"]
    assert 1 <= len(few) <= 3


@pytest.mark.parametrize("normalise", [False, True])
def test_components_of_wide_vectors_equal_numpy(spark, normalise):
    rng = np.random.default_rng(5)
    n, d, k = 300, 4096, 4
    x = (rng.normal(size=(n, 12)) * np.array([40, 25, 16, 10, 6, 4, 3, 2, 1.5, 1, 1, 1])) @ rng.normal(size=(12, d)) / 30 + rng.normal(size=(n, d)) * 0.02 + 1
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3)
    mean, parts = embedding.fit_pca(df, "v", k, normalise=normalise)
    y = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-6) if normalise else x
    _, _, basis = np.linalg.svd(y - y.mean(0), full_matrices=False)
    assert np.allclose(mean, y.mean(0), atol=1e-9)
    for a, b in zip(parts, basis[:k], strict=True):
        assert abs(abs(a @ b) - 1) < 1e-8 and a[np.abs(a).argmax()] > 0


def test_narrow_and_wide_ways_agree(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 20)) * np.linspace(5, 1, 20)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    narrow = embedding.fit_pca(df, "v", 3, normalise=False)
    wide = embedding.fit_pca(df, "v", 3, normalise=False, wide_from=10)
    assert np.allclose(narrow[0], wide[0]) and np.allclose(narrow[1], wide[1], atol=1e-6)


def test_the_queries_of_components_and_clusters_equal_numpy(spark, data):
    from tessera.plans.queries import kmeans_fit, pca_fit

    x = np.array([r["embedding"] for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()], float)
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-6)
    _, _, basis = np.linalg.svd(u - u.mean(0), full_matrices=False)
    got = np.array([r["pc"] for r in pca_fit(spark, data).orderBy("vec_id").collect()])
    assert np.allclose(np.abs(got), np.abs((u - u.mean(0)) @ basis[:3].T), atol=1e-6)
    labels = kmeans_fit(spark, data).orderBy("vec_id").toPandas()["cluster"].to_numpy()
    error = lambda at: sum(((x[at == j] - x[at == j].mean(0)) ** 2).sum() for j in range(6) if (at == j).any())
    tries = []
    for s in range(10):
        c = x[np.random.default_rng(s).choice(len(x), 6, replace=False)]
        for _ in range(50):
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.stack([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(6)])
        tries.append(error(at))
    assert error(labels) <= 1.02 * min(tries)
