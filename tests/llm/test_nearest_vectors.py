import numpy as np
import pytest

from lexgrain.llm.nearest_vectors import CentroidGraph, balanced_centroids, nearest


@pytest.mark.parametrize("how", [{}, {"block": 40}, {"most_lists": 6, "list_size": 60}, {"most_lists": 6, "list_size": 60, "block": 30}])
def test_recall_against_brute_force(spark, how):
    """One level of lists, lists in blocks, two levels, and both."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.4 * rng.normal(size=(120, 16)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    got = nearest(df, "id", "embedding", k=5, dims=16, **({"list_size": 60} | how)).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :5]
    own = got.groupby("key").neighbour.apply(set)
    assert len(own) == len(x)
    assert np.mean([len(own[i] & set(best[i])) / 5 for i in range(len(x))]) >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [0.0, 0.0]), ("f", [nan, 1.0]), ("g", [inf, 1.0]), ("h", [1.0]), ("i", [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(data, "id string, embedding array<float>")
    got = {(r["key"], r["neighbour"], round(r["cosine"], 6), r["position"]) for r in nearest(df, "id", "embedding", k=2, dims=2).collect()}
    assert got == {("a", "b", 1.0, 1), ("a", "c", 0.0, 2), ("b", "a", 1.0, 1), ("b", "c", 0.0, 2), ("c", "a", 0.0, 1), ("c", "b", 0.0, 2)}
    assert nearest(df.limit(0), "id", "embedding", dims=2).count() == 0


def test_copies(spark):
    """Half of all rows are one vector: every copy has k others, the first by key."""
    data = [(f"k{i:03d}", [1.0, 0.0]) for i in range(50)] + [(f"z{i:03d}", [float(np.cos(i / 10)), float(np.sin(i / 10))]) for i in range(1, 50)]
    got = nearest(spark.createDataFrame(data, "id string, embedding array<float>"), "id", "embedding", k=3, dims=2).toPandas()
    assert (got.groupby("key").size() == 3).all() and got.key.nunique() == 99
    assert got[got.key == "k000"].sort_values("position").neighbour.tolist() == ["k001", "k002", "k003"]
    assert got[got.key == "k030"].sort_values("position").neighbour.tolist() == ["k000", "k001", "k002"]


def test_balanced_lists():
    x = np.random.default_rng(1).normal(size=(1000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = balanced_centroids(x, 20)
    ids, sims = CentroidGraph(c).search(x, beam=4)
    exact = np.argmax(x @ c.T, axis=1)
    assert np.mean(ids[:, 0] == exact) > 0.95


def test_one_list_of_many(spark):
    """All rows in one list, cut in blocks: every row still meets every other."""
    x = np.random.default_rng(8).normal(size=(3000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    got = nearest(df, "id", "embedding", k=3, dims=8, list_size=10**6, most_lists=1, block=500).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :3]
    own = got.groupby("key").neighbour.apply(set)
    assert np.mean([own[i] == set(best[i]) for i in range(len(x))]) > 0.999
