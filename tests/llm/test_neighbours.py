import datetime

import numpy as np

from engrama.llm import neighbours as N
from engrama.llm.vamana import Graph

T = datetime.datetime(2024, 1, 1)
SCHEMA = "doc_id string, embedding array<float>, node_id long, stored_at timestamp, similarity double"


def vectors(spark, data):
    return spark.createDataFrame([(f"node_{i}", None if v is None else [float(x) for x in v], i, at, 0.5) for i, v, at in data], SCHEMA)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 384))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 384)) * 1.1
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1)[:, :k]


def test_graph_recall():
    x = clustered(3000, 1)
    g = Graph(x)
    hit = 0
    for i in range(0, 3000, 500):
        q = np.arange(i, i + 500)
        at, s = g.search(x[q], q)
        s = np.where(at == q[:, None], -9, s)
        best = np.take_along_axis(at, np.argsort(-s, axis=1)[:, :10], 1)
        hit += sum(len(set(a) & set(b)) for a, b in zip(best, brute(x, 10)[q]))
    assert hit / 30000 > 0.95


def test_tiny_graphs():
    for n in (1, 2, 3):
        at, s = Graph(clustered(n, 2)).search(clustered(n, 2))
        assert ((at < n) == (s > -5)).all() and (at < n).sum(axis=1).min() == n


def test_recall_over_shards_and_hot_shards(spark, monkeypatch):
    x = clustered(2500, 3)
    x[:800] = (x[0] + 0.02 * np.random.default_rng(1).normal(size=(800, 384))).astype(np.float32)  # a dense third
    monkeypatch.setattr(N, "SHARD", 300)
    monkeypatch.setattr(N, "MAX_SHARD", 500)
    found = N.nearest(vectors(spark, [(i, v, T) for i, v in enumerate(x)]), 10).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = brute(unit, 10)
    got = found.groupby("node_id").neighbour_id.apply(set)
    assert (found.groupby("node_id").size() == 10).all() and len(got) == 2500
    assert sum(len(got[i] & set(truth[i])) for i in range(800, 2500)) / 17000 > 0.9
    near = unit[:800] @ unit[:800].T
    np.fill_diagonal(near, -2)
    tenth = np.sort(near, axis=1)[:, -10]
    assert np.mean([np.mean([near[i, j] >= tenth[i] - 1e-3 for j in got[i]]) for i in range(800)]) > 0.9


def test_shards_far_too_large_are_cut_into_parts_and_blocks(spark, monkeypatch):
    x = clustered(1200, 6)
    monkeypatch.setattr(N, "SHARD", 60)
    monkeypatch.setattr(N, "MAX_SHARD", 100)
    fitted = N.fit_centroids
    monkeypatch.setattr(N, "fit_centroids", lambda points, n, total: np.concatenate([fitted(points, 2, total), np.zeros((n - 2, 384), np.float32)]))
    found = N.nearest(vectors(spark, [(i, v, T) for i, v in enumerate(x)]), 10).toPandas()
    got = found.groupby("node_id").neighbour_id.apply(set)
    assert len(got) == 1200 and (found.groupby("node_id").size() == 10).all()
    truth = brute(x, 10)
    assert sum(len(got[i] & set(truth[i])) for i in range(1200)) / 12000 > 0.95


def test_recall_over_many_shards(spark, monkeypatch):
    x = clustered(5000, 8)
    monkeypatch.setattr(N, "SHARD", 32)
    monkeypatch.setattr(N, "MAX_SHARD", 96)
    found = N.nearest(vectors(spark, [(i, v, T) for i, v in enumerate(x)]), 10).where("node_id % 50 = 0").toPandas()
    got = found.groupby("node_id").neighbour_id.apply(set)
    truth = brute(x, 10)
    assert len(got) == 100 and sum(len(got[i] & set(truth[i])) for i in got.index) / 1000 > 0.95


def test_centroids_grow_with_the_collection(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE", 300)  # far fewer than all centroids need
    points = N.usable_points(vectors(spark, [(i, v, T) for i, v in enumerate(clustered(4000, 9))]))
    c = N.fit_centroids(points, 100, 4000)
    assert 80 <= len(c) <= 120 and len(np.unique(c, axis=0)) == len(c) and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-3)


def test_many_askers_of_one_shard_come_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    hub = rng.normal(size=384)
    own = hub + 0.1 * rng.normal(size=(80, 384))
    others = hub + rng.normal(size=(900, 384)) * 1.3
    x = np.concatenate([own, others]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(N, "SHARD", 80)
    monkeypatch.setattr(N, "BLOCK", 100)
    seen = {}
    monkeypatch.setattr(N, "_router", lambda c, pieces, enough, inner=N._router: seen.update(zip(("parts", "blocks"), pieces.value)) or inner(c, pieces, enough))
    got = N.nearest(vectors(spark, [(i, v, T) for i, v in enumerate(x)]), 5).toPandas()
    assert (got.groupby("node_id").size() == 5).all() and got.node_id.nunique() == 980
    assert seen["blocks"].max() > 1 and seen["blocks"].sum() >= 980 / 100


def test_operator_cases(spark):
    e = np.eye(384)
    later = T + datetime.timedelta(1)
    data = [(1, e[0], T), (2, e[0] * 5 + e[1], T), (3, None, T), (4, e[0] * 0, T), (5, [1.0, 2.0], T), (6, e[0], T), (6, None, later), (7, e[2], T), (7, e[0] * 3, later), (8, e[1], T), (None, e[0], T), (9, np.where(np.arange(384) == 0, np.nan, 1.0), T)]
    found = N.nearest(vectors(spark, data), 10)
    got = {}
    for r in found.collect():
        got.setdefault(r.node_id, {})[r.neighbour_id] = round(r.similarity, 4)
    assert set(got) == {1, 2, 7, 8} and set(got[1]) == {2, 7, 8} and got[1][7] == 1.0 and got[1][8] == 0.0
    pairs = {(r.node_id_a, r.node_id_b) for r in N.similar_pairs(found, 0.8).collect()}
    assert pairs == {(1, 2), (1, 7), (2, 7)}
    assert N.nearest(vectors(spark, []), 10).count() == 0
    assert N.nearest(vectors(spark, [(1, e[0], T)]), 10).count() == 0


def test_a_third_of_copies(spark):
    x = clustered(120, 4)
    data = [(i, v, T) for i, v in enumerate(x)] + [(1000 + i, x[0], T) for i in range(60)]
    found = N.nearest(vectors(spark, data), 10).toPandas()
    assert (found.groupby("node_id").size() == 10).all() and found.node_id.nunique() == 180
    of = found[found.node_id == 1059]
    assert sorted(of.neighbour_id) == [0, *range(1000, 1009)] and (of.similarity == 1).all()
    assert set(found[found.node_id == 1000].neighbour_id) == {0, *range(1001, 1010)}
