import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from engrama.operators import batch_search, search
from engrama.plans import memory_graph as plans


def test_batch_equals_one_by_one(spark):
    rng, r = np.random.default_rng(1), random.Random(1)
    words = ["alpha", "beta", "gama", "delta", "épsilon"]
    n = [(i, " ".join(r.choice(words) for _ in range(4)), None, r.choice([None, "beta gama beta"]), datetime.datetime(2024, 1, r.randrange(1, 28)) if i % 3 else None) for i in range(60)]
    nodes = spark.createDataFrame(n, "id long, label string, tags string, summary string, last_commit_at timestamp")
    edges = spark.createDataFrame([(r.randrange(60), r.randrange(20)) for _ in range(200)], "source_id long, target_id long")
    vec = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(90, None), (91, [0.0] * 8), (92, [1.0]), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(vec, "node_id long, embedding array<float>")
    now = F.lit(datetime.datetime(2024, 2, 1))
    queries = [(k, p, [float(x) for x in rng.normal(size=8)]) for k, p in enumerate(["alpha", "beta gama", "Epsilon", "", "no such"])]
    got = batch_search.hybrid_search_batch(nodes, edges, vectors, queries, now, 5)
    for k, p, v in queries:
        one = search.hybrid_search(nodes, edges, vectors, p, v, now, top_k=5)
        want = [(x.node_id, round(x.score_final, 4)) for x in one.collect()]
        assert sorted(want) == sorted((x.node_id, round(x.score_final, 4)) for x in got.where(F.col("query_id") == k).collect()), p
    assert batch_search.hybrid_search_batch(nodes, edges, vectors, [], now).count() == 0


def test_query_set_has_every_fiftieth_usable_node(spark, monkeypatch):
    unit = [1.0] + [0.0] * 383
    vec = [(i, unit) for i in range(0, 50 * 130, 25)] + [(50 * 200, [0.0] * 384), (50 * 201, [1.0]), (50 * 202, None), (50 * 203, [None] + unit[1:]), (None, unit)]
    nodes = [(i, f"Alpha beta gama {i}", None) for i in range(0, 50 * 120, 50)]  # the last ten have no node
    monkeypatch.setattr(plans.B, "vectors", lambda s, d: s.createDataFrame(vec, "node_id long, embedding array<float>"))
    monkeypatch.setattr(plans.B, "nodes", lambda s, d: s.createDataFrame(nodes, "id long, label string, summary string"))
    got = {i: p for i, p, _ in plans.query_set(spark, "")}
    assert got == {i: "alpha beta" if i < 50 * 120 else "" for i in range(0, 50 * 130, 50)}


def test_blocks_and_steps_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vec = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.integers(-1, 2, size=(300, 4)))]  # many equal scores
    vectors = spark.createDataFrame(vec, "node_id long, embedding array<float>")
    queries = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(23)]
    cells = lambda: sorted(map(tuple, batch_search.vector_search_batch(vectors, iter(queries), 7).collect()))
    whole = cells()
    monkeypatch.setattr(batch_search, "BLOCK", 5)
    assert cells() == whole and len(whole) == 23 * 7
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vec if any(v)}
    for k, q in queries:
        s = {i: round(max(float(v @ q) / np.linalg.norm(q), 0.0) + 1e-12, 4) for i, v in unit.items()}
        assert [n for _, n, _ in sorted((x for x in whole if x[0] == k), key=lambda x: (-x[2], x[1]))] == sorted(s, key=lambda i: (-s[i], i))[:7]
