"""Communities of many super-nodes: the pairs are made last, and equal a plain search from each super-node."""

import random

from engrama import staging
from engrama.operators import communities as C
from engrama.operators import graph, maintenance

NODES = "id long, project_uuid string, label string, summary string, node_type string, type string, tags string, status string"
EDGES = "source_id long, target_id long"


def made(spark, ids, links, tags=lambda i: None, project=lambda i: "p", status=lambda i: "ACTIVE"):
    n = spark.createDataFrame([(i, project(i), f"n{i}", None, "MODULE", "file", tags(i), status(i)) for i in ids], NODES)
    return n, spark.createDataFrame(list(links), EDGES)


def odd_graph(spark):
    """Two projects, nodes without one, archived ones, hubs of more than 64 links, a chain longer than the hops, more super-nodes than a block."""
    draw = random.Random(5)
    project = lambda i: None if i % 97 == 0 else "pq"[i % 7 == 0]
    status = lambda i: "ARCHIVED" if i % 31 == 0 else "ACTIVE"
    links = {(draw.randrange(400), draw.randrange(200)) for _ in range(2600)} | {(i, 5) for i in range(300)}
    links |= {(i, i + 1) for i in range(400, 420)} | {(7, 400), (420, 420), (90_000, 1)} | {(i, 97) for i in range(12)}
    n, e = made(spark, range(421), links, project=project, status=status)
    live = {i: project(i) for i in range(421) if status(i) == "ACTIVE"}
    near = {i: set() for i in live}
    for a, b in links:
        if live.get(a) is not None and live.get(a) == live.get(b) and a != b:
            near[a].add(b)
            near[b].add(a)
    found = {}
    for start in live:
        if sum(b == start for _, b in links) >= 10:
            seen = {start}
            for _ in range(5):
                seen |= {t for i in seen for t in near[i]}
            found[start] = seen
    assert len(found) > 128
    return n, e, found


def test_communities_equal_a_search_from_each_super_node(spark, monkeypatch):
    n, e, found = odd_graph(spark)
    want = sorted((a, m) for a, seen in found.items() for m in seen)
    got = lambda: sorted(map(tuple, graph.communities(n, e).collect()))
    assert got() == want
    monkeypatch.setattr(C, "BLOCK", 64)
    assert got() == want
    monkeypatch.setattr(C, "MAX_LINKS", 100)  # some projects are walked by joins
    assert got() == want


def test_no_staged_table_holds_the_pairs(spark):
    n, e = made(spark, range(70), [(a, b) for a in range(10) for b in range(10, 70)])
    first = len(staging._staged)
    assert graph.communities(n, e).count() == 60 * 70
    assert max(spark.read.parquet(path).count() for _, path in staging._staged[first:]) <= 600


def test_greatest_communities_are_found_without_the_pairs(spark):
    n, e, found = odd_graph(spark)
    want = {m: max(a for a, seen in found.items() if m in seen) for m in set().union(*found.values())}
    first = len(staging._staged)
    got = graph.greatest_communities(n, e).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    assert max(spark.read.parquet(path).count() for _, path in staging._staged[first:]) <= 2 * e.count()


def test_label_summaries_equal_those_of_all_pairs(spark, monkeypatch):
    n, e, found = odd_graph(spark)
    n = n.selectExpr("id", "project_uuid", "nullif(label, 'n3') as label", "summary", "node_type", "type", "case id % 5 when 0 then null when 1 then '[\"é\",\"a\",null]' when 2 then 'no json' else concat('[\"t', id % 11, '\",\"a\"]') end as tags", "status")
    want = sorted(map(tuple, maintenance.community_summaries(n, graph.communities(n, e)).collect()))
    assert len(want) == len(found) and any(len(tags) > 5 for *_, tags in want)
    first = len(staging._staged)
    assert sorted(map(tuple, maintenance.label_summaries(n, e).collect())) == want
    assert max(spark.read.parquet(path).count() for _, path in staging._staged[first:]) <= e.count()
    monkeypatch.setattr(C, "MAX_LINKS", 100)
    assert sorted(map(tuple, maintenance.label_summaries(n, e).collect())) == want


def test_maintenance_without_a_function_stores_no_pairs(spark, monkeypatch):
    n, e = made(spark, range(70), [(a, b) for a in range(10) for b in range(10, 70)])
    n = n.selectExpr("*", "cast(null as string) content", "cast(null as timestamp) last_accessed")
    v = spark.createDataFrame([("node_3", 3), ("node_69", 69)], "doc_id string, node_id long")
    first = len(staging._staged)
    out, report = maintenance.run_maintenance({"nodes": n, "edges": e.selectExpr("*", "'calls' relation_type", "1.0D weight"), "vectors": v}, staging.F.current_timestamp(), embedder=None)
    assert report.first().communities == 60 and {r.metadata["community_id"] for r in out["vectors"].collect()} == {"69"}
    assert max(spark.read.parquet(path).count() for _, path in staging._staged[first:]) <= 1200
