from datetime import datetime as D

import pytest
from helpers import rows

from pyspark.sql import functions as F

from engrama.operators import audit, delta, embed, facade, graph, maintenance, search, summarise
from engrama.operators import relational as R
from engrama.schemas import SCHEMAS, conform, split_valid
from engrama.sources import access as A
from engrama.sources import backend
from engrama.sources import snapshots as S

NOW = F.lit(D(2024, 6, 1))
NODE = "id long, project_uuid string, label string, summary string, tags string, node_type string, type string, status string, last_commit_at timestamp, last_accessed timestamp, content string, file_hash string"


def nodes(spark, *ids, **more):
    base = {"project_uuid": "p", "label": None, "summary": None, "tags": None, "node_type": "MODULE", "type": "file", "status": "ACTIVE", "last_commit_at": None, "last_accessed": None, "content": None, "file_hash": None}
    data = []
    for i in ids:
        row = {"id": i, **base, "label": f"n{i}", **(i if isinstance(i, dict) else {}), **more}
        if isinstance(i, dict):
            row["label"] = i.get("label", f"n{i['id']}")
        data.append(tuple(row[c.split()[0]] for c in NODE.split(", ")))
    return spark.createDataFrame(data, NODE)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, r, 1.0) for a, b, *rest in pairs for r in [rest[0] if rest else "calls"]], "source_id long, target_id long, relation_type string, weight double")


def test_centrality_and_super_nodes_at_the_threshold(spark):
    e = edges(spark, [(i, 100) for i in range(10)] + [(i, 200) for i in range(9)])
    n = nodes(spark, *range(10), 100, 200)
    c = {r.id: (r.in_degree, r.centrality, r.is_super_node) for r in R.centrality(n, e).collect()}
    assert c[100] == (10, 1.0, True) and c[200] == (9, 0.9, False) and c[0] == (0, 0.0, False)
    assert rows(R.super_nodes(n, e), "id") == [(100,)]
    members = graph.communities(n, e)
    assert members.select("anchor_id").distinct().count() == 1
    assert {r.member_id for r in members.collect()} == {*range(10), 100, 200}


def test_topology_globally_and_in_a_project(spark):
    n = nodes(spark, {"id": 1}, {"id": 2}, {"id": 3, "project_uuid": "q"})
    e = edges(spark, [(1, 2, "calls"), (1, 3, "depends_on")])
    assert R.topology_nodes(n).count() == 3 and R.topology_edges(n, e).count() == 2
    assert R.topology_nodes(n, "p").count() == 2 and R.topology_edges(n, e, "p").count() == 1


def test_later_edge_replaces_the_earlier_one(spark):
    e = spark.createDataFrame([(1, 2, "contains", 1.0, D(2024, 1, 1)), (1, 2, "calls", None, D(2024, 1, 2))], "source_id long, target_id long, relation_type string, weight double, loaded_at timestamp")
    assert rows(R.current_edges(e), "relation_type") == [("calls",)]


def test_in_degree_after_a_delete(spark):
    n, e = nodes(spark, 1, 2, 3, 4), edges(spark, [(1, 3), (2, 3)])
    assert rows(R.in_degree(e)) == [(3, 2)]
    left = delta.without_nodes({"nodes": n, "edges": e}, spark.createDataFrame([(2,)], "id long"))
    assert rows(R.in_degree(left["edges"])) == [(3, 1)]


def test_call_chains(spark):
    chain = lambda pairs, start, n: {r.node for r in graph.call_chain(spark.createDataFrame(pairs, "parent_node string, child_node string"), start, n).collect()}
    assert chain([("A", "B"), ("B", "C"), ("D", "E")], "A", 3) == {"B", "C"}
    assert chain([("A", "B"), ("B", "C"), ("C", "A")], "A", 4) == {"B", "C"}
    assert chain([("A", "B"), ("B", "C")], "A", 1) == {"B"}


def test_tree_lists_a_node_once_per_depth(spark):
    t = graph.dependency_tree(nodes(spark, 1, 2, 3), edges(spark, [(1, 2), (2, 3), (1, 3)]), 1)
    assert rows(t, "id", "depth") == [(1, 0), (2, 1), (3, 1), (3, 2)]
    r = graph.dependency_tree(nodes(spark, 1, 2, 3), edges(spark, [(1, 2), (2, 3)]), 3, reverse=True)
    assert rows(r, "id", "depth") == [(1, 2), (2, 1), (3, 0)]


def test_calls_resolve_here_then_dotted_then_anywhere(spark):
    s = spark.createDataFrame([(1, "a.py", "method_b"), (2, "a.py", "helper"), (3, "b.py", "func_a"), (4, "c.py", "func_a")], "node_id long, path string, name string")
    c = spark.createDataFrame([(1, "a.py", "func_a"), (1, "a.py", "self.helper"), (1, "a.py", "method_b"), (1, "a.py", "x.func_a")], "source_id long, path string, callee string")
    assert rows(graph.call_targets(s, c)) == [(1, 2), (1, 3)]


def test_phrase_search_matches_the_closed_formula(spark):
    n = nodes(spark, {"id": 1, "label": "Ação merge_run", "summary": "merge run merge"}, {"id": 2, "label": "x", "summary": "a merge"}, {"id": 3, "label": "nothing"}, {"id": 4, "label": None})
    tokens = search.token_frame(n)
    mean = (6 + 3 + 1 + 0) / 4
    g = lambda f, d: f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))
    got = dict(rows(search.text_search(tokens, "MERGE")))
    assert got[1] == 1.0 and abs(got[2] - round(g(1, 3) / g(3, 6), 4)) < 1e-9 and set(got) == {1, 2}
    assert rows(search.text_search(tokens, "merge run"), "id") == [(1,)] and rows(search.text_search(tokens, "acao"), "id") == [(1,)]
    assert search.text_search(tokens, "...").count() == 0


def test_overlapping_phrases_count_each(spark):
    n = nodes(spark, {"id": 1, "label": "a a a"})
    assert search.phrase_matches(search.token_frame(n), "a a").first()["hits"] == 2


def test_rerank_keeps_three_of_five(spark):
    c = spark.createDataFrame([(i, s) for i, s in enumerate([0.95, 0.80, 0.60, 0.20, 0.05])], "node_id long, score_final double")
    assert [r.node_id for r in search.rerank(c).orderBy("node_id").collect()] == [0, 1, 2]


def test_self_healing_and_sweep(spark):
    hits = spark.createDataFrame([("main", 0.9), ("utils", 0.8), ("gone", 0.95)], "id string, score double")
    files = spark.createDataFrame([("main",), ("utils",), ("main",)], "path string")
    assert [r.id for r in search.self_healed(hits, files).collect()] == ["main", "utils"]
    assert [r.id for r in delta.orphan_documents(hits, files).collect()] == ["gone"]


def test_sampling_prefers_what_was_useful(spark):
    hits = spark.createDataFrame([(1, 0.8), (2, 0.9)], "id long, score double")
    u = spark.createDataFrame([(1, 100.0, 1.0), (2, 1.0, 100.0)], "id long, utility_alpha double, utility_beta double")
    assert all(search.thompson_retrieve(hits, u, seed, 1).first().id == 1 for seed in range(5))
    assert search.thompson(hits, u, 7, "id", "score").collect() == search.thompson(hits, u, 7, "id", "score").collect()


def test_privacy_and_status(spark):
    levels = ["PUBLIC", "INTERNAL", "RESTRICTED"]
    p = spark.createDataFrame([(a, b) for a in levels for b in levels] + [("?", "PUBLIC"), (None, None)], "a string, b string")
    assert p.where(~audit.is_safe_flow(F.col("a"), F.col("b"))).count() == 3
    n = nodes(spark, {"id": 1}, {"id": 2, "status": "ARCHIVED"})
    w = spark.createDataFrame([(1, "STALE"), (1, "ACTIVE"), (2, "ACTIVE"), (9, "STALE")], "id long, new_status string")
    assert rows(audit.status_changes(n, w), "id", "new_status", "allowed") == [(1, "ACTIVE", False), (1, "STALE", True), (2, "ACTIVE", False), (9, "STALE", False)]


def test_audit_order_and_retry(spark):
    d = spark.createDataFrame([("", ["x"]), ("  ", ["x"]), ("fix", ["x"]), ("a long enough change", []), ("a long enough change", [" "]), ("a long enough change", ["x"]), (None, None)], "technical_changes string, updated_pointers array<string>")
    assert [r.approved for r in audit.audited(d).collect()].count(True) == 1
    out = audit.audit_with_retry({"technical_changes": "x"}, generate=lambda reason: {"technical_changes": ""})
    assert out["approved"] and out["partial_audit"] and out["loop_count"] == 3
    assert not audit.audit_with_retry({"technical_changes": "x"})["approved"]
    assert audit.audit_one({"technical_changes": "a long enough change", "updated_pointers": ["x"]}, judge=lambda d: 1 / 0)["partial_audit"]


def test_maintenance_archives_decays_and_reports(spark):
    n = nodes(spark, {"id": 1, "last_accessed": D(2024, 1, 1)}, {"id": 2}, {"id": 3, "last_accessed": D(2024, 5, 31)}, {"id": 4, "content": "text"})
    t = spark.createDataFrame([(1, "ACTIVE", D(2024, 1, 1)), (2, "ACTIVE", D(2024, 5, 30)), (3, "ACTIVE", None)], "id long, status string, created_at timestamp")
    v = spark.createDataFrame([("node_1", 1), ("node_9", 9), ("x", None)], "doc_id string, node_id long")
    out, report = maintenance.run_maintenance({"nodes": n, "edges": edges(spark, []), "trajectories": t, "vectors": v}, NOW)
    r = report.first()
    assert (r.decayed, r.archived, r.orphan_vectors, r.embedded_vectors, r.communities) == (1, 1, 2, 1, 0)
    assert rows(out["nodes"].where("status = 'ARCHIVED'"), "id") == [(1,)] and rows(out["vectors"], "doc_id") == [("node_1",), ("node_4",)]
    assert maintenance.run_maintenance({"nodes": n, "edges": edges(spark, [])}, NOW, ingesting=True)[1].first().skipped_idle_lock


def test_insights_are_replaced_not_repeated(spark):
    e = edges(spark, [(i, 100) for i in range(1, 11)])
    n = nodes(spark, *range(1, 11), 100)
    once, _ = maintenance.run_maintenance({"nodes": n, "edges": e}, NOW)
    twice, _ = maintenance.run_maintenance({"nodes": once["nodes"], "edges": e}, NOW)
    assert once["nodes"].count() == twice["nodes"].count() == 12
    assert "and 6 more" in once["nodes"].where("type = 'insight'").first().summary
    insight = once["nodes"].where("type = 'insight'").first().id
    assert rows(once["edges"].where("relation_type = 'summarizes'"), "source_id", "target_id") == [(insight, 100)]
    assert maintenance.insight_edges(once["edges"], once["nodes"], maintenance.community_summaries(n, graph.communities(n, e))).count() == once["edges"].count()


def test_a_summariser_sees_every_member_and_vectors_their_community(spark):
    e = edges(spark, [(i, 100) for i in range(1, 13)])
    n = nodes(spark, *({"id": i, "summary": f"s{i}", "tags": '["t%d"]' % (i % 2)} for i in (*range(1, 13), 100)))
    v = spark.createDataFrame([(f"node_{i}", [1.0], i, {"a": "b"}) for i in (1, 2)] + [("x", [1.0], 999, None)], "doc_id string, embedding array<float>, node_id long, metadata map<string,string>")
    out, r = maintenance.run_maintenance({"nodes": n, "edges": e, "vectors": v}, NOW, lambda t: f"{t.count('(MODULE/file)')} of {len(t)}", embedder=None)
    made = out["nodes"].where("type = 'insight'").first()
    assert made.summary.startswith("13 of ") and made.tags == '["t0","t1"]'
    assert {x.doc_id: x.metadata for x in out["vectors"].collect()} == {"node_1": {"a": "b", "community_id": "100"}, "node_2": {"a": "b", "community_id": "100"}}
    calls = iter([False, True])
    part, r = maintenance.run_maintenance({"nodes": n, "edges": e, "vectors": v}, NOW, ingesting=lambda: next(calls))
    assert r.first().skipped_idle_lock and part["vectors"].count() == 3


def test_contexts_are_stored_with_their_projects(spark):
    p = spark.createDataFrame([("p", "Proj", "old"), ("q", "Other", "kept")], "uuid string, folder_name string, summary string")
    n = nodes(spark, *({"id": i, "label": f"src/f{i}.py", "summary": f"s{i}", "tags": '["api"]'} for i in range(12)), {"id": 20, "label": "top.py", "summary": "top"}, {"id": 21, "label": "src", "type": "directory", "summary": "no"}, {"id": 22, "label": "x/y.py"})
    stored, report = summarise.project_contexts(p, n)
    r = report.first()
    assert (r.project_uuid, r.l1_count, r.n_modules, list(r.l2_tags)) == ("p", 2, 2, ["api"]) and "[src] (relevance=0.73)" in r.l2_summary
    assert dict(rows(stored, "uuid", "summary")) == {"p": r.l2_summary, "q": "kept"}
    asked = summarise.project_contexts(p, n, lambda t: f"<{len(t.splitlines())}>")[1].first()
    assert asked.l2_summary == "<2>"


def test_small_operators_of_agents(spark, tmp_path):
    t = spark.createDataFrame([], SCHEMAS["trajectories"])
    t = facade.learned(t, "p", {"phase": "build", "technical_changes": "c", "error": "boom", "solution": "s"}, NOW)
    assert facade.learned(t, "p", {"phase": "x", "technical_changes": "c"}, NOW) is t
    t = facade.learned(t, "q", {"phase": "x", "technical_changes": "c", "error": "e"}, F.lit(D(2024, 1, 1)).cast("timestamp"))
    assert rows(facade.trajectories_of(t), "id", "erro_encontrado") == [(1, "boom"), (2, "e")] and facade.trajectories_of(t, "q", "ACTIVE").count() == 1
    hits = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7), (4, 0.6)], "node_id long, score_final double")
    assert [r.node_id for r in search.rerank_judged(hits, lambda i: {1: 0.1, 2: 0.6, 3: 0.9, 4: 1.0}[i], 3).collect()] == [3, 2]
    assert [r.node_id for r in search.rerank_judged(hits, lambda i: 0.0, 3).collect()] == [1]
    store = S.SnapshotStore(spark, f"file://{tmp_path}")
    b = backend.SnapshotBackend(store)
    f = spark.createDataFrame([(7, "user", "u", "likes tea", D(2024, 1, 1), 1.0, 1.0)], "id long, scope_type string, scope_id string, fact_statement string, t_valid timestamp, utility_alpha double, utility_beta double")
    b.store(embed.fact_vectors(f))
    b.store(spark.createDataFrame([("node_1", [1.0] * 384, 1, "p")], "doc_id string, embedding array<float>, node_id long, project_uuid string"))
    assert b.count() == 2 and b.is_available() and rows(b.stored_node_ids(), "node_id") == [(1,)] and rows(b.search([1.0] * 384, 1, ["p"]), "node_id") == [(1,)]
    b.update_metadata(spark.createDataFrame([("fact_7", {"k": "v"})], "doc_id string, metadata map<string,string>"))
    assert b.rows().where("doc_id = 'fact_7'").first().metadata["k"] == "v" and rows(b.orphans(nodes(spark)), "doc_id") == [("fact_7",), ("node_1",)]
    b.delete(spark.createDataFrame([("fact_7",)], "doc_id string"))
    assert b.count() == 1
    b.reset()
    assert b.count() == 0


def test_a_table_is_never_without_a_version(spark, tmp_path):
    store = S.SnapshotStore(spark, f"file://{tmp_path}")
    row = lambda path, text: spark.createDataFrame([(path, text, "h", True, "c")], SCHEMAS["files"])
    store.append("files", row("a", "1"))
    old = store.read("files")
    before = {p.name for p in (tmp_path / "files").iterdir()}
    store.append("files", row("a", "2"))
    store.append("files", row("b", "3"))
    assert before <= {p.name for p in (tmp_path / "files").iterdir()} and rows(old, "content") == [("1",)]
    assert rows(store.read("files"), "path", "content") == [("a", "2"), ("b", "3")] and rows(store.read("files", 1), "content") == [("1",)]
    for i in range(S.COMPACT_AFTER):
        store._put("files", store._folders("files", store.version("files")) + store._folders("files", 1), store.version("files"))
    store.append("files", row("b", "4"))
    assert len(store._folders("files", store.version("files"))) == 1 and rows(store.read("files"), "path", "content") == [("a", "1"), ("b", "4")]
    bad = store.append("nodes", spark.createDataFrame([(1, None)], "id long, label string"), strict=False)
    assert rows(bad, "id") == [(1,)] and store.read("nodes").count() == 0


def test_signatures_decide_what_is_dirty(spark):
    f = spark.createDataFrame([], SCHEMAS["files"])
    at = lambda text: spark.createDataFrame([("a.py", text, "core")], "path string, content string, community_id string")
    one = delta.changed_files(f, at("import os\ndef f(a, b):\n    return a + b\n"))
    assert rows(one, "changed", "is_dirty") == [(True, True)]
    two = delta.changed_files(one.drop("changed"), at("import os\ndef f(a, b):\n    return a - b\n"))
    assert rows(two, "changed", "is_dirty") == [(False, False)]
    three = delta.changed_files(two.drop("changed"), at("import os\ndef f(a, b):\n    return 1\ndef g(): pass\n"))
    assert rows(three, "changed", "is_dirty") == [(True, True)]
    c = delta.community_states(spark.createDataFrame([("core", "old", False)], SCHEMAS["communities"]), three)
    assert rows(c, "id", "is_dirty", "n_dirty") == [("core", True, 1)]


def test_deleted_files_cached_chunks_and_hash_updates(spark):
    n = nodes(spark, {"id": 1, "label": "a.py::f", "content": "x"}, {"id": 2, "label": "b.py"}, {"id": 3, "label": "src", "type": "directory"}, {"id": 4, "label": ""}, {"id": 5, "label": "i", "type": "insight"})
    f = spark.createDataFrame([("p", "a.py"), ("p", "a.py")], "project_uuid string, path string")
    assert rows(delta.deleted_file_nodes(n, f), "id") == [(2,)]
    c = spark.createDataFrame([("p", "a.py::f", "x"), ("p", "a.py::f", "y"), ("p", None, None)], "project_uuid string, label string, content string")
    assert sorted(r.cached for r in delta.cached_chunks(c, n).collect()) == [False, False, True]
    u = delta.with_new_hashes(n, spark.createDataFrame([(1, "h")], "id long, file_hash string"))
    assert rows(u.where("file_hash is not null"), "id", "file_hash") == [(1, "h")]
    assert rows(delta.without_obsolete(u, "p", "a.py", "other"), "id") == [(2,), (3,), (4,), (5,)]


def test_wings_tags_and_relevance(spark):
    t = spark.createDataFrame([("a", "um funil de venda"), ("a", "dashboard"), ("b", None), ("c", "saas"), ("c", "bolsa")], "project_uuid string, text string")
    assert dict(rows(R.wing_scores(t))) == {"a": "marketing/vendas", "b": "geral", "c": "finanças/quant"}
    s = spark.createDataFrame([("src/a.py", "one", ["api", "x"], 12, False), ("src/b.py", "two", ["jwt"], 3, False), ("top.py", "three", None, 1, True)], "source_label string, summary string, detected_tags array<string>, source_chunks long, is_dumb_summary boolean")
    c = {r.cluster: r for r in R.clusters(s).collect()}
    assert set(c) == {"src", "<root>"} and c["src"].summaries == ["one", "two"] and c["src"].tags == ["api", "jwt", "x"]


def test_registering_committing_and_waking_up(spark):
    p = spark.createDataFrame([], SCHEMAS["projects"])
    p, key = facade.register_project(p, "/work/alpha", NOW)
    again, same = facade.register_project(p, "alpha", NOW)
    assert key == same and again.count() == 1
    n = nodes(spark, {"id": 1, "project_uuid": key}, {"id": 2, "project_uuid": key})
    c, touched = facade.commit_memory(spark.createDataFrame([], SCHEMAS["commit_log"]), n, key, "build", "some long change", ["a"], NOW, [2], True, False)
    assert rows(touched.where("last_commit_at is not null"), "id") == [(2,)] and c.first().revisor_approved
    f = spark.createDataFrame([(1, "user", "alpha", "likes tea", D(2024, 1, 1), None, 1.0, 1.0, None)], SCHEMAS["semantic_facts"])
    w = spark.createDataFrame([(key, "x")], SCHEMAS["reference_wings"])
    r = facade.wake_up(p, n, edges(spark, [(1, 2)]), c, w, f).first()
    assert (r.nodes, r.edges, r.commits, r.wings, r.facts, r.phase) == (2, 1, 1, ["x"], ["likes tea"], "build")
    assert [(c.phase, c.changes) for c in r.last_commits] == [("build", "some long change")]
    assert facade.add_wing(w, p, key, "geral").count() == 1 and facade.add_wing(w, p, key, "y").count() == 2
    done, _, verdict = facade.on_done({"phase": "x", "technical_changes": "fix", "updated_pointers": ["a"]}, c, n, key, NOW)
    assert not verdict["approved"] and done.count() == 1


def test_snapshots_ids_and_bulk(spark, tmp_path):
    store = S.SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.read("nodes").count() == 0
    good = spark.createDataFrame([(1, "p", "a", "MODULE", "ACTIVE", 7)], "id long, project_uuid string, label string, node_type string, status string, clash int")
    store.append("nodes", good)
    store.append("nodes", good.withColumn("id", F.lit(2)))
    assert store.read("nodes").count() == 2
    bad = good.withColumn("status", F.lit("ODD"))
    try:
        store.append("nodes", bad)
        raise AssertionError("an invalid row was taken")
    except ValueError:
        pass
    store.append("nodes", bad, strict=False)
    assert store.read("nodes").count() == 2 and store.reset("nodes") and store.read("nodes").count() == 0
    ids = S.with_ids(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), spark.createDataFrame([(10,)], "id long"), ["k"])
    assert rows(ids, "k", "id") == [("a", 11), ("b", 12), ("c", 13)]
    n, e = S.bulk_nodes_and_edges(
        conform(good, "nodes"), spark.createDataFrame([(1, 2, "contains")], "source_id long, target_id long, relation_type string"),
        spark.createDataFrame([(0, "p", "x"), (1, "p", "y")], "batch_index long, project_uuid string, label string"),
        spark.createDataFrame([("idx_0", "idx_1", "contains", 1), ("idx_0", "idx_1", "calls", 2), ("1", "2", "calls", 3), ("idx_9", "1", "calls", 4)], "source string, target string, relation_type string, seq long"),
    )
    assert n.count() == 3 and rows(e, "source_id", "target_id", "relation_type") == [(1, 2, "calls"), (2, 3, "calls")]


def test_vectors_upsert_metadata_and_routing(spark):
    schema = "doc_id string, embedding array<float>, metadata map<string,string>"
    old = spark.createDataFrame([("a", [1.0], {"k": "1", "z": "2"}), ("b", [2.0], None)], schema)
    new = spark.createDataFrame([("a", [9.0], {}), ("c", None, {}), (None, [1.0], {})], schema)
    assert rows(S.upsert_vectors(old, new), "doc_id", "embedding") == [("a", [9.0]), ("b", [2.0])]
    m = S.update_metadata(old, spark.createDataFrame([("a", {"k": None, "n": "3"})], "doc_id string, metadata map<string,string>"))
    assert {r.doc_id: r.metadata for r in m.collect()}["a"] == {"z": "2", "k": "", "n": "3"}
    r = S.routed(spark.createDataFrame([("a", None, {"timestamp": "t"}), ("b", None, {})], schema))
    assert rows(r, "doc_id", "collection") == [("a", "episodic_memory"), ("b", "main")]


def test_access_and_synchronisation(spark):
    n = nodes(spark, {"id": 1, "content": "alpha beta"}, {"id": 2, "content": "gamma", "project_uuid": "q"}, {"id": 3})
    assert rows(A.read_sql(spark, "select id from n where project_uuid = ? order by id", {"n": n}, ["p"])) == [(1,), (3,)]
    assert rows(A.read_sql(spark, "with x as (select * from n) select count(*) as c from x where id > :low", {"n": n}, {"low": 1})) == [(2,)]
    with pytest.raises(ValueError):
        A.read_sql(spark, "drop table n", {})
    v = spark.createDataFrame([("node_9", [1.0], 9, "p"), ("node_8", [1.0], 8, "q"), ("node_2", [1.0], None, "q")], "doc_id string, embedding array<float>, node_id long, project_uuid string")
    assert rows(A.stored_node_ids(v)) == [(2,), (8,), (9,)]
    assert rows(A.synced_vectors(n, v, "p"), "doc_id") == [("node_1",), ("node_2",), ("node_8",)]
    assert A.is_available(v) and not A.is_available(None) and not A.is_available(n)
    assert A.delete_edge(edges(spark, [(1, 2), (2, 1)]), 1, 2).count() == 1
    e, w = edges(spark, [(1, 3)]), spark.createDataFrame([], SCHEMAS["reference_wings"])
    p = spark.createDataFrame([("p", "alpha", "x", "PUBLIC", None, D(2024, 1, 1), D(2024, 1, 1))], SCHEMAS["projects"])
    vec = A.synced_vectors(n, v, "p").where("doc_id = 'node_1'")
    awake, best = facade.on_planning(p, n, e, vec, spark.createDataFrame([], SCHEMAS["commit_log"]), w, spark.createDataFrame([], SCHEMAS["semantic_facts"]), "p", "alpha beta", NOW)
    assert awake.count() == 1 and best.orderBy(F.desc("score_final")).first().node_id == 1


def test_constraints_split_rows(spark):
    m = spark.createDataFrame([(1, s, "x", "b", "c", None) for s in ("user", "session", "agent", "org", "project", None)], SCHEMAS["user_core_memory"])
    ok, bad = split_valid(m, "user_core_memory")
    assert ok.count() == 4 and bad.count() == 2
