"""Named queries of writes, ingest, summaries, maintenance and streams, with SQL twins.

Injected functions are small deterministic ones that SQL can say too.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions import text
from engrama.operators import delta, embed, facade, facts, graph, maintenance, search, summarise
from engrama.operators import relational as R
from engrama.operators.text_index import TextIndex
from engrama.plans import base as B
from engrama.plans import memory_graph as M
from engrama.plans.base import AP, CC, CE, CF, CN, CP, CV, FA
from engrama.sources import access, snapshots
from engrama.sources.backend import SnapshotBackend
from engrama.staging import shared_root, stage
from engrama.streaming import watch
from engrama.tables import table

QUERIES = {}
SQL = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n") if ctes else ""
            SQL[f.__name__] = head + sql
        return f

    return add


def _store(spark: SparkSession) -> snapshots.SnapshotStore:
    """A store of its own in the shared folder."""
    return snapshots.SnapshotStore(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}")


# --- reads and writes ----------------------------------------------------------------


@query("SELECT id, label FROM cn WHERE status = 'ACTIVE' AND id % 5 = 0", CN)
def read_by_sql(spark: SparkSession, d: str) -> DataFrame:
    return access.read_sql(spark, "select id, label from current_nodes where status = ? and id % ? = 0", {"current_nodes": B.nodes(spark, d)}, ["ACTIVE", 5])


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'STALE' ELSE status END AS status FROM cn", CN)
def transformed_table(spark: SparkSession, d: str) -> DataFrame:
    """A table after a write function ran over its current version."""
    store = _store(spark)
    store.write("nodes", B.nodes(spark, d))
    store.transform("nodes", lambda n: n.withColumn("status", F.when(F.col("id") % 4 == 0, "STALE").otherwise(F.col("status"))))
    return store.read("nodes").select("id", "status")


@query(
    f"SELECT table_name, n_stored, n_refused FROM (SELECT 'nodes' AS table_name, count(*) FILTER (WHERE ok) AS n_stored, count(*) FILTER (WHERE NOT ok) AS n_refused FROM (SELECT coalesce(project_uuid IS NOT NULL AND label IS NOT NULL AND node_type IN ({', '.join(map(repr, M.NODE_TYPES))}) AND status IN ('ACTIVE', 'STALE', 'ARCHIVED'), false) AS ok FROM cn) UNION ALL SELECT 'projects', count(*) FILTER (WHERE privacy_level IN ('PUBLIC', 'INTERNAL', 'RESTRICTED')), count(*) FILTER (WHERE privacy_level NOT IN ('PUBLIC', 'INTERNAL', 'RESTRICTED')) FROM cp)",
    CN, CP,
)
def appended_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows stored by validated appends in two halves, and those refused."""
    store, out = _store(spark), []
    for name, df, key in (("nodes", B.nodes(spark, d), "id"), ("projects", B.projects(spark, d), "uuid")):
        store.reset(name)
        half = F.pmod(F.xxhash64(key), F.lit(2))
        refused = [store.append(name, df.where(half == k), strict=False) for k in (0, 1)]
        bad = refused[0].unionByName(refused[1]).agg(F.count(F.lit(1)).alias("n_refused"))
        out.append(store.read(name).agg(F.count(F.lit(1)).alias("n_stored")).crossJoin(bad).select(F.lit(name).alias("table_name"), "n_stored", "n_refused"))
    return out[0].unionByName(out[1])


@query(
    "SELECT source_id, target_id, relation_type FROM ce WHERE source_id <> -5 UNION ALL SELECT CAST(top + rn AS BIGINT), CAST(target AS BIGINT), 'told' FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, (SELECT max(id) FROM cn) AS top, (SELECT min(id) FROM cn) AS target FROM documents)",
    CN, CE,
)
def bulk_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges after a batch of nodes, one per document, and of edges that name them by their place in the batch."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("batch_index"), F.lit("p").alias("project_uuid"), F.col("doc_id").cast("string").alias("label"))
    first = B.nodes(spark, d).agg(F.min("id")).first()[0]
    new = docs.select(F.concat(F.lit("idx_"), F.col("batch_index").cast("string")).alias("source"), F.lit(str(first)).alias("target"), F.lit("told").alias("relation_type"), F.col("batch_index").alias("seq"))
    _, edges = snapshots.bulk_nodes_and_edges(B.nodes(spark, d).select("id", "project_uuid", "label"), B.edges(spark, d).select("source_id", "target_id", "relation_type"), docs, new)
    return edges.select("source_id", "target_id", "relation_type")


@query("SELECT uuid, CASE WHEN uuid = " + AP + " THEN 'renamed' ELSE folder_name END AS folder_name, CASE WHEN uuid = " + AP + " THEN '2025-06-01' ELSE strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d') END AS day FROM cp", CP)
def updated_projects(spark: SparkSession, d: str) -> DataFrame:
    p = snapshots.update_project(B.projects(spark, d), B.anchor_project(spark, d), {"folder_name": F.lit("renamed")}, B.now())
    return p.select("uuid", "folder_name", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE event_type END AS kind, CASE WHEN event_id % 3 = 0 THEN '' ELSE NULL END AS extra FROM events")
def updated_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of collected rows, every third of them with a changed and a new key (null becomes empty)."""
    e = table(spark, d, "events")
    doc = F.col("event_id").cast("string").alias("doc_id")
    v = e.select("event_id", doc, F.create_map(F.lit("kind"), F.col("event_type")).alias("metadata"))
    c = e.where("event_id % 3 = 0").select(doc, F.create_map(F.lit("kind"), F.lit("new"), F.lit("extra"), F.lit(None).cast("string")).alias("metadata"))
    return snapshots.update_metadata(v, c).select("event_id", F.element_at("metadata", "kind").alias("kind"), F.try_element_at("metadata", F.lit("extra")).alias("extra"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'episodic_memory' ELSE 'main' END AS collection, event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS valid FROM events")
def routed_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Collection of each payload, and whether it is a valid episodic one: of three kinds of faults."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    full = F.create_map(
        F.lit("scope_type"), F.when(F.col("event_id") % 3 == 0, "nobody").otherwise("user"), F.lit("scope_id"), F.col("user_id").cast("string"), F.lit("timestamp"), F.col("ts").cast("string"), F.lit("utility_alpha"), F.lit("1"), F.lit("utility_beta"), F.lit("1"),
    )
    part = F.map_filter(full, lambda k, v: ~((k == "timestamp") & (F.col("event_id") % 2 == 1)) & ~((k == "utility_beta") & (F.col("event_id") % 5 == 0)))
    r = snapshots.routed(e.withColumn("metadata", part))
    return r.select("event_id", "collection", snapshots.valid_payload(F.col("metadata")).alias("valid"))


@query("SELECT doc_id FROM cv WHERE embedding IS NOT NULL AND node_id % 2 = 0 UNION SELECT 'vec_' || vec_id FROM embeddings", CV)
def backend_rows(spark: SparkSession, d: str) -> DataFrame:
    """A backend after two stores, the second of which replaces, and a delete."""
    b = SnapshotBackend(_store(spark))
    v = B.vectors(spark, d).select("doc_id", "embedding", "node_id", "project_uuid")
    b.store(v)
    b.store(table(spark, d, "embeddings").select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("doc_id"), "embedding"))
    b.delete(v.where("node_id % 2 <> 0"))
    return b.rows().select("doc_id")


@query("SELECT 'fact_' || id AS doc_id, scope_id FROM fa WHERE t_invalid IS NULL", FA)
def fact_documents(spark: SparkSession, d: str) -> DataFrame:
    return embed.fact_vectors(facts.active_facts(B.facts(spark, d))).select("doc_id", F.element_at("metadata", "scope_id").alias("scope_id"))


@query("SELECT DISTINCT path AS id FROM cf WHERE path NOT IN (SELECT path FROM cf WHERE file_id % 4 <> 0)", CF)
def orphan_documents(spark: SparkSession, d: str) -> DataFrame:
    f = B.files(spark, d).select("path", "file_id")
    return delta.orphan_documents(f.select(F.col("path").alias("id")), f.where("file_id % 4 <> 0"))


@query("SELECT n.id FROM cn n WHERE NOT (n.project_uuid = " + AP + " AND coalesce(n.label, '') <> '' AND lower(coalesce(n.type, '')) NOT IN ('directory', 'cluster', 'project', 'insight') AND split_part(n.label, '::', 1) NOT IN (SELECT path FROM cf WHERE pkey = " + AP + " AND file_id % 3 <> 0)) OR n.project_uuid IS NULL", CN, CP, CF)
def nodes_after_garbage_collection(spark: SparkSession, d: str) -> DataFrame:
    """Nodes left of a project of which every third file is gone."""
    a = B.anchor_project(spark, d)
    files = B.files(spark, d).where((F.col("project_uuid") == a) & (F.col("file_id") % 3 != 0)).select("project_uuid", "path")
    t = {"nodes": B.nodes(spark, d), "edges": B.edges(spark, d), "vectors": B.vectors(spark, d)}
    return delta.garbage_collected(t, files, a)["nodes"].select("id")


@query("SELECT CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE 'root' END AS id, bool_or(file_id % 3 = 0) AS is_dirty, CAST(count(*) FILTER (WHERE file_id % 3 = 0) AS BIGINT) AS n_dirty FROM cf GROUP BY 1", CF)
def dirty_communities(spark: SparkSession, d: str) -> DataFrame:
    f = graph.natural_communities(B.files(spark, d)).select("path", "community_id", (F.col("file_id") % 3 == 0).alias("is_dirty"))
    none = f.select(F.col("community_id").alias("id"), F.lit(None).cast("string").alias("summary_text"), F.lit(False).alias("is_dirty")).limit(0)
    return delta.community_states(none, f).select("id", "is_dirty", "n_dirty")


@query("SELECT folder_name, primary_wing FROM cp UNION ALL SELECT 'brand_new', 'wing_general'", CP)
def registered_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects after one of them and a new folder were registered."""
    p = B.projects(spark, d)
    p, known = facade.register_project(p, B.anchor_project(spark, d), B.now())
    p, _ = facade.register_project(p, "C:\\work\\brand_new\\", B.now(), "wing_general")
    return p.select("folder_name", "primary_wing")


@query("SELECT id, id % 9 = 0 OR last_commit_at IS NOT NULL AS stamped FROM cn", CN)
def committed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes after a commit that names every ninth of them."""
    n = B.nodes(spark, d).select("id", "last_commit_at")
    ids = n.where("id % 9 = 0").select("id")
    commits = spark.createDataFrame([], "id long, project_uuid string, phase string, technical_changes string, updated_pointers array<string>, revisor_approved boolean, partial_audit boolean, created_at timestamp")
    commits, _ = facade.commit_memory(commits, n, B.anchor_project(spark, d), "build", "a change", ["x"], B.now())
    return delta.touched(n, ids, "last_commit_at", commits.select("created_at").first()[0] and B.now()).select("id", F.col("last_commit_at").isNotNull().alias("stamped"))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'F'")
def trajectories(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("project_uuid"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    return facade.trajectories_of(t, status="F").select("id", "created_at")


@query(
    "SELECT p.uuid AS project_uuid, p.folder_name, CAST(coalesce(n.n, 0) AS BIGINT) AS nodes, CAST(1 AS BIGINT) AS commits, p.privacy_level AS last_phase, p.primary_wing AS wing, 'is in ' || p.primary_wing AS fact FROM cp p LEFT JOIN (SELECT project_uuid, count(*) AS n FROM cn GROUP BY 1) n ON n.project_uuid = p.uuid",
    CN, CP,
)
def wake_up(spark: SparkSession, d: str) -> DataFrame:
    """What each project starts from; projects stand for their own commit, wing and fact."""
    p = B.projects(spark, d)
    commits = p.select(F.xxhash64("uuid").alias("id"), F.col("uuid").alias("project_uuid"), F.col("privacy_level").alias("phase"), F.col("folder_name").alias("technical_changes"), "created_at")
    wings = p.select(F.col("uuid").alias("project_uuid"), F.col("primary_wing").alias("wing_name"))
    f = p.groupBy("folder_name").agg(F.max("primary_wing").alias("w")).select(F.xxhash64("folder_name").alias("id"), F.lit("user").alias("scope_type"), F.col("folder_name").alias("scope_id"), F.concat(F.lit("is in "), "w").alias("fact_statement"), F.lit(None).cast("timestamp").alias("t_invalid"))
    w = facade.wake_up(p, B.nodes(spark, d), B.edges(spark, d), commits, wings, f)
    return w.select("project_uuid", "folder_name", "nodes", "commits", F.col("last_commits")[0]["phase"].alias("last_phase"), F.col("wings")[0].alias("wing"), F.col("facts")[0].alias("fact"))


# --- facts ---------------------------------------------------------------------------


@query(
    """SELECT scope_id, CAST(1 AS BIGINT) AS seq, CASE WHEN fact_statement = 'click' THEN 'NOOP' ELSE 'ADD' END AS action, CAST(NULL AS BIGINT) AS target_id FROM fa WHERE t_invalid IS NULL
UNION ALL SELECT scope_id, 2, CASE WHEN fact_statement = 'click' THEN 'ADD' ELSE 'UPDATE' END, CASE WHEN fact_statement = 'click' THEN NULL ELSE id END FROM fa WHERE t_invalid IS NULL""",
    FA,
)
def fact_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Two new statements per user: a known one is left, a third one replaces the oldest."""
    f = B.facts(spark, d)
    users = facts.active_facts(f).select("scope_type", "scope_id")
    new = users.select("*", F.lit(1).alias("seq"), F.lit("click").alias("fact_statement")).unionByName(users.select("*", F.lit(2).alias("seq"), F.lit("tea").alias("fact_statement")))

    def decide(active: list[tuple[int, str]], statement: str) -> str:
        if any(s == statement for _, s in active):
            return '{"action": "NOOP"}'
        if len(active) >= 2:
            return json.dumps({"action": "UPDATE", "target_id": active[0][0], "updated_statement": statement})
        return 'I say: {"action": "ADD"}'

    log = facts.decide_facts(f, new, decide, datetime.datetime(2025, 6, 1))[1]
    return log.select("scope_id", "seq", "action", "target_id")


@query("SELECT scope_id, block_label, content FROM (SELECT CAST(user_id AS VARCHAR) AS scope_id, 'last' AS block_label, event_type AS content, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 UNION ALL SELECT 'default', 'persona', 'plain'")
def seeded_memory(spark: SparkSession, d: str) -> DataFrame:
    """Core memory out of events, with a default block."""
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("user").alias("scope_type"), F.col("user_id").cast("string").alias("scope_id"), F.lit("last").alias("block_label"), F.col("event_type").alias("content"), F.col("ts").alias("updated_at"))
    return facts.core_memory(facts.seeded_memory(log, {("agent", "default", "persona"): "plain"}, B.now())).select("scope_id", "block_label", "content")


# --- search --------------------------------------------------------------------------


@query("SELECT id, bm25_score FROM tx", CN, M._TOKENS, M._text_ctes(M.WORD))
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The text search, out of a stored index."""
    return _index(spark, d).search(M.WORD)


@query("SELECT id, bm25_score FROM tx", CN, M._TOKENS, M._text_ctes(M.PHRASE, "node_type <> 'FACT'", limit=50))
def indexed_phrase_search(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    return index.search(M.PHRASE, where=F.col("node_type") != "FACT", limit=50)


def _index(spark: SparkSession, d: str) -> TextIndex:
    return TextIndex.build(B.nodes(spark, d).select("id", "project_uuid", "label", "tags", "summary", "node_type", "type"), f"{shared_root(spark)}/index-{uuid.uuid4().hex}")


@query("SELECT node_id, score_final, is_super_node FROM hs", CN, CE, CV, M._TOKENS, M._text_ctes(M.WORD), M._COS, M._HYBRID)
def indexed_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query with its text part out of a stored index."""
    found = search.hybrid_search(B.nodes(spark, d), B.edges(spark, d), B.vectors(spark, d), M.WORD, B.query_vector(spark, d), B.now(), index=_index(spark, d))
    return found.select("node_id", "score_final", "is_super_node")


@query("SELECT node_id, round(v, 4) AS vetorial, round(f, 4) AS frequencia, round(r, 4) AS recencia, round(c, 4) AS centralidade FROM hy WHERE node_id IN (SELECT node_id FROM hs)", CN, CE, CV, M._TOKENS, M._text_ctes(M.WORD), M._COS, M._HYBRID)
def hybrid_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the flagship query's scores."""
    return M._hybrid(spark, d).select("node_id", "score_breakdown.*")


_SCOPED = "vp AS (SELECT * FROM vs WHERE project_uuid IN (SELECT uuid FROM cp WHERE primary_wing = (SELECT primary_wing FROM cp WHERE uuid = " + AP + ")))"


@query("SELECT node_id, score_final, is_super_node FROM hs", CN, CE, CP, CV, M._TOKENS, M._text_ctes(M.WORD, f"project_uuid = {AP}"), M._COS, _SCOPED, M._HYBRID.replace("FROM vs ORDER", "FROM vp ORDER"))
def hybrid_search_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query with text of one project and vectors of its scope."""
    a = B.anchor_project(spark, d)
    scope = search.scoped_projects(B.projects(spark, d), None, a)
    return search.hybrid_search(B.nodes(spark, d), B.edges(spark, d), B.vectors(spark, d), M.WORD, B.query_vector(spark, d), B.now(), a, scope).select("node_id", "score_final", "is_super_node")


@query("SELECT node_id, score_final, CAST((node_id % 10) / 10.0 AS DOUBLE) AS relevance FROM (SELECT *, row_number() OVER (ORDER BY node_id % 10 DESC, score_final DESC, node_id) AS rn FROM (SELECT * FROM hs ORDER BY score_final DESC, node_id LIMIT 5)) WHERE node_id % 10 >= 5 OR rn = 1", CN, CE, CV, M._TOKENS, M._text_ctes(M.WORD), M._COS, M._HYBRID)
def judged(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query's results as an injected judge ranks them: by the last digit of their ids."""
    hits = M._hybrid(spark, d).select("node_id", "score_final")
    return search.rerank_judged(hits, lambda i: i % 10 / 10)


@query("SELECT event_id AS id FROM events ORDER BY value DESC, event_id LIMIT 3")
def thompson_retrieved(spark: SparkSession, d: str) -> DataFrame:
    """Sampling by utilities so certain that it keeps the order of the scores."""
    e = table(spark, d, "events").where("value is not null")
    hits = e.select(F.col("event_id").alias("id"), F.col("value").alias("score"))
    sure = e.select(F.col("event_id").alias("id"), F.lit(1e15).alias("utility_alpha"), F.lit(1e-3).alias("utility_beta"))
    return search.thompson_retrieve(hits, sure, 7, 3).select("id")


# --- summaries and maintenance -------------------------------------------------------


def _sized(text_: str) -> str:
    return json.dumps({"summary": f"{len(text_)} characters", "tags": ["told"], "relevance": 0.5})


@query("SELECT chunk_id, length(coalesce(content, '')) || ' characters' AS summary, array_to_string(list_sort(list_distinct(list_append(coalesce(detected_tags, []), 'told'))), ',') AS tags, false AS is_dumb_summary FROM cc", CC)
def chunk_summaries(spark: SparkSession, d: str) -> DataFrame:
    """A summary of every chunk by an injected function."""
    c = B.chunks(spark, d).select(F.col("chunk_id").cast("string").alias("source_label"), F.coalesce("content", F.lit("")).alias("content"), "detected_tags")
    s = summarise.summarise_chunks(c, _sized)
    return s.select(F.col("source_label").cast("long").alias("chunk_id"), "summary", F.array_join("detected_tags", ",").alias("tags"), "is_dumb_summary")


@query("SELECT chunk_id, length(content) || ' characters' AS summary FROM cc WHERE content IS NOT NULL", CC)
def grouped_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The same with one call for five small chunks; the reply leaves out every third of them."""

    def call(t: str) -> str:
        try:
            parts = json.loads(t)
        except ValueError:
            parts = None
        if isinstance(parts, list):
            return json.dumps({"summaries": [{"index": i, "summary": f"{len(x)} characters"} for i, x in enumerate(parts) if i % 3 < 2]})
        return _sized(t)

    c = B.chunks(spark, d).select(F.col("chunk_id").cast("string").alias("source_label"), "content")
    return summarise.summarise_grouped(c, call).select(F.col("source_label").cast("long").alias("chunk_id"), "summary")


_L0 = """l0 AS (SELECT project_uuid, CASE WHEN regexp_matches(replace(label, '\\', '/'), '.+/') THEN regexp_extract(replace(label, '\\', '/'), '^(.*)/[^/]*$', 1) ELSE '<root>' END AS dir, label, summary,
  coalesce(TRY_CAST(TRY_CAST(tags AS JSON) AS VARCHAR[]), []) AS tags FROM cn WHERE coalesce(type, '') NOT IN ('directory', 'cluster', 'project') AND summary <> '' AND label IS NOT NULL AND project_uuid IS NOT NULL),
l1 AS (SELECT g.project_uuid, g.dir, g.n, round(0.4 * least(1.0, g.n / 10.0) + 0.4 * least(1.0, coalesce(h.k, 0) / 3.0) + 0.2, 3) AS relevance FROM (SELECT project_uuid, dir, count(*) AS n FROM l0 GROUP BY ALL) g
  LEFT JOIN (SELECT project_uuid, dir, count(DISTINCT tag) AS k FROM (SELECT project_uuid, dir, unnest(tags) AS tag FROM l0) WHERE tag IN (""" + ", ".join(f"'{t}'" for t in text.HIGH_PRIORITY_TAGS) + """) GROUP BY ALL) h ON h.project_uuid = g.project_uuid AND h.dir = g.dir)"""


@query("SELECT project_uuid, CAST(count(*) AS BIGINT) AS l1_count, CAST(count(*) AS BIGINT) AS n_modules, count(*) || ' lines' AS l2_summary FROM l1 GROUP BY 1", CN, _L0)
def project_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of all projects out of those of their directories; the function counts lines."""
    report = summarise.project_contexts(B.projects(spark, d), B.nodes(spark, d), lambda t: f"{len(t.split(chr(10)))} lines")[1]
    return report.select("project_uuid", "l1_count", "n_modules", "l2_summary")


@query("SELECT project_uuid, dir AS source_label, CAST(n AS BIGINT) AS source_chunks, CAST(relevance AS DOUBLE) AS relevance_score FROM (SELECT *, row_number() OVER (PARTITION BY project_uuid ORDER BY relevance DESC, dir) AS rn FROM l1) WHERE relevance >= 0.4 OR (rn = 1 AND relevance < 0.4)", CN, _L0)
def relevant_directories(spark: SparkSession, d: str) -> DataFrame:
    """Directories of each project that are relevant enough for its summary, with a stricter limit than usual."""
    n = B.nodes(spark, d).where("coalesce(type, '') not in ('directory', 'cluster', 'project') and summary <> '' and label is not null and project_uuid is not null")
    l0 = n.select("project_uuid", F.col("label").alias("source_label"), "summary", F.coalesce(R.parsed_tags(F.col("tags")), F.array().cast("array<string>")).alias("detected_tags"), F.lit(1).cast("long").alias("source_chunks"), F.lit(False).alias("is_dumb_summary"))
    kept = summarise.pruned_within(stage(summarise.summarise_directories(l0, within=("project_uuid",)), "l1"), "project_uuid", 0.4)
    return kept.select("project_uuid", "source_label", "source_chunks", "relevance_score")


@query("SELECT dir AS id, length(string_agg(content, chr(10) ORDER BY source_file, chunk_id)) || ' characters' AS summary_text FROM (SELECT *, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS dir FROM cc WHERE content IS NOT NULL) GROUP BY 1", CC)
def refreshed_communities(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of directories, asked for where they are dirty or missing: here everywhere."""
    c = B.chunks(spark, d).where("content is not null")
    key = F.concat("source_file", F.lit("\u0001"), F.format_string("%020d", "chunk_id"))
    files = stage(c.select(key.alias("path"), "content", F.regexp_extract("source_file", "^(.*)/[^/]*$", 1).alias("community_id")), "files")
    known = files.select(F.col("community_id").alias("id"), F.lit(None).cast("string").alias("summary_text"), F.lit(True).alias("is_dirty")).distinct()
    return summarise.refreshed_communities(known, files, lambda t: f"{len(t)} characters").select("id", "summary_text")


_COMMUNITIES = """an AS (SELECT n.id, n.project_uuid FROM cn n JOIN (SELECT target_id FROM ce GROUP BY 1 HAVING count(*) >= 10) g ON g.target_id = n.id WHERE n.status = 'ACTIVE'),
st AS (SELECT DISTINCT b.f, b.t, n.project_uuid FROM (SELECT source_id AS f, target_id AS t FROM ce UNION ALL SELECT target_id, source_id FROM ce) b JOIN cn n ON n.id = b.t WHERE b.f <> b.t AND n.status = 'ACTIVE'),
m AS (SELECT id AS anchor_id, id AS member_id, project_uuid, 0 AS hop FROM an UNION SELECT m.anchor_id, s.t, m.project_uuid, m.hop + 1 FROM m JOIN st s ON s.f = m.member_id AND s.project_uuid = m.project_uuid WHERE m.hop < 5),
co AS (SELECT DISTINCT m.anchor_id, m.member_id, n.label, n.tags FROM m JOIN cn n ON n.id = m.member_id)"""
_INSIGHTS = """SELECT anchor_id, CAST(count(*) AS BIGINT) AS n_members, 'Community of ' || array_to_string(list_transform(list_sort(list({'id': member_id, 'label': label}))[1:5], lambda x: coalesce(x.label, '')), ', ') || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS summary,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(TRY_CAST(TRY_CAST(tags AS JSON) AS VARCHAR[]), []))))), ',') AS tags FROM co GROUP BY 1"""


@query(_INSIGHTS, CN, CE, _COMMUNITIES, recursive=True)
def community_insights(spark: SparkSession, d: str) -> DataFrame:
    s = maintenance.label_summaries(B.nodes(spark, d), B.edges(spark, d))
    return s.withColumn("tags", F.array_join("tags", ","))


@query("SELECT member_id, best.anchor AS anchor_id, CAST(best.hop AS INTEGER) AS hops FROM (SELECT member_id, min({'hop': hop, 'anchor': anchor_id}) AS best FROM m GROUP BY 1)", CN, CE, _COMMUNITIES, recursive=True)
def nearest_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest_communities(B.nodes(spark, d), B.edges(spark, d))


@query("SELECT anchor_id AS target_id, count(*) || ' members' AS summary, CAST(1 AS BIGINT) AS n_edges FROM co GROUP BY 1", CN, CE, _COMMUNITIES, recursive=True)
def community_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from the insights, which a function made of all their members, to the super-nodes."""
    n, e = B.nodes(spark, d), B.edges(spark, d)
    s = stage(maintenance.community_summaries(n, stage(graph.communities(n, e), "communities"), lambda t: f"{t.count(chr(10)) + 1} members"), "summaries")
    n = stage(maintenance.insight_nodes(n, s), "nodes")
    made = maintenance.insight_edges(e, n, s).where("relation_type = 'summarizes'")
    own = F.concat(F.lit("community_"), F.col("target_id").cast("string"), F.lit("_summary"))
    return made.join(n.where("type = 'insight'").select(F.col("id").alias("source_id"), "label", "summary"), "source_id").where(F.col("label") == own).groupBy("target_id", "summary").agg(F.count(F.lit(1)).alias("n_edges"))


@query("SELECT v.doc_id, CAST(max(co.anchor_id) AS VARCHAR) AS community_id FROM cv v LEFT JOIN co ON co.member_id = v.node_id GROUP BY 1", CN, CE, CV, _COMMUNITIES, recursive=True)
def vector_communities(spark: SparkSession, d: str) -> DataFrame:
    greatest = graph.greatest_communities(B.nodes(spark, d), B.edges(spark, d))
    return maintenance.with_community_ids(B.vectors(spark, d), greatest).select("doc_id", F.try_element_at("metadata", F.lit("community_id")).alias("community_id"))


_OLD = "status = 'ACTIVE' AND last_accessed IS NOT NULL AND epoch_us(TIMESTAMPTZ '" + B.NOW + "+00') - epoch_us(last_accessed) > 60 * 8.64e10"


@query(
    f"""SELECT false AS skipped_idle_lock, CAST(0 AS BIGINT) AS decayed, (SELECT count(*) FROM was WHERE old) AS archived, (SELECT count(*) FROM cv WHERE node_id IS NULL OR node_id NOT IN (SELECT id FROM was)) AS orphan_vectors,
(SELECT count(*) FROM cn WHERE status = 'ACTIVE' AND regexp_matches(content, '[\\p{{L}}\\p{{N}}]') AND id NOT IN (SELECT node_id FROM cv WHERE node_id IS NOT NULL)) AS embedded_vectors,
(SELECT count(DISTINCT anchor_id) FROM co) AS communities, (SELECT count(DISTINCT project_uuid) FROM (SELECT project_uuid FROM l0 UNION ALL SELECT project_uuid FROM an)) AS contexts""",
    CN.replace("cn AS", "was AS").replace("SELECT id,", f"SELECT coalesce({_OLD}, false) AS old, id,"),
    "cn AS (SELECT * REPLACE (CASE WHEN old THEN 'ARCHIVED' ELSE status END AS status) FROM was)",
    CE, CV, _COMMUNITIES, _L0, recursive=True,
)
def maintenance_report(spark: SparkSession, d: str) -> DataFrame:
    t = {"nodes": B.nodes(spark, d), "edges": B.edges(spark, d), "vectors": B.vectors(spark, d), "projects": B.projects(spark, d)}
    return maintenance.run_maintenance(t, B.now())[1]


# --- streams -------------------------------------------------------------------------


@query("SELECT 'notes/' || source || '/' || doc_id || '.md' AS path, 'notes/' || source AS community_id, true AS is_dirty FROM documents WHERE text IS NOT NULL")
def streamed_changes(spark: SparkSession, d: str) -> DataFrame:
    """The files table after a stream of changes, one per document, with a directory and an ignored file among them."""
    root = f"{shared_root(spark)}/changes-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").where("text is not null")
    log = docs.select(F.concat(F.lit("notes/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"), F.lit(False).alias("is_directory"), F.col("doc_id").alias("seq"))
    extra = spark.createDataFrame([("notes", None, True, 0), ("notes/x.pyc", "z", False, 0)], "path string, content string, is_directory boolean, seq long")
    log.unionByName(extra).write.json(root)
    store = _store(spark)
    watch.watch(watch.change_stream(spark, root), store, f"{root}-checkpoint").awaitTermination()
    return store.read("files").select("path", "community_id", "is_dirty")
