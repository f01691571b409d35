"""Named queries of the memory graph's own operators, with SQL twins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions import scoring, text
from engrama.operators import audit, batch_search, chunking, delta, embed, facade, facts, graph, maintenance, search, summarise
from engrama.operators import relational as R
from engrama.plans import base as B
from engrama.plans.base import AN, AP, CC, CE, CF, CN, CP, CV, FA, T
from engrama.schemas import NODE_TYPES, split_valid
from engrama.sources import access, crawl, snapshots
from engrama.sources.ignore import IgnoreRules
from engrama.staging import stage
from engrama.streaming import watch
from engrama.tables import table

QUERIES = {}
SQL = {}
WORD, PHRASE, SYMBOL = "the", "records who made", "rank"


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n") if ctes else ""
            SQL[f.__name__] = head + sql
        return f

    return add


# --- scans, aggregations -----------------------------------------------------


@query("SELECT id, label, node_type, status FROM cn WHERE project_uuid = " + AP + " AND status = 'ACTIVE'", CN, CP)
def scan_nodes(spark: SparkSession, d: str) -> DataFrame:
    return R.select_nodes(B.nodes(spark, d), B.anchor_project(spark, d), status="ACTIVE").select("id", "label", "node_type", "status")


@query("SELECT uuid, folder_name FROM cp WHERE uuid = " + AP, CP)
def find_project(spark: SparkSession, d: str) -> DataFrame:
    return R.find_project(B.projects(spark, d), B.anchor_project(spark, d)).select("uuid", "folder_name")


@query("SELECT f.file_id, h.node_id FROM cf f LEFT JOIN (SELECT project_uuid, file_hash, min(id) AS node_id FROM cn WHERE file_hash IS NOT NULL GROUP BY ALL) h ON h.project_uuid = f.pkey AND h.file_hash = f.file_hash", CN, CF)
def find_nodes_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return R.find_nodes_by_hash(B.nodes(spark, d), B.files(spark, d).select("file_id", "project_uuid", "file_hash")).select("file_id", "node_id")


@query("SELECT project_uuid, node_type, CAST(count(*) AS BIGINT) AS n_nodes FROM cn GROUP BY ALL", CN)
def node_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.node_type_counts(B.nodes(spark, d).select("project_uuid", "node_type"))


_CENTRALITY = """SELECT n.id, CAST(coalesce(g.n, 0) AS BIGINT) AS in_degree, CAST(least(coalesce(g.n, 0) / 10.0, 1.0) AS DOUBLE) AS centrality, coalesce(g.n, 0) >= 10 AS is_super_node
FROM cn n LEFT JOIN (SELECT target_id, count(*) AS n FROM ce GROUP BY 1) g ON g.target_id = n.id"""


@query(_CENTRALITY, CN, CE)
def centrality(spark: SparkSession, d: str) -> DataFrame:
    return R.centrality(B.nodes(spark, d).select("id"), B.edges(spark, d))


@query("SELECT n.id, n.project_uuid, n.label, g.in_degree FROM cn n JOIN (SELECT target_id, CAST(count(*) AS BIGINT) AS in_degree FROM ce GROUP BY 1 HAVING count(*) >= 10) g ON g.target_id = n.id WHERE n.status = 'ACTIVE'", CN, CE)
def super_nodes(spark: SparkSession, d: str) -> DataFrame:
    return R.super_nodes(B.nodes(spark, d), B.edges(spark, d))


@query(
    """SELECT p.uuid AS project_uuid, p.folder_name, CAST(coalesce(n.n, 0) AS BIGINT) AS nodes, CAST(coalesce(n.a, 0) AS BIGINT) AS active_nodes, CAST(coalesce(e.n, 0) AS BIGINT) AS edges
FROM cp p LEFT JOIN (SELECT project_uuid, count(*) AS n, count(*) FILTER (WHERE status = 'ACTIVE') AS a FROM cn GROUP BY 1) n ON n.project_uuid = p.uuid
LEFT JOIN (SELECT s.project_uuid, count(*) AS n FROM ce JOIN cn s ON s.id = ce.source_id GROUP BY 1) e ON e.project_uuid = p.uuid""",
    CN, CE, CP,
)
def project_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.project_stats(B.projects(spark, d), B.nodes(spark, d), B.edges(spark, d)).drop("by_type")


@query("SELECT id AS node_id, label AS name, node_type FROM cn WHERE status = 'ACTIVE'", CN)
def topology_nodes(spark: SparkSession, d: str) -> DataFrame:
    return R.topology_nodes(B.nodes(spark, d))


@query(
    "SELECT e.source_id AS source, e.target_id AS target, e.relation_type AS edge_type FROM ce e JOIN cn a ON a.id = e.source_id JOIN cn b ON b.id = e.target_id WHERE a.status = 'ACTIVE' AND b.status = 'ACTIVE' AND a.project_uuid = "
    + AP + " AND b.project_uuid = " + AP, CN, CE, CP,
)
def topology_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.topology_edges(B.nodes(spark, d), B.edges(spark, d), B.anchor_project(spark, d))


@query("SELECT source_id AS source, target_id AS target, relation_type AS edge_type FROM ce", CE)
def topology_all_edges(spark: SparkSession, d: str) -> DataFrame:
    return R.topology_edges(B.nodes(spark, d), B.edges(spark, d))


@query("SELECT id, label, type, summary, content, project_uuid FROM cn WHERE id = " + AN, CN, CE)
def implementation(spark: SparkSession, d: str) -> DataFrame:
    return R.implementation(B.nodes(spark, d), B.anchor_node(spark, d))


@query("SELECT e.target_id AS callee_id, n.id, n.label, n.type, e.relation_type FROM ce e JOIN cn n ON n.id = e.source_id WHERE e.relation_type = 'calls'", CN, CE)
def callers(spark: SparkSession, d: str) -> DataFrame:
    return R.callers(B.nodes(spark, d), B.edges(spark, d))


@query("SELECT e.target_id AS callee_id, n.id, n.label, n.type, e.relation_type FROM ce e JOIN cn n ON n.id = e.source_id", CN, CE)
def callers_any_relation(spark: SparkSession, d: str) -> DataFrame:
    return R.callers(B.nodes(spark, d), B.edges(spark, d), calls_only=False)


@query("SELECT source_id, target_id, relation_type FROM ce WHERE source_id = " + AN, CE)
def edges_from(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(B.anchor_node(spark, d),)], "id long")
    return R.adjacency(B.edges(spark, d), ids).select("source_id", "target_id", "relation_type")


@query("SELECT source_id, target_id, relation_type FROM ce WHERE target_id = " + AN, CE)
def edges_to(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(B.anchor_node(spark, d),)], "id long")
    return R.adjacency(B.edges(spark, d), ids, incoming=True).select("source_id", "target_id", "relation_type")


@query("SELECT folder_name, uuid, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS updated_on FROM (SELECT *, row_number() OVER (PARTITION BY folder_name ORDER BY updated_at DESC, uuid DESC) AS rn FROM cp) WHERE rn = 1", CP)
def list_projects(spark: SparkSession, d: str) -> DataFrame:
    return R.project_listing(B.projects(spark, d))


@query("SELECT category, CAST(count(*) AS BIGINT) AS n_files FROM cf GROUP BY 1", CF)
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.category_counts(B.files(spark, d).select("category"))


@query("SELECT source_file, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT source_file, unnest(detected_tags) AS tag FROM cc) GROUP BY 1", CC)
def consolidated_tags(spark: SparkSession, d: str) -> DataFrame:
    t = R.consolidated_tags(B.chunks(spark, d).select("source_file", "detected_tags"), ["source_file"])
    return t.select("source_file", F.array_join("tags", ",").alias("tags"))


def _wing_sql() -> str:
    flags, sums, i = [], {}, 0
    for wing, words in R.WING_WORDS.items():
        for word in words:
            flags.append(f"max(CASE WHEN contains(lower(coalesce(t, '')), '{word}') THEN 1 ELSE 0 END) AS w{i}")
            sums.setdefault(wing, []).append(f"w{i}")
            i += 1
    picks = " UNION ALL ".join(f"SELECT project_uuid, '{w}' AS wing, {' + '.join(c)} AS s FROM f" for w, c in sums.items())
    return f"""SELECT project_uuid, CASE WHEN s > 0 THEN wing ELSE '{R.DEFAULT_WING}' END AS wing FROM (
SELECT *, row_number() OVER (PARTITION BY project_uuid ORDER BY s DESC, wing) AS rn FROM ({picks})) WHERE rn = 1""", f"""t AS (
SELECT project_uuid, concat_ws(' ', label, tags) AS t FROM cn WHERE status = 'ACTIVE' UNION ALL SELECT uuid, summary FROM cp),
f AS (SELECT project_uuid, {', '.join(flags)} FROM t GROUP BY 1)"""


@query(_wing_sql()[0], CN, CP, _wing_sql()[1])
def wing_scores(spark: SparkSession, d: str) -> DataFrame:
    n = B.nodes(spark, d).where("status = 'ACTIVE'").select("project_uuid", F.concat_ws(" ", "label", "tags").alias("text"))
    return R.wing_scores(n.unionByName(B.projects(spark, d).select(F.col("uuid").alias("project_uuid"), F.col("summary").alias("text"))))


@query(
    "SELECT 'nodes' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'projects', count(*) FROM projects UNION ALL SELECT 'vectors', count(*) FROM vectors UNION ALL SELECT 'agent_checkpoints', -1"
)
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.table_counts({t: table(spark, d, t) for t in ("nodes", "edges", "projects", "vectors")} | {"agent_checkpoints": None})


@query("SELECT CAST(quantile_cont(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_cont(value, 0.99) AS DOUBLE) AS p99 FROM events")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_percentile(table(spark, d, "events"), "value", [0.5, 0.99])


@query("SELECT project_uuid, CAST(count(*) AS BIGINT) AS n_vectors FROM cv GROUP BY 1", CV)
def count_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return B.vectors(spark, d).groupBy("project_uuid").agg(F.count(F.lit(1)).alias("n_vectors"))


@query("SELECT id, array_to_string(list_sort(coalesce(TRY_CAST(TRY_CAST(tags AS JSON) AS VARCHAR[]), [])), ',') AS tags FROM cn", CN)
def parsed_tags(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).select("id", F.array_join(F.array_sort(R.parsed_tags(F.col("tags"))), ",").alias("tags"))


# --- search --------------------------------------------------------------------

_TOKENS = """tk AS (SELECT *, list_filter(string_split_regex(strip_accents(lower(coalesce(label, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tl,
  list_filter(string_split_regex(strip_accents(lower(coalesce(tags, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tt,
  list_filter(string_split_regex(strip_accents(lower(coalesce(summary, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ts FROM cn)"""


def _hits_sql(phrase: str) -> str:
    words = phrase.split()
    n = len(words)

    def one(c: str) -> str:
        test = " AND ".join(f"{c}[i + {k}] = '{w}'" for k, w in enumerate(words))
        return f"len(list_filter(range(1, len({c}) - {n - 2}), lambda i: {test}))"

    return " + ".join(f"({one(c)})" for c in ("tl", "tt", "ts"))


def _text_ctes(phrase: str, where: str = "TRUE", limit: int = 20, name: str = "tx") -> str:
    return f"""raw{name} AS (SELECT id, project_uuid, node_type, {_hits_sql(phrase)} AS f, len(tl) + len(tt) + len(ts) AS dl FROM tk),
top{name} AS (SELECT id, f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM raw{name}))) AS raw FROM raw{name} WHERE f > 0 AND {where} ORDER BY raw DESC, id LIMIT {limit}),
{name} AS (SELECT id, round(CAST(raw / (SELECT max(raw) FROM top{name}) AS DOUBLE), 4) AS bm25_score FROM top{name})"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return search.token_frame(B.nodes(spark, d).select("id", "project_uuid", "label", "tags", "summary", "node_type", "type"))


@query("SELECT id, bm25_score FROM tx", CN, _TOKENS, _text_ctes(WORD))
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return search.text_search(_tokens(spark, d), WORD)


@query("SELECT id, bm25_score FROM tx", CN, _TOKENS, _text_ctes(PHRASE, limit=50))
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return search.text_search(_tokens(spark, d), PHRASE, limit=50)


@query("SELECT id, bm25_score FROM tx", CN, CP, _TOKENS, _text_ctes(WORD, f"project_uuid = {AP}"))
def text_search_in_project(spark: SparkSession, d: str) -> DataFrame:
    return search.text_search(_tokens(spark, d), WORD, B.anchor_project(spark, d))


@query(f"SELECT id, label, type, project_uuid, CAST(CASE type WHEN 'class' THEN 1 WHEN 'function' THEN 2 ELSE 3 END AS INTEGER) AS symbol_rank FROM tk WHERE type IN ('class', 'function', 'method') AND {_hits_sql(SYMBOL)} > 0 ORDER BY symbol_rank, id LIMIT 50", CN, _TOKENS)
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    return search.symbol_search(_tokens(spark, d), SYMBOL)


_QV = "(SELECT CAST(embedding AS DOUBLE[]) FROM cv WHERE len(embedding) = 384 ORDER BY node_id LIMIT 1)"
_COS = """sc AS (SELECT node_id, project_uuid, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS s FROM cv, (SELECT """ + _QV + """ AS qv)
  WHERE len(embedding) = 384 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
vs AS (SELECT node_id, project_uuid, round(greatest(s, 0.0), 4) AS vector_score FROM sc)"""


@query("SELECT node_id, vector_score FROM vs ORDER BY vector_score DESC, node_id LIMIT 10", CV, _COS)
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    return search.vector_search(B.vectors(spark, d), B.query_vector(spark, d))


@query("SELECT node_id, vector_score FROM vs WHERE project_uuid IN (SELECT uuid FROM cp WHERE primary_wing = (SELECT primary_wing FROM cp WHERE uuid = " + AP + ")) ORDER BY vector_score DESC, node_id LIMIT 10", CV, CP, _COS)
def vector_search_in_scope(spark: SparkSession, d: str) -> DataFrame:
    scope = search.scoped_projects(B.projects(spark, d), None, B.anchor_project(spark, d))
    return search.vector_search(search.prefiltered(B.vectors(spark, d), scope), B.query_vector(spark, d))


@query("SELECT uuid AS project_uuid, folder_name, updated_at FROM cp WHERE primary_wing = (SELECT primary_wing FROM cp WHERE uuid = " + AP + ")", CP)
def scoped_projects(spark: SparkSession, d: str) -> DataFrame:
    return search.scoped_projects(B.projects(spark, d), None, B.anchor_project(spark, d))


@query("SELECT uuid AS project_uuid, folder_name FROM cp WHERE uuid <> " + AP + " AND primary_wing = (SELECT primary_wing FROM cp WHERE uuid = " + AP + ") ORDER BY updated_at DESC, uuid LIMIT 5", CP)
def similar_projects(spark: SparkSession, d: str) -> DataFrame:
    a = B.anchor_project(spark, d)
    return graph.similar_projects(search.scoped_projects(B.projects(spark, d), None, a), a).select("project_uuid", "folder_name")


def _recency_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0.01 ELSE greatest(exp(-ln(2.0) / 7.0 * greatest((epoch_us({T}) - epoch_us({c})) / 8.64e10, 0.0)), 0.01) END"


_HYBRID = f"""mg AS (SELECT coalesce(v.node_id, t.id) AS node_id, coalesce(v.vector_score, 0.0) AS v, coalesce(t.bm25_score, 0.0) AS f
  FROM (SELECT node_id, max(vector_score) AS vector_score FROM (SELECT * FROM vs ORDER BY vector_score DESC, node_id LIMIT 30) GROUP BY 1) v FULL JOIN tx t ON t.id = v.node_id),
hy AS (SELECT m.node_id, m.v, m.f, {_recency_sql('n.last_commit_at')} AS r, CAST(least(coalesce(g.n, 0) / 10.0, 1.0) AS DOUBLE) AS c
  FROM mg m LEFT JOIN cn n ON n.id = m.node_id LEFT JOIN (SELECT target_id, count(*) AS n FROM ce GROUP BY 1) g ON g.target_id = m.node_id),
hs AS (SELECT node_id, round(0.5 * v + 0.25 * f + 0.25 * greatest(r, c) + 1e-9, 4) AS score_final, c >= 1.0 AS is_super_node FROM hy ORDER BY score_final DESC, node_id LIMIT 10)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid_search(B.nodes(spark, d), B.edges(spark, d), B.vectors(spark, d), WORD, B.query_vector(spark, d), B.now())


@query("SELECT node_id, score_final, is_super_node FROM hs", CN, CE, CV, _TOKENS, _text_ctes(WORD), _COS, _HYBRID)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship query."""
    return _hybrid(spark, d).select("node_id", "score_final", "is_super_node")


@query("SELECT h.node_id, h.score_final, n.label, n.summary FROM hs h JOIN cn n ON n.id = h.node_id", CN, CE, CV, _TOKENS, _text_ctes(WORD), _COS, _HYBRID)
def hybrid_search_enriched(spark: SparkSession, d: str) -> DataFrame:
    return search.enriched(_hybrid(spark, d), B.nodes(spark, d)).select("node_id", "score_final", "label", "summary")


@query("SELECT node_id, score_final FROM (SELECT * FROM hs ORDER BY score_final DESC, node_id LIMIT 5) WHERE score_final >= 0.3 * (SELECT max(score_final) FROM hs)", CN, CE, CV, _TOKENS, _text_ctes(WORD), _COS, _HYBRID)
def reranked(spark: SparkSession, d: str) -> DataFrame:
    return search.rerank(_hybrid(spark, d).select("node_id", "score_final"))


@query(
    f"SELECT t.id AS node_id, round(0.25 * t.bm25_score + 0.25 * greatest({_recency_sql('n.last_commit_at')}, CAST(least(coalesce(g.n, 0) / 10.0, 1.0) AS DOUBLE)) + 1e-9, 4) AS score_final FROM tx t JOIN cn n ON n.id = t.id LEFT JOIN (SELECT target_id, count(*) AS n FROM ce GROUP BY 1) g ON g.target_id = t.id ORDER BY score_final DESC, node_id LIMIT 10",
    CN, CE, _TOKENS, _text_ctes(WORD),
)
def text_only_search(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid_search(B.nodes(spark, d), B.edges(spark, d), None, WORD, None, B.now()).select("node_id", "score_final")


@query()
def thompson_search(spark: SparkSession, d: str) -> DataFrame:
    u = facts.with_feedback(B.facts(spark, d), _feedback(spark, d)).select(F.col("id").alias("node_id"), "utility_alpha", "utility_beta")
    return search.thompson(_hybrid(spark, d).select("node_id", "score_final"), u, seed=42)


@query("SELECT v.doc_id AS id, round(v.s, 4) AS score FROM (SELECT cv.doc_id, sc.s, cv.node_id FROM sc JOIN cv ON cv.node_id = sc.node_id ORDER BY s DESC, cv.doc_id LIMIT 30) v JOIN cn n ON n.id = v.node_id AND n.status = 'ACTIVE'", CN, CV, _COS)
def self_healed_search(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d)
    s = v.select(F.col("doc_id").alias("id"), scoring.cosine(F.col("embedding"), F.lit(B.query_vector(spark, d))).alias("score")).where("score is not null")
    top = s.orderBy(F.desc("score"), "id").limit(30).withColumn("score", F.round("score", 4))
    live = B.nodes(spark, d).where("status = 'ACTIVE'").select(F.concat(F.lit("node_"), F.col("id").cast("string")).alias("path"))
    return search.self_healed(top, live)


# --- graph -----------------------------------------------------------------------


def _tree_sql(a: str, b: str) -> tuple[str, str]:
    return (
        "SELECT DISTINCT t.id, n.label, n.node_type, CAST(t.depth AS INTEGER) AS depth FROM t JOIN cn n ON n.id = t.id",
        f"t AS (SELECT {AN} AS id, 0 AS depth UNION SELECT e.{b}, t.depth + 1 FROM t JOIN ce e ON e.{a} = t.id JOIN cn n ON n.id = e.{b} WHERE t.depth < 6)",
    )


@query(_tree_sql("source_id", "target_id")[0], CN, CE, _tree_sql("source_id", "target_id")[1], recursive=True)
def dependency_tree(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_tree(B.nodes(spark, d), B.edges(spark, d), B.anchor_node(spark, d), 6)


@query(_tree_sql("target_id", "source_id")[0], CN, CE, _tree_sql("target_id", "source_id")[1], recursive=True)
def reverse_dependency_tree(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_tree(B.nodes(spark, d), B.edges(spark, d), B.anchor_node(spark, d), 6, reverse=True)


@query(
    f"SELECT DISTINCT node FROM c WHERE node <> CAST({AN} AS VARCHAR)",
    CE, f"c AS (SELECT CAST(target_id AS VARCHAR) AS node, 1 AS depth FROM ce WHERE source_id = {AN} UNION SELECT CAST(e.target_id AS VARCHAR), c.depth + 1 FROM c JOIN ce e ON CAST(e.source_id AS VARCHAR) = c.node WHERE c.depth < 5)", recursive=True,
)
def call_chain(spark: SparkSession, d: str) -> DataFrame:
    e = B.edges(spark, d).select(F.col("source_id").cast("string").alias("parent_node"), F.col("target_id").cast("string").alias("child_node"))
    return graph.call_chain(e, str(B.anchor_node(spark, d)), 5)


@query(
    "SELECT DISTINCT anchor_id, member_id FROM m",
    CN, CE,
    """an AS (SELECT n.id, n.project_uuid FROM cn n JOIN (SELECT target_id FROM ce GROUP BY 1 HAVING count(*) >= 10) g ON g.target_id = n.id WHERE n.status = 'ACTIVE'),
st AS (SELECT DISTINCT b.f, b.t, n.project_uuid FROM (SELECT source_id AS f, target_id AS t FROM ce UNION ALL SELECT target_id, source_id FROM ce) b JOIN cn n ON n.id = b.t WHERE b.f <> b.t AND n.status = 'ACTIVE'),
m AS (SELECT id AS anchor_id, id AS member_id, project_uuid, 0 AS hop FROM an UNION SELECT m.anchor_id, s.t, m.project_uuid, m.hop + 1 FROM m JOIN st s ON s.f = m.member_id AND s.project_uuid = m.project_uuid WHERE m.hop < 5)""",
    recursive=True,
)
def communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(B.nodes(spark, d), B.edges(spark, d))


@query("SELECT CASE WHEN regexp_matches(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE 'root' END AS community_id, CAST(count(*) AS BIGINT) AS n_files FROM cf GROUP BY 1", CF)
def natural_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.natural_communities(B.files(spark, d)).groupBy("community_id").agg(F.count(F.lit(1)).alias("n_files"))


@query(
    """SELECT DISTINCT source_id, target_id FROM (
SELECT di.dir_id AS source_id, fi.file_id AS target_id FROM fi JOIN di ON di.project_uuid = fi.project_uuid AND di.dir = fi.dir
UNION ALL SELECT coalesce(fi.file_id, di.dir_id), s.id FROM sy s LEFT JOIN fi ON fi.project_uuid = s.project_uuid AND fi.path = s.path LEFT JOIN di ON di.project_uuid = s.project_uuid AND di.dir = s.dir) WHERE source_id IS NOT NULL""",
    CN,
    """pa AS (SELECT id, project_uuid, type, split_part(label, '::', 1) AS path, contains(label, '::') AS inn FROM cn WHERE label IS NOT NULL),
pd AS (SELECT *, CASE WHEN regexp_matches(replace(path, '\\', '/'), '.+/') THEN regexp_extract(replace(path, '\\', '/'), '^(.*)/[^/]*$', 1) ELSE '<root>' END AS dir FROM pa),
fi AS (SELECT project_uuid, path, any_value(dir) AS dir, min(id) AS file_id FROM pd WHERE NOT inn AND type = 'file' GROUP BY 1, 2),
di AS (SELECT project_uuid, label AS dir, min(id) AS dir_id FROM cn WHERE type = 'directory' GROUP BY 1, 2),
sy AS (SELECT * FROM pd WHERE inn)""",
)
def containment_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.containment_edges(B.nodes(spark, d)).select("source_id", "target_id")


@query(
    """SELECT DISTINCT c.source_id, coalesce(h.id, a.id) AS target_id FROM ca c LEFT JOIN (SELECT path, name, min(id) AS id FROM sy GROUP BY 1, 2) h ON h.path = c.path AND h.name = c.callee
LEFT JOIN (SELECT name, min(id) AS id FROM sy GROUP BY 1) a ON a.name = c.callee WHERE coalesce(h.id, a.id) <> c.source_id""",
    CC, "sy AS (SELECT chunk_id AS id, source_file AS path, symbol_name AS name FROM cc)", "ca AS (SELECT chunk_id AS source_id, source_file AS path, unnest(list_append(calls, symbol_name)) AS callee FROM cc)",
)
def call_targets(spark: SparkSession, d: str) -> DataFrame:
    c = B.chunks(spark, d)
    symbols = c.select(F.col("chunk_id").alias("node_id"), F.col("source_file").alias("path"), F.col("symbol_name").alias("name"))
    calls = c.select(F.col("chunk_id").alias("source_id"), F.col("source_file").alias("path"), F.explode(F.array_append("calls", F.col("symbol_name"))).alias("callee"))
    return graph.call_targets(symbols, calls)


# --- delta and reconciliation -----------------------------------------------------


@query("SELECT f.file_id, h.id IS NULL AS is_new, h.id AS existing_node_id FROM cf f LEFT JOIN (SELECT project_uuid, file_hash, min(id) AS id FROM cn WHERE file_hash IS NOT NULL GROUP BY 1, 2) h ON h.project_uuid = f.pkey AND h.file_hash = f.file_hash", CN, CF)
def file_delta(spark: SparkSession, d: str) -> DataFrame:
    f = B.files(spark, d).select("file_id", "project_uuid", "file_hash")
    return delta.file_delta(f, B.nodes(spark, d)).select("file_id", "is_new", "existing_node_id")


@query("SELECT id, project_uuid, label FROM cn WHERE lower(coalesce(type, '')) NOT IN ('directory', 'cluster', 'project', 'insight') AND coalesce(label, '') <> '' AND NOT EXISTS (SELECT 1 FROM cf WHERE cf.pkey = cn.project_uuid AND cf.path = split_part(cn.label, '::', 1))", CN, CF)
def deleted_file_nodes(spark: SparkSession, d: str) -> DataFrame:
    return delta.deleted_file_nodes(B.nodes(spark, d), B.files(spark, d))


@query("SELECT c.chunk_id, k.id IS NOT NULL AS cached FROM cc c LEFT JOIN (SELECT project_uuid, label, content, min(id) AS id FROM cn WHERE content <> '' GROUP BY 1, 2, 3) k ON k.project_uuid = lower(trim(c.project_uuid)) AND k.label = c.source_file || '::' || c.symbol_name AND k.content = c.content", CN, CC)
def cached_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = B.chunks(spark, d).select("chunk_id", F.lower(F.trim("project_uuid")).alias("project_uuid"), F.concat("source_file", F.lit("::"), "symbol_name").alias("label"), "content")
    return delta.cached_chunks(c, B.nodes(spark, d)).select("chunk_id", "cached")


@query("SELECT doc_id, node_id FROM cv WHERE node_id IS NULL OR node_id NOT IN (SELECT id FROM cn WHERE id % 13 <> 0)", CN, CV)
def orphan_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that are orphans once every thirteenth node is gone."""
    return delta.orphan_vectors(B.vectors(spark, d), B.nodes(spark, d).where("id % 13 <> 0"))


@query("SELECT id, project_uuid, label FROM cn WHERE status = 'ACTIVE' AND content <> '' AND id NOT IN (SELECT node_id FROM cv WHERE node_id IS NOT NULL)", CN, CV)
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    return delta.missing_vectors(B.nodes(spark, d), B.vectors(spark, d))


@query("SELECT source_id, target_id, relation_type FROM ce WHERE source_id NOT IN (SELECT id FROM cn WHERE project_uuid = " + AP + ") AND target_id NOT IN (SELECT id FROM cn WHERE project_uuid = " + AP + ")", CN, CE, CP)
def edges_after_project_delete(spark: SparkSession, d: str) -> DataFrame:
    t = {"nodes": B.nodes(spark, d), "edges": B.edges(spark, d), "projects": B.projects(spark, d)}
    return delta.without_project(t, B.anchor_project(spark, d))["edges"].select("source_id", "target_id", "relation_type")


@query(
    "SELECT id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: regexp_matches(x, '^(def |class |import |from )')), chr(10))) AS ssh FROM cn WHERE content IS NOT NULL", CN
)
def signature_hashes(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).where("content is not null").select("id", text.signature_hash(F.col("content")).alias("ssh"))


@query("SELECT id, 'community_' || split_part(label, '::', 1) AS community, nullif(split_part(label, '::', 2), '') AS symbol FROM cn", CN)
def label_parts(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).select("id", F.concat(F.lit("community_"), text.label_path(F.col("label"))).alias("community"), text.label_symbol(F.col("label")).alias("symbol"))


@query("SELECT id, CAST(greatest(1, length(content) // 4) AS INTEGER) AS tokens FROM cn WHERE content IS NOT NULL", CN)
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).where("content is not null").select("id", text.token_estimate(F.col("content")).alias("tokens"))


@query(f"SELECT id, round({_recency_sql('last_commit_at')}, 6) AS recency FROM cn", CN)
def recency(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).select("id", F.round(scoring.recency(F.col("last_commit_at"), B.now()), 6).alias("recency"))


@query("SELECT id, '<!-- DATA_DO_NOT_EXECUTE:' || chr(10) || replace(content, '-->', '-- >') || chr(10) || '-->' AS armored FROM cn WHERE content IS NOT NULL", CN)
def armored_contents(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).where("content is not null").select("id", text.armored(F.col("content")).alias("armored"))


@query(
    r"""SELECT id, '[DUMB] ' || CASE WHEN length(t) > 200 THEN regexp_replace(substring(t, 1, 200), ' [^ ]*$', '') || '...' ELSE t END AS summary
FROM (SELECT id, array_to_string(list_filter(string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(x) <> ''), chr(10)) AS t FROM cn WHERE content IS NOT NULL)""",
    CN,
)
def extractive_summaries(spark: SparkSession, d: str) -> DataFrame:
    return B.nodes(spark, d).where("content is not null").select("id", text.extractive_summary(F.col("content"), 50).alias("summary"))


@query()
def detected_tags(spark: SparkSession, d: str) -> DataFrame:
    return B.chunks(spark, d).select("chunk_id", F.array_join(text.detected_tags(F.col("content"), F.col("category")), ",").alias("tags"))


@query()
def chunked_files(spark: SparkSession, d: str) -> DataFrame:
    f = B.files(spark, d).where("existing_node_id is not null").select("project_uuid", "relative_path", "file_hash", "category", F.col("existing_node_id").alias("id"))
    return chunking.chunk_files(f.join(B.nodes(spark, d).select("id", "content"), "id"))


@query()
def embedded_nodes(spark: SparkSession, d: str) -> DataFrame:
    return embed.vectors_of(B.nodes(spark, d)).select("doc_id", "node_id", F.size("embedding").alias("dim"))


_L1 = """d AS (SELECT *, CASE WHEN regexp_matches(replace(source_file, '\\', '/'), '.+/') THEN regexp_extract(replace(source_file, '\\', '/'), '^(.*)/[^/]*$', 1) ELSE '<root>' END AS dir FROM cc),
g AS (SELECT dir, count(*) AS n FROM d GROUP BY 1),
h AS (SELECT dir, count(DISTINCT tag) AS k FROM (SELECT dir, unnest(detected_tags) AS tag FROM d) WHERE tag IN ({tags}) GROUP BY 1)"""


@query(
    "SELECT g.dir AS source_label, CAST(g.n AS BIGINT) AS source_chunks, round(0.4 * least(1.0, g.n / 10.0) + 0.4 * least(1.0, coalesce(h.k, 0) / 3.0), 3) AS relevance_score FROM g LEFT JOIN h ON h.dir = g.dir",
    CC, _L1.format(tags=", ".join(f"'{t}'" for t in text.HIGH_PRIORITY_TAGS)),
)
def directory_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = B.chunks(spark, d).select(F.col("source_file").alias("source_label"), "content", "detected_tags")
    l1 = summarise.summarise_directories(summarise.summarise_chunks(c.withColumn("content", F.coalesce("content", F.lit("")))))
    return l1.select("source_label", "source_chunks", "relevance_score")


# --- facts, memory, audit, maintenance ---------------------------------------------


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("fact_id"), (F.col("event_type") == "purchase").alias("was_useful"))


@query("SELECT id, scope_id, fact_statement FROM fa WHERE t_invalid IS NULL", FA)
def active_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.active_facts(B.facts(spark, d)).select("id", "scope_id", "fact_statement")


@query("SELECT id, scope_id, fact_statement FROM fa WHERE t_valid <= TIMESTAMP '2024-01-15' AND (t_invalid IS NULL OR t_invalid > TIMESTAMP '2024-01-15')", FA)
def facts_as_of(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts_as_of(B.facts(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("id", "scope_id", "fact_statement")


@query("SELECT id, fact_statement FROM fa WHERE scope_id = '7'", FA)
def fact_history(spark: SparkSession, d: str) -> DataFrame:
    return facts.fact_history(B.facts(spark, d), "user", " 7 ").select("id", "fact_statement")


@query("SELECT event_id AS id, CAST(1 + (event_type = 'purchase')::INT AS DOUBLE) AS utility_alpha, CAST(1 + (event_type <> 'purchase')::INT AS DOUBLE) AS utility_beta FROM events")
def fact_utilities(spark: SparkSession, d: str) -> DataFrame:
    return facts.with_feedback(B.facts(spark, d), _feedback(spark, d)).select("id", "utility_alpha", "utility_beta")


@query("SELECT scope_id, block_label, id FROM (SELECT CAST(user_id AS VARCHAR) AS scope_id, event_type AS block_label, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def core_memory(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.lit("user").alias("scope_type"), F.col("user_id").cast("string").alias("scope_id"), F.col("event_type").alias("block_label"), F.col("props").alias("content"), F.col("ts").alias("updated_at")
    )
    return facts.core_memory(log).select("scope_id", "block_label", "id")


@query("SELECT session_id, checkpoint_id, seq FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS checkpoint_id, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(
        F.lit("agent").alias("agent_id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("checkpoint_id"), F.col("props").alias("state_blob"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq")
    )
    return facts.checkpoints(log).select("session_id", "checkpoint_id", "seq")


@query(f"SELECT id, CASE WHEN status = 'ACTIVE' AND (epoch_us({T}) - epoch_us(last_accessed)) / 8.64e10 > 60 THEN 'ARCHIVED' ELSE status END AS status FROM cn", CN)
def archived_nodes(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.archived(B.nodes(spark, d), B.now()).select("id", "status")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND (epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate)) / 8.64e10 > 30 THEN 'STALE' WHEN o_orderstatus = 'O' THEN 'ACTIVE' ELSE 'RESOLVED' END AS status FROM orders")
def decayed_trajectories(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("RESOLVED").alias("status"), F.col("o_orderdate").alias("created_at"))
    return maintenance.decayed(t, F.lit("1998-01-01 00:00:00").cast("timestamp")).select("id", "status")


@query(
    "SELECT doc_id, CASE WHEN tx = '' THEN 'changes are blank' WHEN length(tx) < 10 THEN 'changes are too short' WHEN project_uuid IS NULL THEN 'pointers are missing' WHEN trim(project_uuid) = '' THEN 'a pointer is blank' ELSE 'OK' END AS reason FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS tx FROM documents)"
)
def audited_drafts(spark: SparkSession, d: str) -> DataFrame:
    pointers = F.when(F.col("project_uuid").isNotNull(), F.array("project_uuid")).otherwise(F.array().cast("array<string>"))
    drafts = table(spark, d, "documents").select("doc_id", F.col("text").alias("technical_changes"), pointers.alias("updated_pointers"))
    return audit.audited(drafts).select("doc_id", "reason")


@query(
    "SELECT e.source_id, e.target_id, r.a <= r.b AS safe FROM ce e JOIN cn s ON s.id = e.source_id JOIN cn t ON t.id = e.target_id JOIN cp p ON p.uuid = s.project_uuid JOIN cp q ON q.uuid = t.project_uuid, LATERAL (SELECT CASE p.privacy_level WHEN 'INTERNAL' THEN 1 WHEN 'RESTRICTED' THEN 2 ELSE 0 END AS a, CASE q.privacy_level WHEN 'INTERNAL' THEN 1 WHEN 'RESTRICTED' THEN 2 ELSE 0 END AS b) r",
    CN, CE, CP,
)
def privacy_flows(spark: SparkSession, d: str) -> DataFrame:
    n = B.nodes(spark, d).select("id", "project_uuid").join(B.projects(spark, d).select(F.col("uuid").alias("project_uuid"), "privacy_level"), "project_uuid")
    e = B.edges(spark, d).select("source_id", "target_id")
    e = e.join(n.select(F.col("id").alias("source_id"), F.col("privacy_level").alias("a")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("privacy_level").alias("b")), "target_id")
    return e.select("source_id", "target_id", audit.is_safe_flow(F.col("a"), F.col("b")).alias("safe"))


@query("SELECT id, status AS old_status, to_ AS new_status, (status, to_) IN (('ACTIVE', 'STALE'), ('ACTIVE', 'ARCHIVED'), ('STALE', 'ACTIVE'), ('STALE', 'ARCHIVED')) AS allowed FROM cn, (VALUES ('ACTIVE'), ('STALE'), ('ARCHIVED'), ('GONE')) AS v(to_)", CN)
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    n = B.nodes(spark, d)
    return audit.status_changes(n, n.select("id", F.explode(F.array(*map(F.lit, ("ACTIVE", "STALE", "ARCHIVED", "GONE")))).alias("new_status")))


@query(
    "SELECT p.uuid AS project_uuid, CASE WHEN trim(coalesce(p.summary, '')) <> '' THEN p.summary ELSE 'Project ' || p.folder_name || ' holds ' || coalesce(n.n, 0) || ' nodes and ' || coalesce(e.n, 0) || ' edges.' END AS resume FROM cp p LEFT JOIN (SELECT project_uuid, count(*) AS n FROM cn GROUP BY 1) n ON n.project_uuid = p.uuid LEFT JOIN (SELECT s.project_uuid, count(*) AS n FROM ce JOIN cn s ON s.id = ce.source_id GROUP BY 1) e ON e.project_uuid = p.uuid",
    CN, CE, CP,
)
def resumes(spark: SparkSession, d: str) -> DataFrame:
    p = B.projects(spark, d)
    return facade.resume(p, R.project_stats(p, B.nodes(spark, d), B.edges(spark, d)))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    return watch.windowed_counts(table(spark, d, "events"), "1 day", "1 hour", ["event_type"])


@query(
    "SELECT user_id, min(ts) AS session_start, CAST(count(*) AS BIGINT) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return watch.sessions(table(spark, d, "events"), "30 minutes", "1 hour", "user_id").drop("session_end")


# --- writes, sources and composites ---------------------------------------------------


@query("SELECT id, bm25_score FROM tx", CN, _TOKENS, _text_ctes(WORD, "node_type = 'FACT'"))
def text_search_of_type(spark: SparkSession, d: str) -> DataFrame:
    return search.text_search(_tokens(spark, d), WORD, node_type="FACT")


def _category_sql() -> str:
    whens = " ".join(f"WHEN e IN ({', '.join(repr(x) for x in kinds)}) THEN '{c}'" for c, kinds in crawl.EXTENSIONS.items())
    return f"SELECT file_id, CASE {whens} ELSE 'unknown' END AS category FROM (SELECT file_id, regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1) AS e FROM cf)"


@query(_category_sql(), CF)
def classified_files(spark: SparkSession, d: str) -> DataFrame:
    return B.files(spark, d).select("file_id", crawl.category(F.col("path")).alias("category"))


@query()
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    rules = IgnoreRules().add(["docs/", "*.sql", "!important.sql", "tests/**/*.py"])
    return B.files(spark, d).select("file_id", rules.column(F.col("path")).alias("ignored"))


_PRIVATE = "privacy_level IN ('PUBLIC', 'INTERNAL', 'RESTRICTED')"


@query(
    f"SELECT 'projects' AS table_name, CAST(count(*) AS BIGINT) AS n_valid FROM cp WHERE {_PRIVATE} UNION ALL SELECT 'nodes', count(*) FROM cn WHERE project_uuid IS NOT NULL AND label IS NOT NULL AND node_type IN ({', '.join(map(repr, NODE_TYPES))}) AND status IN ('ACTIVE', 'STALE', 'ARCHIVED') UNION ALL SELECT 'edges', count(*) FROM ce WHERE confidence_tag IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS')",
    CN, CE, CP,
)
def valid_rows(spark: SparkSession, d: str) -> DataFrame:
    parts = {"projects": B.projects(spark, d), "nodes": B.nodes(spark, d), "edges": B.edges(spark, d)}
    return R.table_counts({name: split_valid(df, name)[0] for name, df in parts.items()}).withColumnRenamed("n_rows", "n_valid")


def _commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits of their customers."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_uuid"), F.col("o_orderpriority").alias("phase"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_custkey AS project_uuid, o_orderkey AS id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5")
def recent_commits(spark: SparkSession, d: str) -> DataFrame:
    return facade.recent(_commits(spark, d)).select("project_uuid", "id", "rank")


@query("SELECT o_custkey AS project_uuid, o_orderpriority AS phase FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def last_phases(spark: SparkSession, d: str) -> DataFrame:
    return facade.last_phase(_commits(spark, d))


@query("SELECT (SELECT max(id) FROM cn) + row_number() OVER (ORDER BY doc_id) AS id, doc_id FROM documents", CN)
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.with_ids(table(spark, d, "documents").select("doc_id"), B.nodes(spark, d).select("id"), ["doc_id"])


@query("SELECT doc_id, CAST(len(embedding) AS INTEGER) AS dim, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last FROM (SELECT doc_id, embedding FROM cv WHERE embedding IS NOT NULL UNION ALL SELECT 'vec_' || vec_id, embedding FROM embeddings)", CV)
def vectors_after_upsert(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "embeddings").select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("doc_id"), "embedding")
    old = B.vectors(spark, d).select("doc_id", "embedding").where("embedding is not null")
    ends = [F.try_element_at("embedding", F.lit(i)).cast("double").alias(name) for i, name in ((1, "first"), (-1, "last"))]
    return snapshots.upsert_vectors(old, new).select("doc_id", F.size("embedding").alias("dim"), *ends)


@query(
    """SELECT p.uuid AS project_uuid, CAST(coalesce(n.n, 0) AS BIGINT) AS nodes, n.t AS by_type, CAST(coalesce(e.n, 0) AS BIGINT) AS edges, CAST(1 AS BIGINT) AS commits, p.primary_wing AS wings, p.privacy_level AS phase
FROM cp p LEFT JOIN (SELECT project_uuid, sum(k) AS n, string_agg(node_type || ':' || k, ',' ORDER BY node_type) AS t FROM (SELECT project_uuid, node_type, count(*) AS k FROM cn GROUP BY ALL) GROUP BY 1) n ON n.project_uuid = p.uuid
LEFT JOIN (SELECT s.project_uuid, count(*) AS n FROM ce JOIN cn s ON s.id = ce.source_id GROUP BY 1) e ON e.project_uuid = p.uuid""",
    CN, CE, CP,
)
def project_status(spark: SparkSession, d: str) -> DataFrame:
    """Projects stand for their own commit and wing."""
    p = B.projects(spark, d)
    commits = p.select(F.xxhash64("uuid").alias("id"), F.col("uuid").alias("project_uuid"), F.col("privacy_level").alias("phase"), "created_at")
    wings = p.select(F.col("uuid").alias("project_uuid"), F.col("primary_wing").alias("wing_name"))
    s = facade.status(p, B.nodes(spark, d), B.edges(spark, d), commits, wings)
    types = F.array_join(F.transform(F.map_entries("by_type"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return s.select("project_uuid", "nodes", types.alias("by_type"), "edges", "commits", F.array_join("wings", ",").alias("wings"), "phase")


@query(
    "SELECT path, CASE WHEN path % 3 = 0 THEN true WHEN path % 3 = 1 THEN false ELSE NULL END AS changed FROM (SELECT doc_id AS path FROM documents WHERE text IS NOT NULL)"
)
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Every third document gets a new declaration, every third only a new last line."""
    f = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    old = f.select("path", "content", text.signature_hash(F.col("content")).alias("ssh_hash"), F.lit(False).alias("is_dirty"), F.lit("root").alias("community_id"))
    end = F.when(F.col("path") % 3 == 0, "\ndef added(): pass").otherwise("\n# a remark")
    new = f.where("path % 3 < 2").select("path", F.concat("content", end).alias("content"), F.lit("root").alias("community_id"))
    return delta.changed_files(old, new).select("path", "changed")


#: The query set: the nodes whose id this number divides.
QUERY_STEP = 50


def query_set(spark: SparkSession, d: str) -> Iterator[tuple[int, str, list[float]]]:
    """All usable vectors of every ``QUERY_STEP``-th node id, each with the first two words of its node's label or summary.

    They come one partition at a time, so that the driver never holds all of them.
    """
    usable = (F.size("embedding") == 384) & ~F.exists("embedding", lambda x: x.isNull()) & F.exists("embedding", lambda x: x != 0)
    v = B.vectors(spark, d).where((F.col("node_id") % QUERY_STEP == 0) & usable).select("node_id", "embedding")
    words = B.nodes(spark, d).select(F.col("id").alias("node_id"), F.coalesce("summary", "label").alias("t"))
    rows = stage(v.join(words, "node_id", "left"), "queries")
    for r in rows.toLocalIterator():
        yield r["node_id"], " ".join(batch_search.phrase_words(r["t"])[:2]), list(r["embedding"])


_BATCH = f"""qs AS (SELECT v.node_id AS query_id, CAST(v.embedding AS DOUBLE[]) AS e, list_filter(string_split_regex(strip_accents(lower(coalesce(n.summary, n.label, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')[1:2] AS w
  FROM cv v LEFT JOIN cn n ON n.id = v.node_id WHERE v.node_id % {QUERY_STEP} = 0 AND len(v.embedding) = 384 AND list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) > 0),
bv AS (SELECT query_id, node_id, max(s) AS v FROM (SELECT q.query_id, v.node_id, round(greatest(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.e), 0.0), 4) AS s FROM qs q, cv v WHERE len(v.embedding) = 384 AND list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) > 0) GROUP BY query_id, node_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, node_id) <= 30),
bh AS (SELECT query_id, id, dl, {' + '.join(f"len(list_filter(range(1, len({c}) + 1), lambda i: {c}[i] = w[1] AND (len(w) = 1 OR {c}[i + 1] = w[2])))" for c in ('tl', 'tt', 'ts'))} AS f FROM qs, (SELECT id, tl, tt, ts, len(tl) + len(tt) + len(ts) AS dl FROM tk) WHERE len(w) > 0),
br AS (SELECT query_id, id, f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(len(tl) + len(tt) + len(ts)) FROM tk))) AS raw FROM bh WHERE f > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, id) <= 20),
bt AS (SELECT query_id, id AS node_id, round(CAST(raw / max(raw) OVER (PARTITION BY query_id) AS DOUBLE), 4) AS t FROM br),
bm AS (SELECT query_id, node_id, coalesce(v, 0.0) AS v, coalesce(t, 0.0) AS t FROM bv FULL JOIN bt USING (query_id, node_id)),
bs AS (SELECT m.query_id, m.node_id, round(0.5 * m.v + 0.25 * m.t + 0.25 * greatest({_recency_sql('n.last_commit_at')}, CAST(least(coalesce(g.n, 0) / 10.0, 1.0) AS DOUBLE)) + 1e-9, 4) AS score_final
  FROM bm m LEFT JOIN cn n ON n.id = m.node_id LEFT JOIN (SELECT target_id, count(*) AS n FROM ce GROUP BY 1) g ON g.target_id = m.node_id)"""


@query("SELECT query_id, node_id, score_final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score_final DESC, node_id) AS INTEGER) AS rank FROM bs QUALIFY rank <= 10", CN, CE, CV, _TOKENS, _BATCH)
def hybrid_search_batch(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid queries of a whole query set in one plan."""
    return batch_search.hybrid_search_batch(B.nodes(spark, d), B.edges(spark, d), B.vectors(spark, d), query_set(spark, d), B.now())


# --- further writes and scalars --------------------------------------------------------


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'new_' || id ELSE file_hash END AS file_hash FROM cn", CN)
def hashes_after_update(spark: SparkSession, d: str) -> DataFrame:
    n = B.nodes(spark, d).select("id", "file_hash")
    u = n.where("id % 7 = 0").select("id", F.concat(F.lit("new_"), F.col("id").cast("string")).alias("file_hash"))
    return delta.with_new_hashes(n, u).select("id", "file_hash")


@query("SELECT id FROM cn WHERE NOT coalesce(project_uuid = " + AP + " AND (label = 'lib/common.py' OR starts_with(label, 'lib/common.py::')) AND (file_hash IS NULL OR file_hash <> 'h'), false)", CN, CP)
def nodes_without_obsolete(spark: SparkSession, d: str) -> DataFrame:
    return delta.without_obsolete(B.nodes(spark, d), B.anchor_project(spark, d), "lib/common.py", "h").select("id")


@query("SELECT doc_id FROM cv WHERE node_id % 5 <> 0", CV)
def vectors_after_delete(spark: SparkSession, d: str) -> DataFrame:
    v = B.vectors(spark, d).select("doc_id", "node_id")
    return access.delete_vectors(v, v.where("node_id % 5 = 0")).select("doc_id")


@query("SELECT DISTINCT node_id FROM cv WHERE node_id IS NOT NULL", CV)
def stored_node_ids(spark: SparkSession, d: str) -> DataFrame:
    return access.stored_node_ids(B.vectors(spark, d))


@query("SELECT id, CASE WHEN id % 11 = 0 THEN '2025-06-01' ELSE strftime(last_commit_at AT TIME ZONE 'UTC', '%Y-%m-%d') END AS day FROM cn", CN)
def touched_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = B.nodes(spark, d)
    return delta.touched(n, n.where("id % 11 = 0").select("id"), "last_commit_at", B.now()).select("id", F.date_format("last_commit_at", "yyyy-MM-dd").alias("day"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2025-06-01' ELSE t_invalid END IS NULL AS active FROM fa", FA)
def facts_after_invalidation(spark: SparkSession, d: str) -> DataFrame:
    f = B.facts(spark, d)
    return facts.invalidate_facts(f, f.where("id % 3 = 0").select("id"), B.now()).select("id", F.col("t_invalid").isNull().alias("active"))


@query("SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY uuid) AS id, uuid AS scope_id FROM cp", CP)
def inserted_facts(spark: SparkSession, d: str) -> DataFrame:
    new = B.projects(spark, d).select(F.lit("org").alias("scope_type"), F.col("uuid").alias("scope_id"), F.lit("is registered").alias("fact_statement"))
    return facts.insert_facts(B.facts(spark, d), new, B.now()).where("scope_type = 'org'").select("id", "scope_id")


@query("SELECT file_id, regexp_extract(path, '[^/]*$') AS name, project_uuid IS NOT NULL AND regexp_matches(lower(project_uuid), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') AS is_uuid FROM cf", CF)
def path_names(spark: SparkSession, d: str) -> DataFrame:
    return B.files(spark, d).select("file_id", text.basename(F.col("relative_path")).alias("name"), F.coalesce(text.is_uuid(F.col("project_uuid")), F.lit(False)).alias("is_uuid"))


@query("SELECT p.uuid, coalesce(w.wing, p.primary_wing) AS primary_wing FROM cp p LEFT JOIN (" + _wing_sql()[0] + ") w ON w.project_uuid = p.uuid", CN, CP, _wing_sql()[1])
def categorised_projects(spark: SparkSession, d: str) -> DataFrame:
    return facade.categorised(B.projects(spark, d), B.nodes(spark, d)).select("uuid", "primary_wing")


@query("SELECT uuid AS project_uuid FROM cp WHERE primary_wing IN (SELECT primary_wing FROM cp WHERE uuid = " + AP + " UNION ALL SELECT max(primary_wing) FROM cp)", CP)
def scope_with_references(spark: SparkSession, d: str) -> DataFrame:
    p, a = B.projects(spark, d), B.anchor_project(spark, d)
    wings = p.agg(F.max("primary_wing").alias("wing_name")).select(F.lit(a).alias("project_uuid"), "wing_name")
    return search.scoped_projects(p, wings, a, include_references=True).select("project_uuid")


@query("SELECT doc_id FROM cv WHERE node_id IS NOT NULL AND node_id IN (SELECT id FROM cn) UNION SELECT 'node_' || id FROM cn WHERE status = 'ACTIVE' AND regexp_matches(content, '[\\p{L}\\p{N}]') AND id NOT IN (SELECT node_id FROM cv WHERE node_id IS NOT NULL)", CN, CV)
def synced_vectors(spark: SparkSession, d: str) -> DataFrame:
    return access.synced_vectors(B.nodes(spark, d), B.vectors(spark, d)).select("doc_id")


@query(
    "SELECT id, CASE WHEN k = 4 THEN NULL ELSE id END AS got FROM (SELECT event_id AS id, event_id % 5 AS k FROM events)"
)
def json_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies with an object bare, fenced, embedded, nested, and without one."""
    body = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"))
    k = F.col("event_id") % 5
    reply = (
        F.when(k == 0, F.concat(body, F.lit("}"))).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("}\n```"))).when(k == 2, F.concat(F.lit("so: "), body, F.lit("}.")))
        .when(k == 3, F.concat(body, F.lit(', "x": {"y": 1}}'))).otherwise(F.lit("no object"))
    )
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), text.json_object(reply).alias("j"))
    return e.select("id", F.get_json_object("j", "$.id").cast("long").alias("got"))


@query("SELECT dir AS id, string_agg(content, chr(10) ORDER BY source_file, chunk_id) AS text FROM (SELECT *, regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS dir FROM cc WHERE content IS NOT NULL) GROUP BY 1", CC)
def community_texts(spark: SparkSession, d: str) -> DataFrame:
    c = B.chunks(spark, d).where("content is not null")
    key = F.concat("source_file", F.lit("\u0001"), F.format_string("%020d", "chunk_id"))
    return summarise.community_text(c.select(key.alias("path"), "content", F.regexp_extract("source_file", "^(.*)/[^/]*$", 1).alias("community_id")))
