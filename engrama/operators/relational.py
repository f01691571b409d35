"""Scans, projections, aggregations and latest-row operators over the tables.

All functions take and return DataFrames.  Tables in which rows are delivered
again come through ``current`` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions import scoring
from engrama.functions.text import HIGH_PRIORITY_TAGS, parent_dir

DEFAULT_WING = "geral"
# Words by which a project's wing is recognised.
WING_WORDS = {
    "marketing/vendas": ("marketing", "venda", "copy", "cta", "conversão", "landing", "funil", "lead", "promo", "anúncio", "tráfego"),
    "finanças/quant": ("finança", "quant", "trade", "ação", "crypto", "investimento", "bolsa", "daytrade", "renda", "mercado", "carteira"),
    "gestão/saas": ("saas", "dashboard", "gestão", "erp", "admin", "painel", "plataforma", "multi-tenant", "subscription"),
    "automação/rh": ("automação", "excel", "planilha", "rh", "workflow", "zapier", "n8n", "integração", "bot"),
    "estatística": ("estatística", "análise", "dados", "média", "probabilidade", "regressão", "machine learning", "dataset"),
}


def current(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def current_nodes(nodes: DataFrame) -> DataFrame:
    return current(nodes, ["id"], [F.desc("loaded_at"), F.asc("label"), F.asc("status")])


def current_edges(edges: DataFrame) -> DataFrame:
    """One edge per ordered pair: what came last replaces the rest."""
    return current(edges, ["source_id", "target_id"], [F.desc("loaded_at"), F.desc("relation_type"), F.desc(F.coalesce("weight", F.lit(-1.0)))])


def current_projects(projects: DataFrame) -> DataFrame:
    return current(projects, ["uuid"], [F.desc("updated_at"), F.asc("folder_name")])


def current_vectors(vectors: DataFrame) -> DataFrame:
    """Per doc_id the row stored last; with ties the greater embedding."""
    return current(vectors, ["doc_id"], [F.desc("stored_at"), F.desc("embedding")])


def select_nodes(nodes: DataFrame, project: str | None = None, node_type: str | None = None, status: str | None = None) -> DataFrame:
    for column, value in (("project_uuid", project), ("node_type", node_type), ("status", status)):
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    return nodes


def find_project(projects: DataFrame, key: str) -> DataFrame:
    """The project with this uuid or folder name (the uuid first)."""
    hit = projects.where((F.col("uuid") == key) | (F.col("folder_name") == key))
    return hit.orderBy((F.col("uuid") == key).desc(), "uuid").limit(1)


def find_nodes_by_hash(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Files (project_uuid, file_hash, ...) with the smallest node id of the same hash, or null."""
    first = nodes.where("file_hash is not null").groupBy("project_uuid", "file_hash").agg(F.min("id").alias("node_id"))
    return files.join(first, ["project_uuid", "file_hash"], "left")


def parsed_tags(tags: Column) -> Column:
    """Tags out of JSON text; text that is no JSON array gives an empty list."""
    whole = F.when(F.try_parse_json(tags).isNotNull(), F.from_json(tags, "array<string>"))
    return F.coalesce(whole, F.array().cast("array<string>"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, centrality, is_super_node) for every node, zero included."""
    d = nodes.select("id").join(in_degree(edges), "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))
    c = scoring.centrality(F.col("in_degree"))
    return d.select("id", "in_degree", c.alias("centrality"), (c >= 1.0).alias("is_super_node"))


def super_nodes(nodes: DataFrame, edges: DataFrame, threshold: int = scoring.SUPER_NODE_DEGREE) -> DataFrame:
    """Active nodes with at least ``threshold`` incoming edges."""
    active = nodes.where("status = 'ACTIVE'").select("id", "project_uuid", "label")
    return active.join(in_degree(edges).where(F.col("in_degree") >= threshold), "id")


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project_uuid", "node_type").agg(F.count(F.lit(1)).alias("n_nodes"))


def project_stats(projects: DataFrame, nodes: DataFrame, edges: DataFrame, commits: DataFrame | None = None, trajectories: DataFrame | None = None) -> DataFrame:
    """Per project: nodes, active nodes, nodes by type, edges by source, commits, last commit, trajectories."""
    by_type = nodes.groupBy("project_uuid", "node_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ACTIVE").alias("a"))
    counts = by_type.groupBy("project_uuid").agg(
        F.sum("n").alias("nodes"),
        F.sum("a").alias("active_nodes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("node_type", "n")))).alias("by_type"),
    )
    e = edges.join(nodes.select(F.col("id").alias("source_id"), "project_uuid"), "source_id").groupBy("project_uuid").agg(F.count(F.lit(1)).alias("edges"))
    out = projects.select(F.col("uuid").alias("project_uuid"), "folder_name").join(counts, "project_uuid", "left").join(e, "project_uuid", "left")
    if commits is not None:
        c = commits.groupBy("project_uuid").agg(F.count(F.lit(1)).alias("commits"), F.max("created_at").alias("last_commit"))
        out = out.join(c, "project_uuid", "left")
    if trajectories is not None:
        out = out.join(trajectories.groupBy("project_uuid").agg(F.count(F.lit(1)).alias("trajectories")), "project_uuid", "left")
    return out.fillna(0, [c for c in ("nodes", "active_nodes", "edges", "commits", "trajectories") if c in out.columns])


def topology_nodes(nodes: DataFrame, project: str | None = None) -> DataFrame:
    return select_nodes(nodes, project, status="ACTIVE").select(F.col("id").alias("node_id"), F.col("label").alias("name"), "node_type")


def topology_edges(nodes: DataFrame, edges: DataFrame, project: str | None = None) -> DataFrame:
    """With a project, edges whose ends are both active in it; without one, all edges."""
    out = edges.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("relation_type").alias("edge_type"))
    if project is None:
        return out
    ids = topology_nodes(nodes, project).select("node_id")
    return out.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi").select("source", "target", "edge_type")


def implementation(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.where(F.col("id") == node_id).select("id", "label", "type", "summary", "content", "project_uuid")


def callers(nodes: DataFrame, edges: DataFrame, calls_only: bool = True) -> DataFrame:
    """(callee_id, id, label, type, relation_type): who points at each node."""
    e = edges.where("relation_type = 'calls'") if calls_only else edges
    return e.join(nodes.select("id", "label", "type"), e["source_id"] == F.col("id")).select(
        F.col("target_id").alias("callee_id"), "id", "label", "type", "relation_type"
    )


def adjacency(edges: DataFrame, node_ids: DataFrame, incoming: bool = False) -> DataFrame:
    """Edges that leave, or enter, the given nodes (id)."""
    return edges.join(node_ids.select(F.col("id").alias("target_id" if incoming else "source_id")), "target_id" if incoming else "source_id", "left_semi")


def project_listing(projects: DataFrame) -> DataFrame:
    """folder_name, uuid, day of the last update; of equal names the one updated last."""
    one = current(projects, ["folder_name"], [F.desc("updated_at"), F.desc("uuid")])
    return one.select("folder_name", "uuid", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


def category_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count(F.lit(1)).alias("n_files"))


def consolidated_tags(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct tags per key; tags are made distinct before they are gathered."""
    each = chunks.select(*keys, F.explode("detected_tags").alias("tag")).distinct()
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def clusters(summaries: DataFrame, path: str = "source_label") -> DataFrame:
    """Summaries per parent directory: cluster, texts in order of their path, tags, sizes."""
    d = summaries.withColumn("cluster", parent_dir(F.col(path), "<root>"))
    return d.groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col("summary").alias("s")))), lambda x: x["s"]).alias("summaries"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("detected_tags")))).alias("tags"),
        F.sum("source_chunks").alias("source_chunks"),
        F.bool_or("is_dumb_summary").alias("any_dumb"),
    )


def relevance(chunks: Column, tags: Column, any_dumb: Column) -> Column:
    """Share of size, of high-priority tags and of real summaries, rounded to three places."""
    high = F.size(F.array_intersect(tags, F.lit(list(HIGH_PRIORITY_TAGS))))
    return F.round(0.4 * F.least(F.lit(1.0), chunks / 10.0) + 0.4 * F.least(F.lit(1.0), high / 3.0) + F.when(any_dumb, F.lit(0.0)).otherwise(0.2), 3)


def wing_scores(texts: DataFrame) -> DataFrame:
    """(project_uuid, wing): the wing with most of its words in the project's texts.

    ``texts`` has project_uuid and text.  Words are looked for in every text, so
    a project's texts are never joined into one value; ties go to the first
    wing by name, and a project without any word to the default.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    flags = [(wing, k, F.contains(low, F.lit(word))) for wing, words in WING_WORDS.items() for k, word in enumerate(words)]
    seen = texts.groupBy("project_uuid").agg(*(F.max(hit.cast("int")).alias(f"w{i}") for i, (_, _, hit) in enumerate(flags)))
    score = {wing: sum((F.col(f"w{i}") for i, (w, _, _) in enumerate(flags) if w == wing), F.lit(0)) for wing in WING_WORDS}
    best = F.array_min(F.array(*(F.struct((-s).alias("s"), F.lit(w).alias("w")) for w, s in score.items())))
    return seen.select("project_uuid", F.when(best["s"] < 0, best["w"]).otherwise(F.lit(DEFAULT_WING)).alias("wing"))


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table_name, n_rows); -1 for a table that is missing."""
    parts = []
    spark = next(df for df in tables.values() if df is not None).sparkSession
    for name, df in tables.items():
        if df is None:
            parts.append(spark.sql(f"select '{name}' as table_name, -1L as n_rows"))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_percentile(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Linear interpolation between the closest ranks, one column per share."""
    return df.agg(*(F.percentile(column, F.lit(p)).alias(f"p{round(p * 100)}") for p in shares))
