"""Composite operators: projects, wake-up, commits, ingest and the action hooks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrama.functions.text import detected_tags
from engrama.operators import audit, chunking, delta, embed, facts, graph, relational, search, summarise
from engrama.sources import crawl as crawling
from engrama.sources import snapshots
from engrama.sources.ignore import IgnoreRules
from engrama.staging import stage


def register_project(projects: DataFrame, folder: str, now: Column, wing: str | None = None, privacy: str = "PUBLIC", summary: str | None = None) -> tuple[DataFrame, str]:
    """The projects and the uuid of the one with this uuid or folder name, added if there is none."""
    name = folder.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]
    known = relational.find_project(projects, folder).unionByName(relational.find_project(projects, name)).first()
    if known:
        return projects, known["uuid"]
    key = str(uuid.uuid4())
    row = projects.sparkSession.createDataFrame([(key, name, wing or relational.DEFAULT_WING, privacy, summary)], "uuid string, folder_name string, primary_wing string, privacy_level string, summary string")
    row = row.withColumn("created_at", now).withColumn("updated_at", now)
    return projects.unionByName(row, allowMissingColumns=True), key


def resume(projects: DataFrame, stats: DataFrame) -> DataFrame:
    """(project_uuid, resume): the stored summary, else a sentence out of the counts."""
    s = stats.select("project_uuid", "nodes", "edges")
    text = F.format_string("Project %s holds %d nodes and %d edges.", F.col("folder_name"), F.coalesce("nodes", F.lit(0)), F.coalesce("edges", F.lit(0)))
    stored = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("summary"))
    p = projects.select(F.col("uuid").alias("project_uuid"), "folder_name", "summary")
    return p.join(s, "project_uuid", "left").select("project_uuid", F.coalesce(stored, text).alias("resume"))


def recent(rows: DataFrame, per: str = "project_uuid", limit: int = 5, at: str = "created_at") -> DataFrame:
    """The latest ``limit`` rows of each project, newest first."""
    w = Window.partitionBy(per).orderBy(F.desc(at), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def last_phase(commits: DataFrame) -> DataFrame:
    return recent(commits, limit=1).select("project_uuid", "phase")


def status(projects: DataFrame, nodes: DataFrame, edges: DataFrame, commits: DataFrame, wings: DataFrame) -> DataFrame:
    """Per project: counts, its reference wings and its last phase."""
    stats = relational.project_stats(projects, nodes, edges, commits)
    w = wings.select("project_uuid", "wing_name").distinct().groupBy("project_uuid").agg(F.array_sort(F.collect_list("wing_name")).alias("wings"))
    return stats.join(w, "project_uuid", "left").join(last_phase(commits), "project_uuid", "left")


def wake_up(projects: DataFrame, nodes: DataFrame, edges: DataFrame, commits: DataFrame, wings: DataFrame, fact_rows: DataFrame) -> DataFrame:
    """Per project: status, resume, the last five commits and the active facts of its folder name."""
    st = stage(status(projects, nodes, edges, commits, wings), "status")
    five = recent(commits).groupBy("project_uuid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phase", "technical_changes"))), lambda x: F.struct(x["phase"].alias("phase"), x["technical_changes"].alias("changes"))).alias("last_commits"))
    f = facts.active_facts(fact_rows).where("scope_type = 'user'").groupBy(F.col("scope_id").alias("folder_name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "fact_statement"))), lambda x: x["fact_statement"]).alias("facts"))
    return st.join(resume(projects, st), "project_uuid").join(five, "project_uuid", "left").join(f, "folder_name", "left")


def commit_memory(commits: DataFrame, nodes: DataFrame, project: str, phase: str, changes: str, pointers: list[str], now: Column, node_ids: list[int] | None = None, approved: bool | None = None, partial: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Add a commit, with its audit flags, and stamp the nodes it names."""
    if not changes.strip() or not pointers:
        raise ValueError("a commit needs changes and pointers")
    spark = commits.sparkSession
    top = commits.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    row = spark.createDataFrame([(top + 1, project, phase, changes, pointers, approved, partial)], "id long, project_uuid string, phase string, technical_changes string, updated_pointers array<string>, revisor_approved boolean, partial_audit boolean").withColumn("created_at", now)
    if node_ids:
        nodes = delta.touched(nodes, spark.createDataFrame([(i,) for i in node_ids], "id long"), "last_commit_at", now)
    return commits.unionByName(row, allowMissingColumns=True), nodes


def lazy_load(nodes: DataFrame, edges: DataFrame, node_id: int, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with last_accessed stamped, the node, its outgoing edges)."""
    ids = nodes.sparkSession.createDataFrame([(node_id,)], "id long")
    return delta.touched(nodes, ids, "last_accessed", now), nodes.where(F.col("id") == node_id), relational.adjacency(edges, ids)


def categorised(projects: DataFrame, nodes: DataFrame) -> DataFrame:
    """Projects with the wing that their active labels, tags and summary speak for."""
    n = nodes.where("status = 'ACTIVE'")
    texts = n.select("project_uuid", F.concat_ws(" ", "label", "tags").alias("text")).unionByName(projects.select(F.col("uuid").alias("project_uuid"), F.col("summary").alias("text")))
    wings = relational.wing_scores(texts).withColumnRenamed("project_uuid", "uuid")
    return projects.join(wings, "uuid", "left").withColumn("primary_wing", F.coalesce("wing", "primary_wing")).drop("wing")


def add_wing(wings: DataFrame, projects: DataFrame, project: str, wing: str) -> DataFrame:
    """Reference wings with one more, unless it is there or is the project's own."""
    own = projects.where((F.col("uuid") == project) & (F.col("primary_wing") == wing))
    if not own.isEmpty():
        return wings
    row = wings.sparkSession.createDataFrame([(project, wing)], "project_uuid string, wing_name string")
    return wings.unionByName(row).dropDuplicates(["project_uuid", "wing_name"])


def remove_wing(wings: DataFrame, project: str, wing: str) -> DataFrame:
    return wings.where(~((F.col("project_uuid") == project) & (F.col("wing_name") == wing)))


def mine(
    spark: SparkSession, root: str, project: str, tables: dict[str, DataFrame], now: Column, rules: IgnoreRules | None = None, embedder: Callable = embed.hashed_embedding,
    call: Callable[[str], str] | None = None, auto_tag: bool = True,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Ingest a source tree: crawl, chunk, reuse, summarise, number, link, embed, collect garbage.

    Returns the tables ``nodes``, ``edges`` and ``vectors`` after it, and the crawl's
    report.  Nothing is parsed or summarised that has not changed; without a function
    ``call`` a summary is an extract.  With ``auto_tag`` nodes get the tags found in
    their text, and those the function gives.
    """
    nodes, edges, vectors = tables["nodes"], tables["edges"], tables["vectors"]
    files, gone, report = crawling.crawl(spark, root, project, nodes, rules, with_content=True)
    files = stage(files, "files")
    fresh = files.where("is_new")
    if fresh.isEmpty() and gone.isEmpty():
        return tables, report
    chunks = chunking.chunk_files(fresh).where("error is null")
    symbol = F.when(F.col("chunk_type") == "module", F.col("source_file")).otherwise(F.concat("source_file", F.lit("::"), "symbol_name"))
    chunks = stage(chunks.withColumn("label", symbol), "chunks")
    cached = stage(delta.cached_chunks(chunks.withColumnRenamed("file_hash", "new_hash"), nodes), "cached")
    nodes = delta.with_new_hashes(nodes, cached.where("cached").select(F.col("cached_node_id").alias("id"), F.col("new_hash").alias("file_hash")))
    keep = cached.where("cached").select(F.col("cached_node_id").alias("id"))
    replaced = nodes.where(F.col("project_uuid") == project).withColumn("path", F.split("label", "::", 2)[0]).join(fresh.select(F.col("relative_path").alias("path")), "path", "left_semi")
    obsolete = stage(replaced.join(keep, "id", "left_anti").where("type not in ('directory', 'insight')").select("id"), "obsolete")
    tables = delta.without_nodes({"nodes": nodes, "edges": edges, "vectors": vectors}, obsolete)

    new = cached.where("not cached").select(
        F.lit(project).alias("project_uuid"), "label", "content", F.upper("chunk_type").alias("kind"), F.col("chunk_type").alias("type"), F.col("new_hash").alias("file_hash"), "calls", "source_file", "symbol_name"
    )
    new = new.withColumn("node_type", F.when(F.col("kind").isin("CLASS", "FUNCTION", "METHOD"), F.col("kind")).otherwise("MODULE")).withColumn("status", F.lit("ACTIVE")).drop("kind")
    new = new.withColumn("type", F.when(F.col("label") == F.col("source_file"), F.lit("file")).otherwise(F.col("type")))
    told = cached.where("not cached").select(F.concat_ws("\n", "label", F.coalesce("symbol_name", F.lit(""))).alias("source_label"), F.coalesce("content", F.lit("")).alias("content"), F.when(F.lit(auto_tag), detected_tags(F.coalesce("content", F.lit("")), F.col("category"))).otherwise(F.array().cast("array<string>")).alias("detected_tags"))
    told = summarise.summarise_chunks(told, call).groupBy("source_label").agg(F.min(F.struct("summary", "detected_tags")).alias("s"))
    told = stage(told.select(F.col("source_label").alias("_key"), "s.summary", F.when(F.lit(auto_tag), F.to_json("s.detected_tags")).alias("tags")), "summaries")
    new = new.withColumn("_key", F.concat_ws("\n", "label", F.coalesce("symbol_name", F.lit("")))).join(told, "_key", "left").drop("_key")
    numbered = stage(snapshots.with_ids(new, tables["nodes"], ["label", "symbol_name"]), "numbered")
    all_nodes = stage(tables["nodes"].unionByName(numbered.drop("calls", "source_file", "symbol_name"), allowMissingColumns=True), "nodes")
    symbols = all_nodes.where(F.col("project_uuid") == project).where(F.col("label").contains("::")).select(F.col("id").alias("node_id"), F.split("label", "::", 2)[0].alias("path"), F.split("label", "::", 2)[1].alias("name"))
    calls = graph.call_targets(symbols, numbered.select(F.col("id").alias("source_id"), F.col("source_file").alias("path"), F.explode("calls").alias("callee")))
    linked = graph.containment_edges(all_nodes.where(F.col("project_uuid") == project)).unionByName(calls.withColumn("relation_type", F.lit("calls")))
    linked = linked.groupBy("source_id", "target_id").agg(F.min("relation_type").alias("relation_type"))  # a call replaces a containment
    old = tables["edges"].join(linked.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti").select(*edges.columns)
    out_edges = old.unionByName(linked.withColumn("weight", F.lit(1.0)).withColumn("confidence_tag", F.lit("EXTRACTED")), allowMissingColumns=True)
    out_vectors = snapshots.upsert_vectors(tables["vectors"], embed.vectors_of(numbered, embedder))
    present = files.select(F.lit(project).alias("project_uuid"), F.col("relative_path").alias("path"))
    done = delta.garbage_collected({"nodes": all_nodes, "edges": out_edges, "vectors": out_vectors}, present, project)
    return done, report


def on_planning(projects: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None, commits: DataFrame, wings: DataFrame, fact_rows: DataFrame, project: str, task: str, now: Column, embedder: Callable = embed.hashed_embedding, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """What a plan starts from: the project's wake-up row and the best results for the task."""
    awake = wake_up(projects, nodes, edges, commits, wings, fact_rows).where(F.col("project_uuid") == project)
    scope = search.scoped_projects(projects, wings, project)
    results = search.hybrid_search(nodes, edges, vectors, task, embedder(task), now, project, scope, top_k=top_k)
    return awake, search.enriched(results, nodes)


def on_execution(results: DataFrame, nodes: DataFrame, max_results: int = 5) -> DataFrame:
    """What a step of work gets: reranked results with their labels."""
    return search.enriched(search.rerank(results, max_results), nodes)


def on_done(draft: dict, commits: DataFrame, nodes: DataFrame, project: str, now: Column, generate: Callable[[str], dict] | None = None, judge: Callable[[dict], dict] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Audit a draft and, once approved, commit it with its audit flags; see ``learned`` for an error in it."""
    verdict = audit.audit_with_retry(draft, generate, judge)
    if verdict["approved"]:
        commits, nodes = commit_memory(commits, nodes, project, draft["phase"], draft["technical_changes"], draft["updated_pointers"], now, draft.get("node_ids"), True, verdict["partial_audit"])
    return commits, nodes, verdict


def learned(trajectories: DataFrame, project: str, draft: dict, now: Column) -> DataFrame:
    """The trajectories with what a finished draft tells of an error and its solution, if it tells of one."""
    if not (draft.get("error") or "").strip():
        return trajectories
    row = trajectories.sparkSession.createDataFrame(
        [(project, draft.get("prompt") or draft["phase"], draft["technical_changes"], draft["error"], draft.get("solution"))], "project_uuid string, prompt_origem string, tentativa_execucao string, erro_encontrado string, solucao_aplicada string"
    )
    row = snapshots.with_ids(row, trajectories, ["project_uuid"]).withColumn("status", F.lit("ACTIVE")).withColumn("created_at", now)
    return trajectories.unionByName(row, allowMissingColumns=True)


def trajectories_of(trajectories: DataFrame, project: str | None = None, status: str | None = None) -> DataFrame:
    """Trajectories, of one project or status, newest first."""
    for column, value in (("project_uuid", project), ("status", status)):
        if value is not None:
            trajectories = trajectories.where(F.col(column) == value)
    return trajectories.orderBy(F.desc("created_at"), F.desc("id"))

