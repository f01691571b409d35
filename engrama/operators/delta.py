"""Delta detection, reconciliation of tables and vectors, cascades and garbage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import label_path, signature_hash

#: Node types that stand for no file.
NO_FILE_TYPES = ("directory", "cluster", "project", "insight")


def file_delta(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Files (project_uuid, path, file_hash) with is_new and the node of the same hash."""
    known = nodes.where("file_hash is not null").groupBy("project_uuid", "file_hash").agg(F.min("id").alias("existing_node_id"))
    out = files.join(known, ["project_uuid", "file_hash"], "left")
    return out.withColumn("is_new", F.col("existing_node_id").isNull())


def deleted_file_nodes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes (id, project_uuid, label) whose file is no longer among (project_uuid, path)."""
    n = nodes.where(~F.lower(F.coalesce("type", F.lit(""))).isin(*NO_FILE_TYPES) & (F.coalesce("label", F.lit("")) != ""))
    n = n.select("id", "project_uuid", "label", label_path(F.col("label")).alias("path"))
    return n.join(files.select("project_uuid", "path").distinct(), ["project_uuid", "path"], "left_anti").select("id", "project_uuid", "label")


def cached_chunks(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks (project_uuid, label, content, ...) with cached and the node of equal label and content."""
    known = nodes.where("content is not null and content <> ''").groupBy("project_uuid", "label", F.col("content")).agg(F.min("id").alias("cached_node_id"))
    return chunks.join(known, ["project_uuid", "label", "content"], "left").withColumn("cached", F.col("cached_node_id").isNotNull())


def with_new_hashes(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Nodes with file_hash replaced for the ids in ``updates(id, file_hash)``."""
    u = updates.groupBy("id").agg(F.max("file_hash").alias("_hash"))
    return nodes.join(u, "id", "left").withColumn("file_hash", F.coalesce("_hash", "file_hash")).drop("_hash")


def without_obsolete(nodes: DataFrame, project: str, path: str, file_hash: str) -> DataFrame:
    """Nodes but those of this file, or in it, that carry another hash or none."""
    mine = (F.col("project_uuid") == project) & ((F.col("label") == path) | F.col("label").startswith(path + "::"))
    stale = mine & (F.col("file_hash").isNull() | (F.col("file_hash") != file_hash))
    return nodes.where(~F.coalesce(stale, F.lit(False)))


def orphan_vectors(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vectors whose node is missing; a null node id is an orphan too."""
    ids = nodes.select(F.col("id").alias("node_id")).distinct()
    return vectors.join(ids, "node_id", "left_anti").select("doc_id", "node_id")


def orphan_documents(vectors: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of vectors whose file path is gone, sorted."""
    return vectors.select("id").distinct().join(files.select(F.col("path").alias("id")), "id", "left_anti").orderBy("id")


def missing_vectors(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Active nodes with content and no stored vector."""
    n = nodes.where("status = 'ACTIVE' and content is not null and content <> ''").select("id", "project_uuid", "label")
    return n.join(vectors.select(F.col("node_id").alias("id")).distinct(), "id", "left_anti")


def without_nodes(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete nodes (id) with their edges and vectors."""
    out = dict(tables)
    out["nodes"] = tables["nodes"].join(ids.select("id"), "id", "left_anti")
    if "edges" in tables:
        e = tables["edges"].join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti")
        out["edges"] = e.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(*tables["edges"].columns)
    if "vectors" in tables:
        out["vectors"] = tables["vectors"].join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(*tables["vectors"].columns)
    return out


def without_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """Delete a project with its nodes, their edges, its vectors, wings, trajectories and commits."""
    gone = tables["nodes"].where(F.col("project_uuid") == project).select("id")
    out = without_nodes(tables, gone)
    out["projects"] = tables["projects"].where(F.col("uuid") != project)
    for name in ("vectors", "reference_wings", "trajectories", "commit_log"):
        if name in out:
            out[name] = out[name].where(F.coalesce(F.col("project_uuid") != project, F.lit(True)))
    return out


def changed_files(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """The files table after the incoming (path, content, community_id); one row per path.

    ``changed`` tells, for incoming files only, whether they are new or their
    signature differs; only then they become dirty, else they become clean.
    """
    new = incoming.select("path", F.col("content").alias("_content"), F.col("community_id").alias("_community"), signature_hash(F.col("content")).alias("_ssh"))
    j = files.join(new, "path", "full")
    came = F.col("_ssh").isNotNull()
    changed = came & (F.col("ssh_hash").isNull() | (F.col("ssh_hash") != F.col("_ssh")))
    return j.select(
        "path",
        F.when(came, F.col("_content")).otherwise(F.col("content")).alias("content"),
        F.coalesce("_ssh", "ssh_hash").alias("ssh_hash"),
        F.when(came, changed).otherwise(F.col("is_dirty")).alias("is_dirty"),
        F.coalesce("_community", "community_id").alias("community_id"),
        F.when(came, changed).alias("changed"),
    )


def community_states(communities: DataFrame, files: DataFrame) -> DataFrame:
    """Communities with is_dirty set while they hold a dirty file; missing ones are added without a summary."""
    dirty = files.where("community_id is not null").groupBy(F.col("community_id").alias("id")).agg(F.bool_or(F.coalesce("is_dirty", F.lit(False))).alias("_dirty"), F.count_if("is_dirty").alias("n_dirty"))
    return communities.join(dirty, "id", "full").select(
        "id", "summary_text", F.coalesce("_dirty", "is_dirty").alias("is_dirty"), F.coalesce("n_dirty", F.lit(0)).cast("long").alias("n_dirty")
    )


def garbage_collected(tables: dict[str, DataFrame], files: DataFrame, project: str) -> dict[str, DataFrame]:
    """Without the nodes of deleted files of one project, and without its orphan vectors."""
    mine = tables["nodes"].where(F.col("project_uuid") == project)
    gone = deleted_file_nodes(mine, files).select("id")
    out = without_nodes(tables, gone)
    if "vectors" in out:
        lost = orphan_vectors(out["vectors"].where(F.col("project_uuid") == project), out["nodes"]).select("doc_id")
        out["vectors"] = out["vectors"].join(lost, "doc_id", "left_anti").select(*tables["vectors"].columns)
    return out


def touched(nodes: DataFrame, ids: DataFrame, column: str, now: Column) -> DataFrame:
    """Nodes with ``last_commit_at`` or ``last_accessed`` set to now for the given ids."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return nodes.join(hit, "id", "left").withColumn(column, F.when(F.col("_hit"), now).otherwise(F.col(column))).drop("_hit")
