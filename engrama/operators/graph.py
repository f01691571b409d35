"""Bounded graph traversals, communities and the construction of edges.

Traversals advance a frontier of distinct rows level by level; each level is a
written table, so plans stay short and a lost executor costs one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import label_path, parent_dir
from engrama.operators.communities import Graph, pairs
from engrama.operators.relational import super_nodes
from engrama.staging import stage


def dependency_tree(nodes: DataFrame, edges: DataFrame, start: int, max_depth: int = 10, reverse: bool = False) -> DataFrame:
    """(id, label, node_type, depth): nodes reached from ``start``, once per depth they are reached at."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    step = edges.select(F.col(a).alias("_from"), F.col(b).alias("_to")).distinct()
    root = nodes.where(F.col("id") == start).select("id", F.lit(0).alias("depth"))
    levels = [stage(root, "tree")]
    for depth in range(1, max_depth + 1):
        nxt = levels[-1].join(step, F.col("id") == F.col("_from")).select(F.col("_to").alias("id"), F.lit(depth).alias("depth")).distinct()
        nxt = stage(nxt.join(nodes.select("id"), "id", "left_semi"), "tree")
        if nxt.isEmpty():
            break
        levels.append(nxt)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.join(nodes.select("id", "label", "node_type"), "id").select("id", "label", "node_type", "depth")


def call_chain(ast_edges: DataFrame, start: str, depth_limit: int = 5) -> DataFrame:
    """(node): names reached in 1 to ``depth_limit`` calls, the start itself excluded."""
    e = ast_edges.select("parent_node", "child_node").distinct()
    seen = stage(e.where(F.col("parent_node") == start).select(F.col("child_node").alias("node")).distinct(), "chain")
    frontier = seen
    for _ in range(1, max(1, depth_limit)):
        nxt = frontier.join(e, F.col("node") == F.col("parent_node")).select(F.col("child_node").alias("node")).distinct()
        frontier = stage(nxt.join(seen, "node", "left_anti"), "chain")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where(F.col("node") != start)


def _anchors_and_steps(nodes: DataFrame, edges: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The super-nodes, and the links in either direction onto active nodes with the project of these."""
    anchors = super_nodes(nodes, edges, threshold).select(F.col("id").alias("anchor_id"), F.col("id").alias("member_id"), "project_uuid")
    active = nodes.where("status = 'ACTIVE'").select(F.col("id").alias("_to"), F.col("project_uuid").alias("_project"))
    both = edges.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to")).unionByName(
        edges.select(F.col("target_id").alias("_from"), F.col("source_id").alias("_to"))
    )
    return stage(anchors, "members"), stage(both.where("_from <> _to").distinct().join(active, "_to"), "steps")


def nearest_communities(nodes: DataFrame, edges: DataFrame, threshold: int = 10, max_hops: int = 5) -> DataFrame:
    """(member_id, anchor_id, hops): every reached node once, with its nearest super-node (ties: the smallest id).

    As ``communities``, but linear in the nodes: a node is settled when it is first
    reached, so super-nodes that reach the same nodes don't multiply them.
    """
    anchors, step = _anchors_and_steps(nodes, edges, threshold)
    frontier = seen = stage(anchors.select("anchor_id", "member_id", "project_uuid", F.lit(0).alias("hops")), "nearest")
    for hop in range(1, max_hops + 1):
        nxt = (
            frontier.join(step, (F.col("member_id") == F.col("_from")) & (F.col("project_uuid") == F.col("_project")))
            .groupBy(F.col("_to").alias("member_id"), "project_uuid").agg(F.min("anchor_id").alias("anchor_id"))
        )
        nxt = nxt.join(seen.select("member_id"), "member_id", "left_anti")
        frontier = stage(nxt.select("anchor_id", "member_id", "project_uuid", F.lit(hop).alias("hops")), "nearest")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("member_id", "anchor_id", "hops")


def communities(nodes: DataFrame, edges: DataFrame, threshold: int = 10, max_hops: int = 5) -> DataFrame:
    """(anchor_id, member_id): per super-node what it reaches, in either direction, over active nodes of its project.

    The rows are those asked for, one per super-node and node, made by the last step
    (see ``communities.Graph``); ``nearest_communities`` has each node once.
    """
    return pairs(Graph(nodes, edges, threshold), max_hops)


def greatest_communities(nodes: DataFrame, edges: DataFrame, threshold: int = 10, max_hops: int = 5) -> DataFrame:
    """(member_id, anchor_id): every node that a super-node reaches once, with the greatest of these.

    As the greatest ``anchor_id`` of ``communities`` per node, but linear in the nodes:
    a node passes on the greatest super-node that it knows whenever it learns a greater one.
    """
    anchors, step = _anchors_and_steps(nodes, edges, threshold)
    frontier = best = anchors
    for _ in range(max_hops):
        nxt = (
            frontier.join(step, (F.col("member_id") == F.col("_from")) & (F.col("project_uuid") == F.col("_project")))
            .groupBy(F.col("_to").alias("member_id"), "project_uuid").agg(F.max("anchor_id").alias("anchor_id"))
        )
        known = best.groupBy("member_id").agg(F.max("anchor_id").alias("_known"))
        nxt = nxt.join(known, "member_id", "left").where("_known is null or anchor_id > _known")
        frontier = stage(nxt.select("anchor_id", "member_id", "project_uuid"), "greatest")
        if frontier.isEmpty():
            break
        best = best.unionByName(frontier)
    return best.groupBy("member_id").agg(F.max("anchor_id").alias("anchor_id"))


def natural_communities(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with the directory that is their community; ``root`` without one."""
    return files.withColumn("community_id", parent_dir(F.col(path), "root"))


def call_targets(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(source_id, target_id) of calls by name.

    ``symbols``: node_id, path, name; ``calls``: source_id, path, callee.  A name
    is looked for in the same file, then its last dotted part in the same file,
    then anywhere; of several the smallest id counts.  A node never calls itself.
    """
    here = symbols.groupBy("path", "name").agg(F.min("node_id").alias("id"))
    anywhere = symbols.groupBy("name").agg(F.min("node_id").alias("id"))
    c = calls.withColumn("last", F.element_at(F.split("callee", r"\."), -1))
    c = c.join(here.select("path", F.col("name").alias("callee"), F.col("id").alias("id1")), ["path", "callee"], "left")
    c = c.join(here.select("path", F.col("name").alias("last"), F.col("id").alias("id2")), ["path", "last"], "left")
    c = c.join(anywhere.select(F.col("name").alias("callee"), F.col("id").alias("id3")), "callee", "left")
    dotted = F.when(F.col("callee") != F.col("last"), F.col("id2"))
    out = c.select("source_id", F.coalesce("id1", dotted, "id3").alias("target_id"))
    return out.where("target_id is not null and target_id <> source_id").distinct()


def containment_edges(nodes: DataFrame) -> DataFrame:
    """Edges directory -> file -> symbol out of labels ``path`` and ``path::symbol``."""
    path = label_path(F.col("label"))
    n = nodes.where("label is not null").select("id", "project_uuid", "type", path.alias("path"), F.col("label").contains("::").alias("inner"))
    files = n.where("not inner and type = 'file'").groupBy("project_uuid", "path").agg(F.min("id").alias("file_id"))
    dirs = nodes.where("type = 'directory'").groupBy("project_uuid", F.col("label").alias("dir")).agg(F.min("id").alias("dir_id"))
    symbols = n.where("inner").withColumn("dir", parent_dir(F.col("path"), "<root>"))
    symbols = symbols.join(files, ["project_uuid", "path"], "left").join(dirs, ["project_uuid", "dir"], "left")
    to_symbol = symbols.select(F.coalesce("file_id", "dir_id").alias("source_id"), F.col("id").alias("target_id")).where("source_id is not null")
    to_file = files.withColumn("dir", parent_dir(F.col("path"), "<root>")).join(dirs, ["project_uuid", "dir"]).select(F.col("dir_id").alias("source_id"), F.col("file_id").alias("target_id"))
    return to_file.unionByName(to_symbol).distinct().withColumn("relation_type", F.lit("contains"))


def similar_projects(scope: DataFrame, anchor: str, limit: int = 5) -> DataFrame:
    """The first other projects of a scope."""
    return scope.where(F.col("project_uuid") != anchor).orderBy(F.desc("updated_at"), "project_uuid").limit(limit)
