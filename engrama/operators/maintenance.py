"""Periodic maintenance: decay, archiving, reconciliation, communities and their summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions.scoring import days_between
from engrama.operators import communities, delta, graph
from engrama.operators.embed import hashed_embedding, vectors_of
from engrama.operators.relational import consolidated_tags, parsed_tags
from engrama.operators.summarise import project_contexts, tree_texts
from engrama.sources.snapshots import upsert_vectors, with_ids
from engrama.staging import stage

DECAY_DAYS, ARCHIVE_DAYS = 30, 60


def decayed(trajectories: DataFrame, now: Column, days: int = DECAY_DAYS) -> DataFrame:
    """Active trajectories older than ``days`` become STALE."""
    old = (F.col("status") == "ACTIVE") & (days_between(now, F.col("created_at")) > days)
    return trajectories.withColumn("status", F.when(old, F.lit("STALE")).otherwise(F.col("status")))


def archived(nodes: DataFrame, now: Column, days: int = ARCHIVE_DAYS) -> DataFrame:
    """Active nodes last accessed more than ``days`` ago become ARCHIVED; never accessed ones stay."""
    old = (F.col("status") == "ACTIVE") & (days_between(now, F.col("last_accessed")) > days)
    return nodes.withColumn("status", F.when(F.coalesce(old, F.lit(False)), F.lit("ARCHIVED")).otherwise(F.col("status")))


def community_summaries(nodes: DataFrame, members: DataFrame, summarise: Callable[[str], str] | None = None) -> DataFrame:
    """(anchor_id, n_members, summary, tags) per community.

    An injected function gets a line of every member, with its kinds and summary
    (large communities in steps, see ``tree_texts``); without one, or where it
    gives nothing, the first five labels stand for the community.
    """
    cols = nodes.select(F.col("id").alias("member_id"), "label", "summary", "node_type", "type", "tags")
    named = stage(members.select("anchor_id", "member_id").join(cols, "member_id"), "named")
    first = F.slice(F.array_sort(F.collect_list(F.struct("member_id", "label"))), 1, 5)
    # partial lists per salt hold five labels each, so no community is gathered as a whole
    salted = named.withColumn("_salt", F.pmod(F.xxhash64("member_id"), F.lit(64)))
    w = Window.partitionBy("anchor_id", "_salt").orderBy("member_id")
    heads = salted.withColumn("_r", F.row_number().over(w)).where("_r <= 5").groupBy("anchor_id").agg(first.alias("first"))
    sizes = named.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n_members"))
    tags = consolidated_tags(named.withColumn("detected_tags", parsed_tags(F.col("tags"))), ["anchor_id"])
    out = sizes.join(heads, "anchor_id").join(tags.withColumnRenamed("tags", "_tags"), "anchor_id", "left")
    text = _labels_text()
    if summarise is not None:
        line = F.format_string("- [%s] (%s/%s): %s", F.coalesce("label", F.lit("")), F.coalesce("node_type", F.lit("")), F.coalesce("type", F.lit("")), F.coalesce("summary", F.lit("no summary")))
        told = tree_texts(named.select("anchor_id", "member_id", line.alias("text")), ["anchor_id"], "member_id", summarise)
        out = out.join(told, "anchor_id", "left")
        text = F.coalesce(F.when(F.col("text") != "", F.col("text")), text)
    return out.select("anchor_id", "n_members", text.alias("summary"), F.coalesce("_tags", F.array().cast("array<string>")).alias("tags"))


def _labels_text() -> Column:
    """Of the columns ``first``, with the first five labels, and ``n_members``."""
    labels = F.array_join(F.transform("first", lambda x: F.coalesce(x["label"], F.lit(""))), ", ")
    more = F.when(F.col("n_members") > 5, F.concat(F.lit(" and "), (F.col("n_members") - 5).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.lit("Community of "), labels, more)


def label_summaries(nodes: DataFrame, edges: DataFrame, threshold: int = 10, max_hops: int = 5) -> DataFrame:
    """As ``community_summaries`` of all communities without a function, but without their pairs.

    Sizes, first members and tags are taken where the communities are found.
    """
    of = communities.Graph(nodes, edges, threshold)
    found = stage(communities.digests(of, nodes, max_hops, 5), "digests")
    ids = found.select("anchor_id", F.explode("first").alias("id")).join(nodes.select("id", "label"), "id")
    heads = ids.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("member_id"), "label"))).alias("first"))
    out = found.drop("first").join(heads, "anchor_id").select("anchor_id", "n_members", _labels_text().alias("summary"), F.array_sort("tags").alias("tags"))
    if of.has_large():
        out = out.unionByName(community_summaries(nodes, stage(communities.large_pairs(of, max_hops), "communities")))
    return out


def _insight_label() -> Column:
    return F.concat(F.lit("community_"), F.col("anchor_id").cast("string"), F.lit("_summary"))


def insight_nodes(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Nodes with one INSIGHT per community, replaced by label and not added twice."""
    anchors = nodes.select(F.col("id").alias("anchor_id"), "project_uuid")
    new = summaries.join(anchors, "anchor_id").select("project_uuid", _insight_label().alias("label"), "summary", F.to_json("tags").alias("tags"))
    old = nodes.where("type = 'insight'").groupBy("project_uuid", "label").agg(F.min("id").alias("_old"))
    j = stage(new.join(old, ["project_uuid", "label"], "left"), "insights")
    fresh = with_ids(j.where("_old is null"), nodes, ["label"]).select("id", "project_uuid", "label", "summary", "tags")
    kept = j.where("_old is not null").select(F.col("_old").alias("id"), "project_uuid", "label", "summary", "tags")
    made = stage(kept.unionByName(fresh), "insights").select("*", F.lit("INSIGHT").alias("node_type"), F.lit("insight").alias("type"), F.lit("ACTIVE").alias("status"))
    return nodes.join(made.select("id"), "id", "left_anti").select(*nodes.columns).unionByName(made, allowMissingColumns=True)


def insight_edges(edges: DataFrame, nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Edges with one ``summarizes`` from each insight to its super-node; an older edge of the pair is replaced."""
    insights = nodes.where("type = 'insight'").groupBy("label").agg(F.min("id").alias("source_id"))
    new = summaries.select("anchor_id", _insight_label().alias("label")).join(insights, "label").select("source_id", F.col("anchor_id").alias("target_id"))
    new = stage(new, "summarizes")
    kept = edges.join(new, ["source_id", "target_id"], "left_anti").select(*edges.columns)
    made = new.select("*", F.lit("summarizes").alias("relation_type"), F.lit(1.0).alias("weight"), F.lit("EXTRACTED").alias("confidence_tag"))
    return kept.unionByName(made, allowMissingColumns=True)


def with_community_ids(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """Vectors with ``community_id`` in their metadata; of several communities the one with the greatest anchor, as the last one written.

    ``members`` may be all pairs or those of ``graph.greatest_communities``.
    """
    of = members.groupBy(F.col("member_id").alias("node_id")).agg(F.max("anchor_id").cast("string").alias("_community"))
    old = F.col("metadata") if "metadata" in vectors.columns else F.lit(None).cast("map<string,string>")
    old = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: k != "community_id")
    j = vectors.join(of, "node_id", "left")
    new = F.when(F.col("_community").isNull(), old).otherwise(F.map_concat(old, F.create_map(F.lit("community_id"), F.col("_community"))))
    return j.withColumn("metadata", new).drop("_community")


def run_maintenance(
    tables: dict[str, DataFrame], now: Column, summarise: Callable[[str], str] | None = None, ingesting: bool | Callable[[], bool] = False, embedder: Callable | None = hashed_embedding, zoom: Callable[[str], str] | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """All steps for all projects at once; the changed tables and a report of one row.

    Decay and archiving; orphan vectors removed and missing ones embedded anew;
    communities, their insights, ``summarizes`` edges and ids in the vectors'
    metadata; summaries of projects, if ``projects`` is among the tables.  While an
    ingest runs nothing is done and the report says so; a function is asked again
    before each step, and what is done by then stays.
    """
    spark = tables["nodes"].sparkSession
    columns = "skipped_idle_lock boolean, decayed long, archived long, orphan_vectors long, embedded_vectors long, communities long, contexts long"
    busy = ingesting if callable(ingesting) else lambda: ingesting
    out, report = dict(tables), dict.fromkeys(("decayed", "archived", "orphans", "embedded", "communities", "contexts"), 0)

    def finished(skipped: bool) -> tuple[dict[str, DataFrame], DataFrame]:
        return out, spark.createDataFrame([(skipped, *report.values())], columns)

    if busy():
        return finished(True)
    turned = lambda before, after, to: after.where(F.col("status") == to).count() - before.where(F.col("status") == to).count()
    if "trajectories" in tables:
        out["trajectories"] = stage(decayed(tables["trajectories"], now), "trajectories")
        report["decayed"] = turned(tables["trajectories"].select("status"), out["trajectories"], "STALE")
    nodes = stage(archived(tables["nodes"].withColumn("_was", F.col("status")), now), "nodes")
    out["nodes"] = nodes.drop("_was")
    report["archived"] = nodes.where("status = 'ARCHIVED' and _was <> 'ARCHIVED'").count()
    if busy():
        return finished(True)
    if "vectors" in tables:
        lost = stage(delta.orphan_vectors(tables["vectors"], out["nodes"]), "orphans")
        kept = tables["vectors"].join(lost.select("doc_id"), "doc_id", "left_anti").select(*tables["vectors"].columns)
        report["orphans"] = lost.count()
        if embedder is not None:
            missing = delta.missing_vectors(out["nodes"], kept).select("id")
            new = stage(vectors_of(out["nodes"].join(missing, "id", "left_semi"), embedder), "embedded")
            report["embedded"] = new.count()
            kept = upsert_vectors(kept, new)
        out["vectors"] = stage(kept, "vectors")
    if busy():
        return finished(True)
    if summarise is None:
        told = label_summaries(out["nodes"], tables["edges"])
    else:
        told = community_summaries(out["nodes"], stage(graph.communities(out["nodes"], tables["edges"]), "communities"), summarise)
    summaries = stage(told, "summaries")
    report["communities"] = summaries.count()
    greatest = graph.greatest_communities(out["nodes"], tables["edges"]) if "vectors" in out else None
    out["nodes"] = stage(insight_nodes(out["nodes"], summaries), "nodes")
    out["edges"] = insight_edges(tables["edges"], out["nodes"], summaries)
    if "vectors" in out:
        out["vectors"] = with_community_ids(out["vectors"], greatest)
    if busy():
        return finished(True)
    if "projects" in tables:
        out["projects"], contexts = project_contexts(tables["projects"], out["nodes"], zoom)
        report["contexts"] = contexts.count()
    return finished(False)
