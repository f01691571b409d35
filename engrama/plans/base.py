"""Current rows of the tables, once as DataFrames and once as SQL, for the named queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.operators import relational as R
from engrama.operators.orphans import uuid_key
from engrama.tables import table

#: The queries' clock.
NOW = "2025-06-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return R.current_nodes(table(spark, d, "nodes")).withColumn("project_uuid", uuid_key(F.col("project_uuid"))).drop("loaded_at")


def edges(spark: SparkSession, d: str) -> DataFrame:
    e = R.current_edges(table(spark, d, "edges")).where("valid_to_commit is null").drop("loaded_at")
    return e.withColumn("relation_type", F.replace(F.lower(F.trim("relation_type")), F.lit("-"), F.lit("_")))


def projects(spark: SparkSession, d: str) -> DataFrame:
    return R.current_projects(table(spark, d, "projects").withColumn("uuid", uuid_key(F.col("uuid"))))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return R.current_vectors(table(spark, d, "vectors")).withColumn("project_uuid", uuid_key(F.col("project_uuid")))


def files(spark: SparkSession, d: str) -> DataFrame:
    c = R.current(table(spark, d, "crawl_results"), ["file_id"], [F.desc("crawled_at"), F.asc("relative_path")])
    return c.withColumn("project_uuid", uuid_key(F.col("project_uuid"))).withColumn("path", F.translate("relative_path", "\\", "/"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return R.current(table(spark, d, "parsed_chunks"), ["chunk_id"], [F.desc("parsed_at"), F.asc("content")])


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts out of the event stream: the type of each user's event holds until the next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.lit("user").alias("scope_type"), F.col("user_id").cast("string").alias("scope_id"), F.col("event_type").alias("fact_statement"), F.col("ts").alias("t_valid"),
        F.lead("ts").over(w).alias("t_invalid"), F.lit(1.0).alias("utility_alpha"), F.lit(1.0).alias("utility_beta"), F.col("ts").alias("created_at"),
    )


def anchor_project(spark: SparkSession, d: str) -> str:
    """The project that the queries about one project ask for: the first by uuid."""
    return projects(spark, d).agg(F.min("uuid")).first()[0]


def anchor_node(spark: SparkSession, d: str) -> int:
    """The node that traversals start from: the one most others are reached from directly (smallest id)."""
    e = edges(spark, d).groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()
    return e["source_id"] if e else -1


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The usable current embedding of the smallest node id."""
    v = vectors(spark, d).where("size(embedding) = 384").orderBy("node_id").select("embedding").first()
    return list(v["embedding"]) if v else [0.0] * 384


T = f"TIMESTAMPTZ '{NOW}+00'"
CN = """cn AS (SELECT id, nullif(lower(trim(project_uuid)), '') AS project_uuid, label, summary, content, node_type, type, tags, file_hash, last_accessed, last_commit_at, status
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, label, status) AS rn FROM nodes) WHERE rn = 1)"""
CE = """ce AS (SELECT source_id, target_id, replace(lower(trim(relation_type)), '-', '_') AS relation_type, weight, confidence_tag
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY loaded_at DESC, relation_type DESC, coalesce(weight, -1) DESC) AS rn FROM edges) WHERE rn = 1 AND valid_to_commit IS NULL)"""
CP = """cp AS (SELECT lower(trim(uuid)) AS uuid, folder_name, primary_wing, privacy_level, summary, created_at, updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(uuid)) ORDER BY updated_at DESC, folder_name) AS rn FROM projects) WHERE rn = 1)"""
CV = """cv AS (SELECT doc_id, embedding, node_id, nullif(lower(trim(project_uuid)), '') AS project_uuid
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stored_at DESC, embedding DESC) AS rn FROM vectors) WHERE rn = 1)"""
CF = """cf AS (SELECT *, replace(relative_path, '\\', '/') AS path, nullif(lower(trim(project_uuid)), '') AS pkey
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY crawled_at DESC, relative_path) AS rn FROM crawl_results) WHERE rn = 1)"""
CC = """cc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY parsed_at DESC, content) AS rn FROM parsed_chunks) WHERE rn = 1)"""
FA = """fa AS (SELECT event_id AS id, 'user' AS scope_type, CAST(user_id AS VARCHAR) AS scope_id, event_type AS fact_statement, ts AS t_valid,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t_invalid FROM events)"""
AP = "(SELECT min(uuid) FROM cp)"
AN = "(SELECT source_id FROM ce GROUP BY source_id ORDER BY count(*) DESC, source_id LIMIT 1)"
