"""References to records that do not exist, are deleted or arrive later.

All references and all referenced records become rows of one long form
(parent table, key, side, arrival).  One aggregation per key tells whether the
record is deleted, when it first arrived and when the first reference to it
did; partial sums precede the shuffle, so a key with a third of all references
is one small row per task.  Only keys with something wrong go back to their
references, by a join in which those keys are copied once per salt.

Defined cases
-------------
* a null reference, or a blank ``project_uuid``, is no reference.
* a record without an arrival time is present and never late; a reference
  without one has a null period and is never late.
* rows delivered again count once, with their earliest arrival.
* ``deleted`` wins over ``missing``, and ``missing`` over ``late``.
* empty tables: no references give no rows; no records make all references
  missing.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def uuid_key(c: Column) -> Column:
    """Key form of a project reference: no blanks around it, no case; blank is null."""
    k = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(k != "", k)


def references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct references: ref_table, ref_field, row_key, parent, key, seen."""
    pairs = edges.groupBy("source_id", "target_id").agg(F.min("loaded_at").alias("seen"))
    row_key = F.concat_ws(":", F.coalesce(F.col("source_id").cast("string"), F.lit("")), F.coalesce(F.col("target_id").cast("string"), F.lit("")))
    ends = pairs.select(
        F.lit("edges").alias("ref_table"),
        row_key.alias("row_key"),
        "seen",
        F.explode(
            F.array(
                F.struct(F.lit("source_id").alias("ref_field"), F.col("source_id").cast("string").alias("key")),
                F.struct(F.lit("target_id").alias("ref_field"), F.col("target_id").cast("string").alias("key")),
            )
        ).alias("e"),
    ).select("ref_table", "e.ref_field", "row_key", F.lit("nodes").alias("parent"), "e.key", "seen")
    first = nodes.groupBy("id").agg(F.min("loaded_at").alias("seen"))
    owners = (
        nodes.select("id", uuid_key(F.col("project_uuid")).alias("key"))
        .where("id is not null and key is not null")
        .distinct()
        .join(first, "id")
        .select(
            F.lit("nodes").alias("ref_table"),
            F.lit("project_uuid").alias("ref_field"),
            F.col("id").cast("string").alias("row_key"),
            F.lit("projects").alias("parent"),
            "key",
            "seen",
        )
    )
    return ends.unionByName(owners).where("key is not null")


def records(nodes: DataFrame, projects: DataFrame, deletions: DataFrame) -> DataFrame:
    """Referenced records: parent, key, arrived, present, deleted."""
    no, yes = F.lit(False), F.lit(True)
    n = nodes.select(F.lit("nodes").alias("parent"), F.col("id").cast("string").alias("key"), F.col("loaded_at").alias("arrived"), yes.alias("present"), no.alias("deleted"))
    p = projects.select(F.lit("projects").alias("parent"), uuid_key(F.col("uuid")).alias("key"), F.col("created_at").alias("arrived"), yes.alias("present"), no.alias("deleted"))
    kind = F.lower(F.trim("entity"))
    d = deletions.where(kind.isin("node", "project")).select(
        F.when(kind == "node", F.lit("nodes")).otherwise(F.lit("projects")).alias("parent"),
        F.when(kind == "node", F.trim("entity_key")).otherwise(uuid_key(F.col("entity_key"))).alias("key"),
        F.lit(None).cast("timestamp").alias("arrived"),
        no.alias("present"),
        yes.alias("deleted"),
    )
    return n.unionByName(p).unionByName(d).where("key is not null")


def orphan_references(edges: DataFrame, nodes: DataFrame, projects: DataFrame, deletions: DataFrame) -> DataFrame:
    """One row per bad reference: ref_table, ref_field, row_key, reason, period."""
    refs = references(edges, nodes)
    none = F.lit(None)
    long = records(nodes, projects, deletions).select("parent", "key", "arrived", "present", "deleted", none.cast("timestamp").alias("seen"), F.lit(False).alias("is_ref"))
    long = long.unionByName(
        refs.select("parent", "key", none.cast("timestamp").alias("arrived"), F.lit(False).alias("present"), F.lit(False).alias("deleted"), "seen", F.lit(True).alias("is_ref"))
    )
    keys = (
        long.groupBy("parent", "key")
        .agg(
            F.bool_or("is_ref").alias("is_ref"),
            F.bool_or("present").alias("present"),
            F.bool_or("deleted").alias("deleted"),
            F.min("arrived").alias("arrived"),
            F.min("seen").alias("first_ref"),
        )
        .where(F.col("is_ref") & (F.col("deleted") | ~F.col("present") | (F.col("arrived") > F.col("first_ref"))))
        .select("parent", "key", "present", "deleted", "arrived", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    reason = (
        F.when(F.col("deleted"), F.lit("deleted"))
        .when(~F.col("present"), F.lit("missing"))
        .when(F.col("arrived") > F.col("seen"), F.lit("late"))
    )
    return (
        salted.join(keys, ["parent", "key", "salt"])
        .select("ref_table", "ref_field", "row_key", reason.alias("reason"), F.date_format("seen", "yyyy-MM").alias("period"))
        .where("reason is not null")
        .distinct()
    )


def orphan_report(bad: DataFrame) -> DataFrame:
    """Counts of bad references per table, field, reason and period."""
    return bad.groupBy("ref_table", "ref_field", "reason", "period").agg(F.count(F.lit(1)).alias("n_refs"))
