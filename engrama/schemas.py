"""Table schemas, enumerations and their validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The enumerations of the data model.
NODE_TYPES = ("CLASS", "FUNCTION", "METHOD", "MODULE", "FACT", "SKILL", "INSIGHT", "TRAJECTORY", "PATCH")
NODE_STATUS = ("ACTIVE", "STALE", "ARCHIVED")
PRIVACY = ("PUBLIC", "INTERNAL", "RESTRICTED")
CONFIDENCE = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
SCOPES = ("user", "session", "agent", "org")
CATEGORIES = ("code", "doc", "config", "conversation", "unknown")
#: Allowed changes of a node's status; ARCHIVED is final and no status leads to itself.
TRANSITIONS = (("ACTIVE", "STALE"), ("ACTIVE", "ARCHIVED"), ("STALE", "ACTIVE"), ("STALE", "ARCHIVED"))

SCHEMAS = {
    "projects": "uuid string, folder_name string, primary_wing string, privacy_level string, summary string, created_at timestamp, updated_at timestamp",
    "nodes": "id long, project_uuid string, label string, summary string, content string, node_type string, type string, tags string, file_hash string, last_accessed timestamp, last_commit_at timestamp, status string, valid_from_commit string, valid_to_commit string",
    "edges": "source_id long, target_id long, relation_type string, weight double, valid_from_commit string, valid_to_commit string, confidence_tag string",
    "reference_wings": "project_uuid string, wing_name string",
    "trajectories": "id long, project_uuid string, prompt_origem string, tentativa_execucao string, erro_encontrado string, solucao_aplicada string, status string, created_at timestamp",
    "commit_log": "id long, project_uuid string, phase string, technical_changes string, updated_pointers array<string>, revisor_approved boolean, partial_audit boolean, created_at timestamp",
    "user_core_memory": "id long, scope_type string, scope_id string, block_label string, content string, updated_at timestamp",
    "semantic_facts": "id long, scope_type string, scope_id string, fact_statement string, t_valid timestamp, t_invalid timestamp, utility_alpha double, utility_beta double, created_at timestamp",
    "agent_checkpoints": "agent_id string, session_id string, checkpoint_id string, state_blob string, created_at timestamp, seq long",
    "maintenance_reports": "skipped_idle_lock boolean, decayed long, archived long, orphan_vectors long, embedded_vectors long, communities long, contexts long, finished_at timestamp",
    "files": "path string, content string, ssh_hash string, is_dirty boolean, community_id string",
    "communities": "id string, summary_text string, is_dirty boolean",
    "vectors": "doc_id string, embedding array<float>, node_id long, project_uuid string, metadata map<string,string>",
}

_RULES: dict[str, Callable[[], Column]] = {
    "projects": lambda: F.col("uuid").isNotNull() & F.col("privacy_level").isin(*PRIVACY),
    "nodes": lambda: F.col("project_uuid").isNotNull() & F.col("label").isNotNull() & F.col("node_type").isin(*NODE_TYPES) & F.col("status").isin(*NODE_STATUS),
    "edges": lambda: F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("confidence_tag").isin(*CONFIDENCE),
    "user_core_memory": lambda: F.col("scope_type").isin(*SCOPES) & (F.trim("scope_id") != "") & (F.trim("block_label") != ""),
    "semantic_facts": lambda: F.col("scope_type").isin(*SCOPES) & (F.trim("scope_id") != "") & (F.trim("fact_statement") != ""),
    "commit_log": lambda: (F.trim("technical_changes") != "") & (F.size("updated_pointers") > 0),
}


def is_valid(table: str) -> Column:
    """Whether a row keeps the table's constraints; a null in a checked column does not."""
    rule = _RULES.get(table)
    return F.coalesce(rule(), F.lit(False)) if rule else F.lit(True)


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    return df.where(is_valid(table)), df.where(~is_valid(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; missing ones are null, others are dropped."""
    cols = []
    for part in _fields(SCHEMAS[table]):
        name, kind = part
        cols.append((F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*cols)


def _fields(ddl: str) -> list[tuple[str, str]]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append((name, kind))
            start = i + 1
    return out
