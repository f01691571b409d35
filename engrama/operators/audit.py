"""Checks of drafts, privacy and status changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.schemas import PRIVACY, TRANSITIONS

MIN_CHANGE_CHARS = 10
MAX_LOOPS = 3


def privacy_rank(level: Column) -> Column:
    """0 for public and unknown, then rising."""
    out = F.lit(0)
    for i, name in enumerate(PRIVACY):
        out = F.when(level == name, F.lit(i)).otherwise(out)
    return out


def is_safe_flow(source: Column, target: Column) -> Column:
    """Whether content may go from one privacy level to another: never to a lower one."""
    return privacy_rank(source) <= privacy_rank(target)


def audited(drafts: DataFrame) -> DataFrame:
    """Drafts (technical_changes, updated_pointers) with approved and the first reason against."""
    text = F.regexp_replace(F.coalesce("technical_changes", F.lit("")), r"^\s+|\s+$", "")
    pointers = F.coalesce(F.col("updated_pointers"), F.array().cast("array<string>"))
    blank = F.exists(pointers, lambda p: F.coalesce(F.regexp_replace(p, r"\s+", ""), F.lit("")) == "")
    reason = (
        F.when(text == "", "changes are blank")
        .when(F.length(text) < MIN_CHANGE_CHARS, "changes are too short")
        .when(F.size(pointers) == 0, "pointers are missing")
        .when(blank, "a pointer is blank")
        .otherwise("OK")
    )
    return drafts.withColumn("reason", reason).withColumn("approved", F.col("reason") == "OK")


def audit_one(draft: dict, judge: Callable[[dict], dict] | None = None) -> dict:
    """Rules first, then an injected judge; a failing judge approves partially."""
    text = (draft.get("technical_changes") or "").strip()
    pointers = draft.get("updated_pointers") or []
    if not text:
        return {"approved": False, "reason": "changes are blank", "partial_audit": False}
    if len(text) < MIN_CHANGE_CHARS:
        return {"approved": False, "reason": "changes are too short", "partial_audit": False}
    if not pointers:
        return {"approved": False, "reason": "pointers are missing", "partial_audit": False}
    if any(not isinstance(p, str) or not p.strip() for p in pointers):
        return {"approved": False, "reason": "a pointer is blank", "partial_audit": False}
    if judge is None:
        return {"approved": True, "reason": "OK", "partial_audit": False}
    try:
        got = judge(draft)
        return {"approved": bool(got["approved"]), "reason": str(got.get("reason", "")), "partial_audit": False}
    except Exception as e:  # whatever an injected judge raises
        return {"approved": True, "reason": f"judge failed: {e}", "partial_audit": True}


def audit_with_retry(draft: dict, generate: Callable[[str], dict] | None = None, judge: Callable[[dict], dict] | None = None) -> dict:
    """Audit, let the draft be written again on rejection, and give in after three loops."""
    for loop in range(1, MAX_LOOPS + 1):
        got = audit_one(draft, judge) | {"loop_count": loop}
        if got["approved"] or generate is None:
            return got
        if loop < MAX_LOOPS:
            draft = generate(got["reason"])
    return {"approved": True, "reason": got["reason"], "partial_audit": True, "loop_count": MAX_LOOPS}


def status_changes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted(id, new_status)`` with the old status and whether the change is allowed; unknown ids are not."""
    spark = nodes.sparkSession
    allowed = spark.createDataFrame(list(TRANSITIONS), "old_status string, new_status string").withColumn("allowed", F.lit(True))
    j = wanted.join(nodes.select("id", F.col("status").alias("old_status")), "id", "left").join(F.broadcast(allowed), ["old_status", "new_status"], "left")
    return j.select("id", "old_status", "new_status", F.coalesce("allowed", F.lit(False)).alias("allowed"))
