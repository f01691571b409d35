"""Bi-temporal facts, their usefulness, core memory and checkpoints."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.operators.relational import current
from engrama.schemas import SCHEMAS, SCOPES, is_valid
from engrama.sources.snapshots import with_ids
from engrama.staging import stage

FACTS = SCHEMAS["semantic_facts"]


def insert_facts(facts: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Facts with new active ones (scope_type, scope_id, fact_statement) after the greatest id.

    Rows with an unknown scope, or a blank id or statement, are refused by
    ``ValueError`` before anything is added.
    """
    trimmed = new.select("scope_type", F.trim("scope_id").alias("scope_id"), F.trim("fact_statement").alias("fact_statement"))
    if not trimmed.where(~is_valid("semantic_facts")).isEmpty():
        raise ValueError(f"a fact needs a scope of {SCOPES}, an id and a statement")
    add = with_ids(trimmed, facts, ["scope_type", "scope_id", "fact_statement"]).select(
        "id", "scope_type", "scope_id", "fact_statement", now.alias("t_valid"), F.lit(None).cast("timestamp").alias("t_invalid"),
        F.lit(1.0).alias("utility_alpha"), F.lit(1.0).alias("utility_beta"), now.alias("created_at"),
    )
    return facts.unionByName(add)


def invalidate_facts(facts: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Facts whose id is in ``ids(id)`` end now, also those that had ended."""
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    return facts.join(gone, "id", "left").withColumn("t_invalid", F.when(F.col("_gone"), now).otherwise(F.col("t_invalid"))).drop("_gone")


def active_facts(facts: DataFrame, scope_type: str | None = None, scope_id: str | None = None) -> DataFrame:
    out = facts.where("t_invalid is null")
    if scope_type is not None:
        out = out.where((F.col("scope_type") == scope_type) & (F.col("scope_id") == (scope_id or "").strip()))
    return out.orderBy("id")


def facts_as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts valid at an instant: begun, and not ended before or at it."""
    return facts.where((F.col("t_valid") <= at) & (F.col("t_invalid").isNull() | (F.col("t_invalid") > at)))


def fact_history(facts: DataFrame, scope_type: str, scope_id: str) -> DataFrame:
    return facts.where((F.col("scope_type") == scope_type) & (F.col("scope_id") == scope_id.strip())).orderBy("t_valid", "id")


def with_feedback(facts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Useful answers add to alpha, others to beta; ``feedback`` is a log (fact_id, was_useful)."""
    f = feedback.where("was_useful is not null").groupBy(F.col("fact_id").alias("id")).agg(
        F.count_if("was_useful").alias("_yes"), F.count_if(~F.col("was_useful")).alias("_no")
    )
    j = facts.join(f, "id", "left")
    return (
        j.withColumn("utility_alpha", F.col("utility_alpha") + F.coalesce("_yes", F.lit(0)))
        .withColumn("utility_beta", F.col("utility_beta") + F.coalesce("_no", F.lit(0)))
        .drop("_yes", "_no")
    )


def parse_decision(reply: str | None) -> dict | None:
    """The JSON object in a reply: bare, fenced or embedded; None without one."""
    if not reply:
        return None
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", reply)
    for text in (bare, *(m[0] for m in re.finditer(r"\{.*\}", reply, re.S))):
        try:
            got = json.loads(text)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None


def decide_facts(facts: DataFrame, new: DataFrame, decide: Callable[[list[tuple[int, str]], str], str], now: datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """Store new facts one after the other per scope, as an injected function decides.

    ``new``: scope_type, scope_id, seq, fact_statement.  Without active facts a
    new one is added unasked.  ``decide(active, statement)`` answers with JSON: ADD,
    NOOP, UPDATE or DELETE with target_id; an answer that can't be read adds.  An
    UPDATE without a valid target adds, a DELETE without one does nothing.

    Returns the facts (new ids follow the greatest one) and a log (scope_type,
    scope_id, seq, action, target_id, fallback).  The order within a scope
    matters, so a scope is one group: of its active facts and new statements,
    not of its history.
    """
    ended = facts.where("t_invalid is not null")
    active = facts.where("t_invalid is null")
    old = active.select("scope_type", "scope_id", "id", "fact_statement", F.lit(None).cast("long").alias("seq"))
    add = new.select("scope_type", F.trim("scope_id").alias("scope_id"), F.lit(None).cast("long").alias("id"), "fact_statement", F.col("seq").cast("long").alias("seq"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scope = (pdf["scope_type"].iloc[0], pdf["scope_id"].iloc[0])
        state = {int(i): s for i, s in pdf.loc[pdf["seq"].isna(), ["id", "fact_statement"]].sort_values("id").itertuples(index=False)}
        rows, temporary = [], -1
        for seq, text in pdf.loc[pdf["seq"].notna(), ["seq", "fact_statement"]].sort_values("seq").itertuples(index=False):
            action, target, statement, fallback = "ADD", None, text.strip(), False
            if state:
                got = parse_decision(decide(list(state.items()), text))
                if got is None or "action" not in got:
                    fallback = True
                else:
                    action = got["action"]
                    try:
                        target = int(got["target_id"])
                    except (KeyError, TypeError, ValueError):
                        target = None
                    known = target in state
                    if action == "UPDATE":
                        action = "UPDATE" if known else "ADD"
                        statement = ((got.get("updated_statement") or text) if known else text).strip()
                    elif action == "DELETE" and not known or action not in ("ADD", "UPDATE", "DELETE"):
                        action = "NOOP"
            target = target if action in ("UPDATE", "DELETE") else None
            if target is not None:
                del state[target]
            new_id = None
            if action in ("ADD", "UPDATE"):
                new_id, temporary = temporary, temporary - 1
                state[new_id] = statement
            rows.append((*scope, int(seq), action, target, new_id, statement if new_id else None, fallback))
        return pd.DataFrame(rows, columns=["scope_type", "scope_id", "seq", "action", "target_id", "new_id", "statement", "fallback"]).astype({"target_id": "Int64", "new_id": "Int64"})

    schema = "scope_type string, scope_id string, seq long, action string, target_id long, new_id long, statement string, fallback boolean"
    log = stage(old.unionByName(add).groupBy("scope_type", "scope_id").applyInPandas(run, schema), "decisions")
    at = F.lit(now)
    made = log.where("new_id is not null")
    replaced = log.where("target_id < 0").select("scope_type", "scope_id", F.col("target_id").alias("new_id"), F.lit(True).alias("_over")).distinct()
    made = made.join(replaced, ["scope_type", "scope_id", "new_id"], "left")
    fresh = with_ids(made, facts, ["scope_type", "scope_id", "seq"]).select(
        "id", "scope_type", "scope_id", F.col("statement").alias("fact_statement"), at.alias("t_valid"),
        F.when(F.col("_over"), at).cast("timestamp").alias("t_invalid"), F.lit(1.0).alias("utility_alpha"), F.lit(1.0).alias("utility_beta"), at.alias("created_at"),
    )
    kept = invalidate_facts(active, log.where("target_id > 0").select(F.col("target_id").alias("id")), at)
    return ended.unionByName(kept).unionByName(fresh), log.drop("new_id")


def core_memory(log: DataFrame) -> DataFrame:
    """Latest block per (scope_type, scope_id, block_label) of an append-only log; invalid rows are left out."""
    ok = log.where(is_valid("user_core_memory"))
    return current(ok, ["scope_type", "scope_id", "block_label"], [F.desc("updated_at"), F.desc("id")])


def memory_blocks(memory: DataFrame, scope_type: str, scope_id: str, label: str | None = None) -> DataFrame:
    out = memory.where((F.col("scope_type") == scope_type) & (F.col("scope_id") == scope_id))
    return (out if label is None else out.where(F.col("block_label") == label)).orderBy("block_label")


def checkpoints(log: DataFrame) -> DataFrame:
    """Latest state per (agent, session, checkpoint); rewriting one moves it on the timeline."""
    return current(log, ["agent_id", "session_id", "checkpoint_id"], [F.desc("created_at"), F.desc("seq")])


def checkpoint_timeline(log: DataFrame, agent_id: str, session_id: str) -> DataFrame:
    return checkpoints(log).where((F.col("agent_id") == agent_id) & (F.col("session_id") == session_id)).orderBy("created_at", "seq")


def checkpoint_state(log: DataFrame, agent_id: str, session_id: str, checkpoint_id: str) -> dict:
    """The stored state, or an empty dict for an unknown key."""
    row = checkpoint_timeline(log, agent_id, session_id).where(F.col("checkpoint_id") == checkpoint_id).first()
    return json.loads(row["state_blob"]) if row else {}


def seeded_memory(memory_log: DataFrame, blocks: dict[tuple[str, str, str], str], now: Column) -> DataFrame:
    """The log with default blocks {(scope_type, scope_id, label): content} appended."""
    spark = memory_log.sparkSession
    top = memory_log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = [(top + i + 1, *key, text) for i, (key, text) in enumerate(sorted(blocks.items()))]
    add = spark.createDataFrame(rows, "id long, scope_type string, scope_id string, block_label string, content string").withColumn("updated_at", now)
    return memory_log.unionByName(add)
