"""Summaries of chunks, directories, projects and communities, with injected functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions.text import extractive_summary, parent_dir
from engrama.operators.facts import parse_decision
from engrama.operators.relational import consolidated_tags, parsed_tags, relevance
from engrama.staging import stage

MAX_TRIES = 3
L0_TOKENS = 1000
PRUNE_BELOW = 0.15
GROUP_SIZE, GROUP_TOKENS = 5, 50
#: Texts that one call of an injected function gets at most; more are summarised in steps.
FAN = 500
L0_SCHEMA = "source_label string, summary string, detected_tags array<string>, relevance_score double, source_chunks int, is_dumb_summary boolean"


def tree_texts(rows: DataFrame, keys: list[str], order: str, call: Callable[[str], str] | None = None, fan: int = FAN) -> DataFrame:
    """(keys, text): the lines ``text`` of each key, in order, as one text or as the function's summary of it.

    A key with more than ``fan`` lines is cut into parts of consecutive lines; each
    part becomes one text, and the texts of the parts are joined, or summarised, in
    turn, so no task ever holds a key as a whole while a function shortens it.
    """
    level = stage(rows.select(*keys, F.col(order).alias("_at"), "text").where("text is not null"), "lines")
    done = None
    while True:
        large = stage(level.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fan).select(*keys), "large")
        more = not large.isEmpty()
        small = level.join(large, keys, "left_anti") if more else level
        texts = _joined(small, keys, call)
        done = texts if done is None else done.unionByName(texts)
        if not more:
            return done
        parts = _parts(level.join(large, keys, "left_semi"), keys, fan)
        level = stage(_joined(parts, [*keys, "_part"], call).withColumnRenamed("_part", "_at"), "lines")


def _joined(level: DataFrame, keys: list[str], call: Callable[[str], str] | None) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"])
    out = level.groupBy(*keys).agg(F.array_join(lines, "\n").alias("text"))
    return out if call is None else out.withColumn("text", F.pandas_udf(lambda s: s.map(call), "string")("text"))


def _parts(level: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Lines with the number of their part, ``fan`` consecutive ones of a key in each; counts per range of the order come first."""
    ranged = stage(level.repartitionByRange(*keys, "_at").sortWithinPartitions(*keys, "_at").withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    within = Window.partitionBy(*keys, "_range").orderBy("_at", "text")
    place = F.row_number().over(within) - 1 + F.col("_before")
    return ranged.join(sizes.drop("_n"), [*keys, "_range"]).withColumn("_part", F.floor(place / fan).cast("long")).drop("_range", "_before")


def summarise_chunks(chunks: DataFrame, call: Callable[[str], str] | None = None) -> DataFrame:
    """``L0_SCHEMA`` of chunks (source_label, content, detected_tags).

    Without a function, or if it fails three times, the summary is an extract
    with relevance 0.5.  Replies are JSON with summary, tags and relevance.
    """
    dumb = chunks.select("source_label", "content", "detected_tags", extractive_summary(F.col("content"), L0_TOKENS).alias("extract"))
    if call is None:
        return dumb.select("source_label", F.col("extract").alias("summary"), "detected_tags", F.lit(0.5).alias("relevance_score"), F.lit(1).alias("source_chunks"), F.lit(True).alias("is_dumb_summary"))

    def ask(text: str) -> dict | None:
        for _ in range(MAX_TRIES):
            try:
                got = parse_decision(call(text))
            except Exception:  # whatever an injected function raises
                got = None
            if got and got.get("summary"):
                return got
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for label, text, tags, extract in pdf.itertuples(index=False):
                tags = list(tags) if tags is not None else []
                got = ask(text)
                if got is None:
                    rows.append((label, extract, tags, 0.5, 1, True))
                else:
                    rows.append((label, str(got["summary"]), sorted({*tags, *map(str, got.get("tags") or [])}), float(got.get("relevance", 1.0)), 1, False))
            yield pd.DataFrame(rows, columns=["source_label", "summary", "detected_tags", "relevance_score", "source_chunks", "is_dumb_summary"])

    return dumb.mapInPandas(run, L0_SCHEMA)


def summarise_grouped(chunks: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """As ``summarise_chunks``, but small chunks of a batch share one call of five.

    The reply lists summaries by index; a chunk that is missing in it is asked alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got: dict[int, str] = {}
            small = [i for i, t in enumerate(pdf["content"]) if max(1, len(t) // 4) < GROUP_TOKENS]
            for at in range(0, len(small), GROUP_SIZE):
                part = small[at : at + GROUP_SIZE]
                try:
                    reply = parse_decision(call(json.dumps([pdf["content"].iloc[i] for i in part])))
                    for s in (reply or {}).get("summaries", []):
                        got[part[int(s["index"])]] = str(s["summary"])
                except Exception:  # these chunks are asked alone
                    pass
            for i, text in enumerate(pdf["content"]):
                if i not in got:
                    try:
                        got[i] = str((parse_decision(call(text)) or {}).get("summary") or "")
                    except Exception:
                        got[i] = ""
            yield pd.DataFrame({"source_label": pdf["source_label"], "summary": [got[i] or None for i in range(len(pdf))]})

    return chunks.select("source_label", "content").where("content is not null").mapInPandas(run, "source_label string, summary string")


def summarise_directories(l0: DataFrame, call: Callable[[str], str] | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """One summary per parent directory (of each ``within``) with its tags and relevance."""
    keys = [*within, "cluster"]
    d = l0.withColumn("cluster", parent_dir(F.col("source_label"), "<root>"))
    texts = tree_texts(d.select(*keys, "source_label", F.col("summary").alias("text")), keys, "source_label", call)
    tags = consolidated_tags(d, keys)
    sizes = d.groupBy(*keys).agg(F.sum("source_chunks").alias("source_chunks"), F.bool_or("is_dumb_summary").alias("is_dumb_summary"))
    out = sizes.join(texts, keys, "left").join(tags, keys, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    score = relevance(F.col("source_chunks"), F.col("tags"), F.col("is_dumb_summary"))
    return out.select(*within, F.col("cluster").alias("source_label"), F.coalesce("text", F.lit("")).alias("summary"), F.col("tags").alias("detected_tags"), score.alias("relevance_score"), "source_chunks", "is_dumb_summary")


def pruned_within(summaries: DataFrame, key: str, threshold: float = PRUNE_BELOW) -> DataFrame:
    """Per key the summaries of at least the threshold, or else its best one (ties: the first by label)."""
    best = summaries.groupBy(key).agg(F.min(F.struct((-F.col("relevance_score")).alias("s"), F.col("source_label").alias("l"))).alias("_best"))
    j = summaries.join(best, key)
    return j.where((F.col("relevance_score") >= threshold) | ((F.col("_best.l") == F.col("source_label")) & (-F.col("_best.s") < threshold))).drop("_best")


def pruned(summaries: DataFrame, threshold: float = PRUNE_BELOW) -> DataFrame:
    """Summaries of at least the threshold; if none is, the best one."""
    best = Window.partitionBy(F.lit(0)).orderBy(F.desc("relevance_score"), "source_label")
    top = summaries.orderBy(F.desc("relevance_score"), "source_label").limit(1).withColumn("_r", F.row_number().over(best)).drop("_r")
    kept = summaries.where(F.col("relevance_score") >= threshold)
    return kept.unionByName(top.where(F.col("relevance_score") < threshold))


def summarise_projects(l1: DataFrame, call: Callable[[str], str] | None = None) -> DataFrame:
    """(project_uuid, summary, tags, n_modules) out of the directories' summaries of each project, the irrelevant ones left out."""
    kept = stage(pruned_within(l1, "project_uuid"), "modules")
    line = F.format_string("- [%s] (relevance=%.2f): %s", "source_label", "relevance_score", "summary")
    texts = tree_texts(kept.select("project_uuid", "source_label", line.alias("text")), ["project_uuid"], "source_label", call)
    counts = kept.groupBy("project_uuid").agg(F.count(F.lit(1)).alias("n_modules"))
    out = texts.withColumnRenamed("text", "summary").join(counts, "project_uuid")
    return out.join(consolidated_tags(kept, ["project_uuid"]), "project_uuid", "left").select("project_uuid", "summary", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "n_modules")


def project_contexts(projects: DataFrame, nodes: DataFrame, call: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries of directories and of projects out of the stored summaries of their nodes.

    Returns the projects with their summary replaced where there is a new one, and a
    report (project_uuid, l1_count, n_modules, l2_summary, l2_tags).  Nodes that stand
    for directories, clusters or projects, or have no summary, say nothing.
    """
    told = nodes.where(~F.coalesce("type", F.lit("")).isin("directory", "cluster", "project") & (F.coalesce("summary", F.lit("")) != "") & F.col("label").isNotNull())
    l0 = told.select("project_uuid", F.col("label").alias("source_label"), "summary", F.coalesce(parsed_tags(F.col("tags")), F.array().cast("array<string>")).alias("detected_tags"), F.lit(1).cast("long").alias("source_chunks"), F.lit(False).alias("is_dumb_summary"))
    l1 = stage(summarise_directories(l0.where("project_uuid is not null"), call, ("project_uuid",)), "l1")
    l2 = stage(summarise_projects(l1, call), "l2")
    report = l1.groupBy("project_uuid").agg(F.count(F.lit(1)).alias("l1_count")).join(l2, "project_uuid", "left")
    new = l2.select(F.col("project_uuid").alias("uuid"), F.col("summary").alias("_summary"))
    stored = projects.join(new, "uuid", "left").withColumn("summary", F.coalesce("_summary", "summary")).select(*projects.columns)
    return stored, report.select("project_uuid", "l1_count", "n_modules", F.col("summary").alias("l2_summary"), F.col("tags").alias("l2_tags"))


def community_text(files: DataFrame) -> DataFrame:
    """(id, text): contents of a community's files, joined in the order of their paths."""
    rows = files.where("community_id is not null").select(F.col("community_id").alias("id"), "path", F.col("content").alias("text"))
    return tree_texts(rows, ["id"], "path")


def refreshed_communities(communities: DataFrame, files: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """Communities with a new summary where they are dirty or have none; the others keep theirs, unasked."""
    stale = F.col("is_dirty") | F.col("summary_text").isNull() | (F.col("summary_text") == "")
    need = stage(communities.where(stale).select("id"), "need")
    mine = files.withColumnRenamed("community_id", "id").join(need, "id", "left_semi").select("id", "path", F.col("content").alias("text"))
    texts = tree_texts(mine, ["id"], "path", call)
    none = F.pandas_udf(lambda s: s.map(lambda _: call("")), "string")
    bare = need.join(texts, "id", "left_anti").select("id", none("id").alias("text"))
    new = texts.unionByName(bare).withColumnRenamed("text", "_new")
    return communities.join(new, "id", "left").select("id", F.coalesce("_new", "summary_text").alias("summary_text"), F.when(stale, F.lit(False)).otherwise(F.col("is_dirty")).alias("is_dirty"))
