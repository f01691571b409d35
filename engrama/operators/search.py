"""Retrieval: phrase search, vector search, hybrid ranking, reranking and self-healing."""

from __future__ import annotations

import typing
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions import scoring
from engrama.functions.text import n_tokens, normal, phrase_hits
from engrama.operators.relational import in_degree

if typing.TYPE_CHECKING:
    from engrama.operators.text_index import TextIndex

SYMBOL_ORDER = ("class", "function", "method")


def token_frame(nodes: DataFrame) -> DataFrame:
    """The derived text index: normal form of label, tags and summary, and their length."""
    out = nodes
    for c in ("label", "tags", "summary"):
        out = out.withColumn(f"n_{c}", normal(F.col(c)))
    return out.withColumn("n_length", n_tokens(F.col("n_label")) + n_tokens(F.col("n_tags")) + n_tokens(F.col("n_summary")))


def mean_length(tokens: DataFrame) -> float:
    """Mean length over all rows of all projects; 0 for an empty table."""
    return float(tokens.agg(F.avg("n_length")).first()[0] or 0.0)


def phrase_matches(tokens: DataFrame, phrase: str) -> DataFrame:
    """Rows that hold the phrase in some column, with ``hits``; no words match nothing."""
    hits = phrase_hits(F.col("n_label"), phrase) + phrase_hits(F.col("n_tags"), phrase) + phrase_hits(F.col("n_summary"), phrase)
    return tokens.withColumn("hits", hits).where("hits > 0")


def text_search(tokens: DataFrame, phrase: str, project: str | None = None, node_type: str | None = None, limit: int = 20) -> DataFrame:
    """(id, bm25_score): the best ``limit`` rows, scores divided by the best of them.

    All rows of a phrase share its inverse document frequency, which therefore
    cancels out.  The limit comes before the division, as rank order.
    """
    mean = mean_length(tokens)
    m = phrase_matches(tokens, phrase)
    for column, value in (("project_uuid", project), ("node_type", node_type)):
        if value is not None:
            m = m.where(F.col(column) == value)
    raw = m.select("id", scoring.saturation(F.col("hits"), F.col("n_length"), F.lit(mean or 1.0)).alias("raw"))
    top = raw.orderBy(F.desc("raw"), F.asc("id")).limit(limit)
    best = F.max("raw").over(Window.partitionBy(F.lit(0)))  # at most ``limit`` rows
    return top.select("id", F.round(F.col("raw") / best, 4).alias("bm25_score"))


def symbol_search(tokens: DataFrame, phrase: str, project: str | None = None, limit: int = 50) -> DataFrame:
    """Classes, then functions, then methods that hold the phrase; by id."""
    m = phrase_matches(tokens.where(F.col("type").isin(*SYMBOL_ORDER)), phrase)
    if project is not None:
        m = m.where(F.col("project_uuid") == project)
    rank = F.when(F.col("type") == "class", 1).when(F.col("type") == "function", 2).otherwise(3)
    return m.select("id", "label", "type", "project_uuid", rank.alias("symbol_rank")).orderBy("symbol_rank", "id").limit(limit)


def prefiltered(vectors: DataFrame, projects: list[str] | DataFrame | None = None, equal: dict[str, str] | None = None) -> DataFrame:
    """Vectors of the given projects, further columns equal to the given values."""
    if isinstance(projects, DataFrame):
        vectors = vectors.join(projects.select("project_uuid").distinct(), "project_uuid", "left_semi")
    elif projects is not None:
        vectors = vectors.where(F.col("project_uuid").isin(*projects))
    for column, value in (equal or {}).items():
        vectors = vectors.where(F.col(column) == value)
    return vectors


def vector_search(vectors: DataFrame, query: list[float], top_k: int = 10) -> DataFrame:
    """(node_id, vector_score): exact cosine, negatives as 0, best ``top_k`` rows."""
    score = scoring.cosine(F.col("embedding"), F.lit([float(x) for x in query]))
    scored = vectors.select("node_id", score.alias("s")).where("s is not null")
    return scored.select("node_id", F.round(F.greatest("s", F.lit(0.0)), 4).alias("vector_score")).orderBy(F.desc("vector_score"), F.asc("node_id")).limit(top_k)


def scoped_projects(projects: DataFrame, wings: DataFrame | None, anchor: str, include_references: bool = False, all_wings: bool = False) -> DataFrame:
    """Projects of the anchor's wing, of its reference wings too, or all; latest update first."""
    if not all_wings:
        own = projects.where(F.col("uuid") == anchor).select(F.col("primary_wing").alias("wing"))
        if include_references and wings is not None:
            own = own.unionByName(wings.where(F.col("project_uuid") == anchor).select(F.col("wing_name").alias("wing")))
        projects = projects.join(own.distinct(), F.col("primary_wing") == F.col("wing"), "left_semi")
    return projects.select(F.col("uuid").alias("project_uuid"), "folder_name", "updated_at").orderBy(F.desc("updated_at"), "project_uuid")


def score_candidates(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """Hybrid score of (node_id, vector_score, text_score), with its parts."""
    ids = candidates.select(F.col("node_id").alias("id"))
    deg = in_degree(edges.join(ids.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")).withColumnRenamed("id", "node_id")
    seen = nodes.select(F.col("id").alias("node_id"), "last_commit_at")
    c = candidates.join(deg, "node_id", "left").join(seen, "node_id", "left")
    central = scoring.centrality(F.col("in_degree"))
    recent = scoring.recency(F.col("last_commit_at"), now)
    return c.select(
        "node_id",
        scoring.hybrid(F.col("vector_score"), F.col("text_score"), recent, central).alias("score_final"),
        F.struct(
            F.round("vector_score", 4).alias("vetorial"),
            F.round("text_score", 4).alias("frequencia"),
            F.round(recent, 4).alias("recencia"),
            F.round(central, 4).alias("centralidade"),
        ).alias("score_breakdown"),
        (central >= 1.0).alias("is_super_node"),
    )


def hybrid_search(
    nodes: DataFrame,
    edges: DataFrame,
    vectors: DataFrame | None,
    phrase: str,
    query: list[float] | None,
    now: Column,
    text_project: str | None = None,
    scope: DataFrame | None = None,
    node_type: str | None = None,
    top_k: int = 10,
    index: TextIndex | None = None,
) -> DataFrame:
    """The flagship query: vectors and phrase, recency and centrality in one ranking.

    Text is limited to the anchor project, vectors to the whole scope.  Without
    a query vector or a collection it is a text search with vector scores of 0.
    With a stored ``index`` no text is read.
    """
    found = index.search(phrase, text_project, node_type) if index else text_search(token_frame(nodes), phrase, text_project, node_type)
    text = found.select(F.col("id").alias("node_id"), F.col("bm25_score").alias("text_score"))
    if vectors is None or query is None:
        merged = text.select("node_id", F.lit(0.0).alias("vector_score"), "text_score")
    else:
        v = prefiltered(vectors, scope, {"node_type": node_type} if node_type else None)
        hits = vector_search(v, query, 3 * top_k).groupBy("node_id").agg(F.max("vector_score").alias("vector_score"))
        merged = hits.join(text, "node_id", "full").select(
            "node_id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("text_score", F.lit(0.0)).alias("text_score")
        )
    ranked = score_candidates(merged, nodes, edges, now)
    return ranked.orderBy(F.desc("score_final"), F.asc("node_id")).limit(top_k)


def enriched(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """Results with label, summary and tags; results whose node is gone are dropped."""
    n = nodes.select(F.col("id").alias("node_id"), "label", "summary", "tags")
    return results.join(n, "node_id")


def rerank(results: DataFrame, max_results: int = 5, share: float = 0.30) -> DataFrame:
    """The first ``max_results``, then those of at least ``share`` of the best; never none."""
    first = results.orderBy(F.desc("score_final"), F.asc("node_id")).limit(max_results)
    best = F.max("score_final").over(Window.partitionBy(F.lit(0)))  # at most ``max_results`` rows
    return first.withColumn("_best", best).where((F.col("score_final") >= share * F.col("_best")) | (F.col("score_final") == F.col("_best"))).drop("_best")


def rerank_judged(results: DataFrame, judge: Callable[[int], float], max_results: int = 5, least: float = 0.5) -> DataFrame:
    """The first ``max_results``, then those an injected function finds relevant enough, most relevant first; never none."""
    first = results.orderBy(F.desc("score_final"), F.asc("node_id")).limit(max_results)
    udf = F.pandas_udf(lambda s: s.map(lambda i: float(judge(int(i)))), "double")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("relevance"), F.desc("score_final"), F.asc("node_id"))  # at most ``max_results`` rows
    ranked = first.withColumn("relevance", udf("node_id")).withColumn("_r", F.row_number().over(w))
    return ranked.where((F.col("relevance") >= least) | (F.col("_r") == 1)).drop("_r").orderBy(F.desc("relevance"), F.desc("score_final"), F.asc("node_id"))


def self_healed(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits (id, score) whose file still exists, in order; the limit came before."""
    return hits.join(files.select(F.col("path").alias("id")).distinct(), "id", "left_semi").orderBy(F.desc("score"), "id")


def thompson(results: DataFrame, utilities: DataFrame, seed: int, key: str = "node_id", score: str = "score_final") -> DataFrame:
    """Scores times one Beta(alpha, beta) draw per row, seeded by (seed, key); missing is Beta(1, 1)."""
    @F.pandas_udf("double")
    def draw(ids: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(i) & 0xFFFFFFFFFFFFFFFF]).beta(x, y) for i, x, y in zip(ids, a, b)])

    u = utilities.select(key, "utility_alpha", "utility_beta")
    j = results.join(u, key, "left")
    m = draw(F.xxhash64(F.col(key)), F.coalesce("utility_alpha", F.lit(1.0)), F.coalesce("utility_beta", F.lit(1.0)))
    return j.withColumn("thompson_multiplier", m).withColumn(score, F.round(F.col(score) * F.col("thompson_multiplier"), 4)).drop("utility_alpha", "utility_beta")


def thompson_retrieve(hits: DataFrame, utilities: DataFrame, seed: int, top_k: int = 3) -> DataFrame:
    """The best ``top_k`` of (id, score) after sampling."""
    return thompson(hits, utilities, seed, "id", "score").orderBy(F.desc("score"), "id").limit(top_k)
