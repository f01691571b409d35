"""Hybrid search for a whole set of queries in one plan.

The query set is held by every task (a larger one is searched in blocks, of
which the driver too holds one at a time), vectors stream past each block once,
and each task keeps only its best rows per query.  Equal phrases are searched
once; they meet the text by an equi-join on their first word, so a text is
looked at only for phrases that could match it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrama.functions import scoring
from engrama.functions.text import phrase_words
from engrama.operators.relational import in_degree
from engrama.operators.search import mean_length, token_frame
from engrama.staging import stage

#: Queries whose vectors one task holds at a time (about 3 MB per thousand at 384 numbers).
BLOCK = 4096
#: Scores that a task computes at a time (8 MB each for them, their keys and their order).
CELLS = 1 << 20


def vector_search_batch(vectors: DataFrame, queries: Iterable[tuple[int, list[float]]], top_k: int) -> DataFrame:
    """(query_id, node_id, vector_score): exact cosine, the best ``top_k`` nodes of each query."""
    spark = vectors.sparkSession
    parts, queries = None, iter(queries)
    while block := list(islice(queries, BLOCK)):
        q = np.array([v for _, v in block], np.float64)
        size = np.linalg.norm(q, axis=1, keepdims=True)
        held = spark.sparkContext.broadcast((np.array([i for i, _ in block], np.int64), np.divide(q, size, out=np.zeros_like(q), where=size > 0)))
        dim = q.shape[1]
        rows = vectors.where((F.size("embedding") == dim) & F.col("node_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())).select("node_id", "embedding")
        found = rows.mapInArrow(_scanner(held, dim, top_k), "query_id long, node_id long, vector_score double")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], "query_id long, node_id long, vector_score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), F.asc("node_id"))
    best = parts.groupBy("query_id", "node_id").agg(F.max("vector_score").alias("vector_score"))
    return best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r")


def _scanner(held, dim: int, top_k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        best_s = np.zeros((len(ids), 0))
        best_n = np.zeros((len(ids), 0), np.int64)
        step = max(1, CELLS // len(ids))
        for batch in batches:
            vectors = np.asarray(batch.column("embedding").flatten(), np.float64).reshape(-1, dim)
            nodes = batch.column("node_id").to_numpy(zero_copy_only=False)
            for at in range(0, len(nodes), step):
                x, node = vectors[at : at + step], nodes[at : at + step]
                size = np.linalg.norm(x, axis=1)
                ok = np.flatnonzero((size > 0) & np.isfinite(size))
                ok = ok[np.argsort(node[ok], kind="stable")]
                node = node[ok]
                s = np.round(np.maximum(q @ (x[ok] / size[ok, None]).T, 0.0) + 1e-12, 4)
                if s.shape[1] > top_k:  # scores have four places: as a number with the node's rank, their order is exact
                    key = np.arange(len(node)) - np.rint(s * 1e4).astype(np.int64) * len(node)
                    part = np.argpartition(key, top_k - 1, axis=1)[:, :top_k]
                    s, n = np.take_along_axis(s, part, 1), node[part]
                else:
                    n = np.broadcast_to(node, s.shape)
                s, n = np.concatenate([best_s, s], axis=1), np.concatenate([best_n, n], axis=1)
                order = np.lexsort((n, -s), axis=1)[:, :top_k]
                best_s, best_n = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)
        k = best_s.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(best_n.ravel()), pa.array(best_s.ravel())], ["query_id", "node_id", "vector_score"])

    return scan


def text_search_batch(tokens: DataFrame, phrases: list[tuple[int, str]], limit: int = 20) -> DataFrame:
    """(query_id, node_id, text_score) of every phrase, as ``text_search`` gives it for one."""
    spark = tokens.sparkSession
    rows = [(i, " ".join(w)) for i, p in phrases if (w := phrase_words(p))]
    asked = spark.createDataFrame(rows, "query_id long, phrase string")
    q = spark.createDataFrame([(p.split()[0], p) for p in sorted({p for _, p in rows})], "word string, phrase string")
    mean = mean_length(tokens)
    words = F.array_distinct(F.filter(F.split(F.concat("n_label", "n_tags", "n_summary"), " "), lambda x: x != ""))
    each = tokens.select("id", "n_label", "n_tags", "n_summary", "n_length", F.explode(words).alias("word"))
    hit = F.concat(F.lit("(?= "), F.col("phrase"), F.lit(" )"))
    count = F.regexp_count("n_label", hit) + F.regexp_count("n_tags", hit) + F.regexp_count("n_summary", hit)
    m = each.join(q, "word").withColumn("hits", count).where("hits > 0")
    raw = m.select("phrase", F.col("id").alias("node_id"), scoring.saturation(F.col("hits"), F.col("n_length"), F.lit(mean or 1.0)).alias("raw"))
    w = Window.partitionBy("phrase").orderBy(F.desc("raw"), F.asc("node_id"))
    top = raw.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    best = F.max("raw").over(Window.partitionBy("phrase"))
    scored = top.select("phrase", "node_id", F.round(F.col("raw") / best, 4).alias("text_score"))
    return asked.join(scored, "phrase").select("query_id", "node_id", "text_score")


def hybrid_search_batch(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, queries: Iterable[tuple[int, str, list[float]]], now: Column, top_k: int = 10) -> DataFrame:
    """(query_id, node_id, score_final): the ranking of ``hybrid_search`` for each (id, phrase, vector)."""
    phrases: list[tuple[int, str]] = []

    def embeddings() -> Iterator[tuple[int, list[float]]]:
        for i, p, e in queries:
            phrases.append((i, p))
            yield i, e

    v = vector_search_batch(vectors, embeddings(), 3 * top_k)  # reads all queries
    tokens = stage(token_frame(nodes.select("id", "label", "tags", "summary")).select("id", "n_label", "n_tags", "n_summary", "n_length"), "tokens")
    t = text_search_batch(tokens, phrases)
    m = v.join(t, ["query_id", "node_id"], "full").select("query_id", "node_id", F.coalesce("vector_score", F.lit(0.0)).alias("v"), F.coalesce("text_score", F.lit(0.0)).alias("t"))
    m = stage(m, "merged")  # at most 3 k + 20 rows per query
    degree = in_degree(edges.join(m.select(F.col("node_id").alias("target_id")).distinct(), "target_id", "left_semi")).withColumnRenamed("id", "node_id")
    seen = nodes.select(F.col("id").alias("node_id"), "last_commit_at")
    scored = m.join(degree, "node_id", "left").join(seen, "node_id", "left").select(
        "query_id", "node_id", scoring.hybrid(F.col("v"), F.col("t"), scoring.recency(F.col("last_commit_at"), now), scoring.centrality(F.col("in_degree"))).alias("score_final")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score_final"), F.asc("node_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
