"""Embedding of texts: an injected function, or a deterministic hashing embedder."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 384


def hashed_embedding(text: str, dim: int = DIM) -> list[float] | None:
    """Signed hashes of words and word pairs, scaled to length 1; None for a text without words."""
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return None
    v = np.zeros(dim, np.float64)
    for w in (*words, *map(" ".join, zip(words, words[1:]))):
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h & 0x80000000 else -1.0
    size = np.linalg.norm(v)
    return [float(x) for x in (v / size).astype(np.float32)] if size else None


def embedded(rows: DataFrame, text: str, function: Callable[[str], list[float] | None] = hashed_embedding) -> DataFrame:
    """Rows with ``embedding``; null where the function fails or the text is null."""
    import pyspark.sql.types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def safe(t: str | None) -> list[float] | None:
        try:
            return None if t is None else function(t)
        except Exception:  # whatever an injected function raises
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(embedding=[safe(t) for t in pdf[text]])

    return rows.mapInPandas(run, schema)


def fact_vectors(facts: DataFrame, function: Callable[[str], list[float] | None] = hashed_embedding) -> DataFrame:
    """Episodic rows (doc_id ``fact_<id>``, embedding, metadata) of facts."""
    meta = F.create_map(
        F.lit("scope_type"), F.col("scope_type"), F.lit("scope_id"), F.col("scope_id"), F.lit("timestamp"), F.col("t_valid").cast("string"), F.lit("utility_alpha"), F.col("utility_alpha").cast("string"), F.lit("utility_beta"), F.col("utility_beta").cast("string"),
    )
    rows = facts.select(F.concat(F.lit("fact_"), F.col("id").cast("string")).alias("doc_id"), "fact_statement", meta.alias("metadata"))
    return embedded(rows, "fact_statement", function).where("embedding is not null").select("doc_id", "embedding", "metadata")


def vectors_of(nodes: DataFrame, function: Callable[[str], list[float] | None] = hashed_embedding) -> DataFrame:
    """Vector rows (doc_id, embedding, node_id, project_uuid) of nodes with content."""
    n = nodes.where("content is not null and content <> ''").select(F.concat(F.lit("node_"), F.col("id").cast("string")).alias("doc_id"), F.col("id").alias("node_id"), "project_uuid", "content")
    return embedded(n, "content", function).where("embedding is not null").select("doc_id", "embedding", "node_id", "project_uuid")
