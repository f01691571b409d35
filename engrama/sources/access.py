"""Read access by SQL with parameters, and small operations on stored collections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.operators.delta import missing_vectors, orphan_vectors
from engrama.operators.embed import hashed_embedding, vectors_of
from engrama.sources.snapshots import upsert_vectors


def read_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], params: list[Any] | dict[str, Any] | None = None) -> DataFrame:
    """A SELECT over the given tables, with ``?`` or ``:name`` parameters.

    Anything but a query is refused; writes go through the snapshot store.
    """
    if not text.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only queries can be read")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=params or None)


def stored_node_ids(vectors: DataFrame) -> DataFrame:
    """Distinct node ids of a collection, from the column or else from ids ``node_<n>``."""
    parsed = F.expr("try_cast(regexp_extract(doc_id, '^node_([0-9]+)$', 1) as bigint)")
    return vectors.select(F.coalesce("node_id", parsed).alias("node_id")).where("node_id is not null").distinct()


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*vectors.columns)


def delete_edge(edges: DataFrame, source: int, target: int) -> DataFrame:
    return edges.where(~((F.col("source_id") == source) & (F.col("target_id") == target)))


def synced_vectors(nodes: DataFrame, vectors: DataFrame, project: str | None = None, embedder=hashed_embedding) -> DataFrame:
    """The collection without orphans and with the missing vectors embedded, of one or all projects.

    Vectors of other projects are left alone.
    """
    mine = vectors if project is None else vectors.where(F.col("project_uuid") == project)
    clean = delete_vectors(vectors, orphan_vectors(mine, nodes))
    lost = missing_vectors(nodes if project is None else nodes.where(F.col("project_uuid") == project), clean)
    return upsert_vectors(clean, vectors_of(nodes.join(lost.select("id"), "id", "left_semi"), embedder))


def is_available(vectors: DataFrame | None) -> bool:
    """Whether a collection can be searched; None stands for the text-only mode."""
    if vectors is None:
        return False
    try:
        vectors.select("doc_id", "embedding").limit(1).collect()
        return True
    except Exception:  # whatever the storage raises
        return False

