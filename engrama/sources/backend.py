"""Vector backends: what a collection of vectors must offer, and one at rest in snapshots."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.operators import delta, search
from engrama.sources import access, snapshots


class VectorBackend(Protocol):
    """All methods take and return DataFrames, so a backend never holds a collection in the driver."""

    def rows(self) -> DataFrame: ...
    def store(self, rows: DataFrame) -> None: ...
    def delete(self, ids: DataFrame) -> None: ...
    def update_metadata(self, changes: DataFrame) -> None: ...
    def search(self, query: list[float], top_k: int = 10, projects: Iterable[str] | None = None) -> DataFrame: ...
    def stored_node_ids(self) -> DataFrame: ...
    def orphans(self, nodes: DataFrame) -> DataFrame: ...
    def count(self) -> int: ...
    def is_available(self) -> bool: ...
    def reset(self) -> None: ...


class SnapshotBackend:
    """A collection in the table ``vectors`` of a snapshot store."""

    def __init__(self, store: snapshots.SnapshotStore):
        self._store = store

    def rows(self) -> DataFrame:
        return self._store.read("vectors")

    def store(self, rows: DataFrame) -> None:
        self._store.transform("vectors", lambda old: snapshots.upsert_vectors(old, rows))

    def delete(self, ids: DataFrame) -> None:
        self._store.transform("vectors", lambda old: access.delete_vectors(old, ids))

    def update_metadata(self, changes: DataFrame) -> None:
        self._store.transform("vectors", lambda old: snapshots.update_metadata(old, changes))

    def search(self, query: list[float], top_k: int = 10, projects: Iterable[str] | None = None) -> DataFrame:
        return search.vector_search(search.prefiltered(self.rows(), None if projects is None else list(projects)), query, top_k)

    def stored_node_ids(self) -> DataFrame:
        return access.stored_node_ids(self.rows())

    def orphans(self, nodes: DataFrame) -> DataFrame:
        return delta.orphan_vectors(self.rows(), nodes)

    def count(self) -> int:
        return self.rows().select(F.lit(1)).count()

    def is_available(self) -> bool:
        return access.is_available(self.rows())

    def reset(self) -> None:
        self._store.reset("vectors")
