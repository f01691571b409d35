"""Tables at rest: versioned Parquet snapshots with one writer and many readers.

A write goes to a new data folder; then a manifest with the next number, which
lists the data folders of the version, is put in place by one rename.  The
manifest with the greatest number counts, so there is never a moment without
one, and a crash leaves the version before.  An append only adds a folder to the
list; after ``COMPACT_AFTER`` of them the table is written anew.  A reader keeps
the version it has opened, and no job reads what it overwrites.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrama.schemas import SCHEMAS, conform, split_valid
from engrama.staging import stage

COMPACT_AFTER = 32
#: Tables in which a later row of a key replaces the earlier ones.
KEYS = {"files": "path", "communities": "id"}


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self, table: str) -> list[int]:
        folder = self._path(f"{self.root}/{table}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, table: str) -> int | None:
        """Number of the current version; None before the first write."""
        return max(self._manifests(table), default=None)

    def _folders(self, table: str, version: int | None) -> list[str]:
        if version is None:
            return []
        stream = self._fs.open(self._path(f"{self.root}/{table}/manifests/{version}"))
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The current version, or a given one; an empty table with the fixed schema before the first write."""
        version = self.version(table) if version is None else version
        folders = self._folders(table, version)
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        parts = [self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{table}/{f}") for f in folders]
        key = KEYS.get(table)
        if key and len(parts) > 1:
            parts = [part.withColumn("_folder", F.lit(i)) for i, part in enumerate(parts)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        if key and len(parts) > 1:
            latest = Window.partitionBy(key).orderBy(F.desc("_folder"))
            out = out.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_folder")
        return out

    def _put(self, table: str, folders: list[str], after: int | None) -> int:
        number = 1 if after is None else after + 1
        temporary = self._path(f"{self.root}/{table}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray("\n".join(folders).encode()))
        stream.close()
        if not self._fs.rename(temporary, self._path(f"{self.root}/{table}/manifests/{number}")):
            raise RuntimeError(f"version {number} of {table} was written by someone else")
        return number

    def _data(self, table: str, df: DataFrame, partition_by: str | None = None) -> str:
        folder = uuid.uuid4().hex
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.root}/{table}/{folder}")
        return folder

    def write(self, table: str, df: DataFrame, partition_by: str | None = None) -> int:
        return self._put(table, [self._data(table, df, partition_by)], self.version(table))

    def transform(self, table: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """Write what a function makes of the current version; readers see the old one until then."""
        return self.write(table, change(self.read(table)))

    def reset(self, table: str) -> int:
        return self.write(table, self.spark.createDataFrame([], SCHEMAS[table]))

    def append(self, table: str, rows: DataFrame, strict: bool = True) -> DataFrame:
        """Add the rows that keep the table's constraints; returns the others.

        With ``strict`` there may be no others: they are an error, and nothing is added.
        """
        good, bad = split_valid(conform(rows, table), table)
        good = stage(good, "rows")
        if strict and not bad.isEmpty():
            raise ValueError(f"rows break the constraints of {table}")
        now = self.version(table)
        folders = [*self._folders(table, now), self._data(table, good)]
        self._put(table, folders, now)
        if len(folders) > COMPACT_AFTER:
            self.write(table, self.read(table))
        return bad


def with_ids(rows: DataFrame, existing: DataFrame, order: list[str], column: str = "id") -> DataFrame:
    """Number new rows after the greatest existing id, in the order of a natural key.

    The numbers come from per-partition counts of range-partitioned rows, so no
    single task sees all of them.
    """
    top = int(existing.agg(F.coalesce(F.max(column), F.lit(0))).first()[0])
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy(*order)
    numbered = stage(sorted_rows.withColumn("_n", F.row_number().over(w)), "ids")
    sizes = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}  # one row per partition
    offsets, total = {}, top
    for part in sorted(sizes):
        offsets[part] = total
        total += sizes[part]
    if not offsets:
        return numbered.drop("_part", "_n").withColumn(column, F.lit(None).cast("long"))
    offset = F.element_at(F.create_map(*(x for k, v in offsets.items() for x in (F.lit(k), F.lit(v).cast("long")))), F.col("_part"))
    return numbered.withColumn(column, (offset + F.col("_n")).cast("long")).drop("_part", "_n")


def bulk_nodes_and_edges(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add a batch whose edges may name nodes of the batch as ``idx_<batch_index>``.

    ``new_nodes`` has batch_index, ``new_edges`` source and target as text.  An edge
    replaces an older one of the same pair; later rows (seq) win within the batch.
    """
    numbered = with_ids(new_nodes, nodes, ["batch_index"])
    ids = numbered.select(F.concat(F.lit("idx_"), F.col("batch_index").cast("string")).alias("_ref"), F.col("id").alias("_id"))

    def resolved(df: DataFrame, column: str, out: str) -> DataFrame:
        j = df.join(ids, df[column] == ids["_ref"], "left")
        return j.withColumn(out, F.coalesce("_id", F.expr(f"try_cast({column} as bigint)"))).drop("_ref", "_id")

    e = resolved(resolved(new_edges, "source", "source_id"), "target", "target_id").where("source_id is not null and target_id is not null")
    last = Window.partitionBy("source_id", "target_id").orderBy(F.desc("seq"))
    e = e.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "source", "target", "seq")
    kept = edges.join(e.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti").select(*edges.columns)
    return nodes.unionByName(numbered.drop("batch_index"), allowMissingColumns=True), kept.unionByName(e, allowMissingColumns=True)


def updated(df: DataFrame, condition: Column, values: dict[str, Column], allowed: tuple[str, ...]) -> DataFrame:
    """Set whitelisted columns where the condition holds."""
    unknown = set(values) - set(allowed)
    if unknown:
        raise ValueError(f"columns can't be updated: {sorted(unknown)}")
    for name, value in values.items():
        df = df.withColumn(name, F.when(condition, value).otherwise(F.col(name)))
    return df


PROJECT_COLUMNS = ("folder_name", "primary_wing", "privacy_level", "summary", "updated_at")
NODE_COLUMNS = ("label", "summary", "content", "node_type", "type", "tags", "file_hash", "status", "last_accessed", "last_commit_at")


def update_project(projects: DataFrame, project: str, values: dict[str, Column], now: Column) -> DataFrame:
    return updated(projects, F.col("uuid") == project, values | {"updated_at": now}, PROJECT_COLUMNS)


def update_node(nodes: DataFrame, node_id: int, values: dict[str, Column]) -> DataFrame:
    return updated(nodes, F.col("id") == node_id, values, NODE_COLUMNS)


def upsert_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The collection after new rows of (doc_id, embedding, ..., metadata); null embeddings are skipped."""
    rows = new.where("embedding is not null and doc_id is not null").dropDuplicates(["doc_id"])
    return stored.join(rows.select("doc_id"), "doc_id", "left_anti").select(*stored.columns).unionByName(rows, allowMissingColumns=True)


def routed(vectors: DataFrame) -> DataFrame:
    """Collection of each row: metadata with a timestamp is episodic memory."""
    return vectors.withColumn("collection", F.when(F.map_contains_key("metadata", "timestamp"), F.lit("episodic_memory")).otherwise(F.lit("main")))


def clean_metadata(metadata: Column) -> Column:
    """A map without null values (they become empty text)."""
    return F.transform_values(metadata, lambda k, v: F.coalesce(v.cast("string"), F.lit("")))


def update_metadata(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """Vectors with the keys of ``changes(doc_id, metadata)`` set anew."""
    c = changes.select("doc_id", clean_metadata(F.col("metadata")).alias("_new")).dropDuplicates(["doc_id"])
    j = vectors.join(c, "doc_id", "left")
    old = F.map_filter("metadata", lambda k, v: ~F.map_contains_key(F.col("_new"), k))
    return j.withColumn("metadata", F.when(F.col("_new").isNotNull(), F.map_concat(old, F.col("_new"))).otherwise(F.col("metadata"))).drop("_new")


def valid_payload(metadata: Column) -> Column:
    """Whether episodic metadata has all its keys and a known scope."""
    keys = ("scope_type", "scope_id", "timestamp", "utility_alpha", "utility_beta")
    out = F.element_at(metadata, "scope_type").isin("user", "session", "agent", "org")
    for k in keys:
        out = out & F.map_contains_key(metadata, k)
    return F.coalesce(out, F.lit(False))
