"""Structured Streaming over an append-only log of file changes, and windows over events.

The file source reads each file once, so changes come as a log of rows (path,
content, seq), not by watching the tree itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engrama.operators.delta import changed_files, community_states
from engrama.operators.relational import current
from engrama.sources.ignore import IgnoreRules
from engrama.sources.snapshots import SnapshotStore

CHANGE_SCHEMA = "path string, content string, is_directory boolean, seq long, changed_at timestamp"


def change_stream(spark: SparkSession, log_dir: str, rules: IgnoreRules | None = None, max_files: int = 1000) -> DataFrame:
    """Changes of files, but for directories and ignored paths, which are dropped before the content is used."""
    raw = spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", max_files).json(log_dir)
    return raw.where(~F.coalesce("is_directory", F.lit(False))).where(~(rules or IgnoreRules()).column(F.col("path")))


def apply_changes(store: SnapshotStore, batch: DataFrame) -> DataFrame:
    """Bring the tables files and communities up to date with one batch; the files it names.

    Only rows of these files and their communities are written, as later rows of their keys.
    """
    from engrama.functions.text import parent_dir
    from engrama.staging import stage

    last = current(batch, ["path"], [F.desc("seq")]).select("path", "content", parent_dir(F.col("path"), "root").alias("community_id"))
    last = stage(last, "last")
    before = store.read("files")
    files = stage(changed_files(before.join(last.select("path"), "path", "left_semi"), last), "files")
    near = files.select("community_id").where("community_id is not null").distinct()
    others = before.join(near, "community_id", "left_semi").join(files.select("path"), "path", "left_anti")
    states = others.select("path", "community_id", "is_dirty").unionByName(files.select("path", "community_id", "is_dirty"))
    known = store.read("communities").join(near.withColumnRenamed("community_id", "id"), "id", "left_semi")
    communities = stage(community_states(known, states).drop("n_dirty"), "communities")
    store.append("files", files.drop("changed"))
    store.append("communities", communities)
    return files.select("path", "changed")


def watch(changes: DataFrame, store: SnapshotStore, checkpoint: str, callback: Callable[[DataFrame], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Run ``apply_changes`` on every micro-batch; a replayed batch gives the same tables."""

    def run(batch: DataFrame, batch_id: int) -> None:
        done = apply_changes(store, batch)
        if callback:
            callback(done)

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def maintenance_loop(spark: SparkSession, job: Callable[[], DataFrame], checkpoint: str, seconds: int = 300, history: SnapshotStore | None = None, stopped: Callable[[], bool] = lambda: False) -> StreamingQuery:
    """Call a maintenance job every ``seconds``, until the query is stopped; nothing is done while ``stopped`` says so.

    The report that the job returns is added to the table ``maintenance_reports`` of ``history``.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(batch: DataFrame, batch_id: int) -> None:
        if stopped():
            return
        report = job()
        if history is None:
            report.collect()
        else:
            history.append("maintenance_reports", report.withColumn("finished_at", F.current_timestamp()))

    return ticks.writeStream.foreachBatch(run).trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, window: str, late: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Counts per tumbling window; rows later than ``late`` behind the newest are dropped from a stream."""
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n_events")).select(F.col("w.start").alias("window_start"), *keys, "n_events")


def sessions(events: DataFrame, gap: str, late: str, key: str, ts: str = "ts") -> DataFrame:
    """Sessions per key that end after a gap."""
    out = events.withWatermark(ts, late) if events.isStreaming else events
    w = F.session_window(ts, gap).alias("w")
    return out.groupBy(w, key).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def idle(last_started: Column, finished: Column, now: Column, stuck_seconds: int = 300) -> Column:
    """Whether no ingest runs: it has finished, or has been stuck for too long."""
    return finished | ((F.unix_micros(now) - F.unix_micros(last_started)) / 1e6 > stuck_seconds)
