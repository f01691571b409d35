"""Reliable materialisation of intermediate results.

Iterative operators cut their lineage by writing a Parquet table into the
shared folder named by ``spark.checkpoint.dir``.  A written table survives the
loss of executors, keeps column pruning and gives the optimizer real sizes, so
small sides are broadcast only after their size is known.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_root: str | None = None
_staged: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``, else a temporary one.

    The temporary folder is used only with a ``local`` master, where driver and
    executors share one disk; on a cluster a missing setting is an error.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="engrama-")
    return f"file://{_local_root}"


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def staged_within(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all tables that are staged inside; results must have been written or collected by then."""
    first = len(_staged)
    try:
        yield
    finally:
        for owner, path in _staged[first:]:
            _delete(owner, path)
        del _staged[first:]


class Levels:
    """A staged table that grows by a level at a time, each a folder of it."""

    def __init__(self, spark: SparkSession, schema: str):
        self._spark, self._schema = spark, schema
        self._path = f"{shared_root(spark)}/levels-{uuid.uuid4().hex}"
        self._n = self.last_rows = 0
        _staged.append((spark, self._path))

    def add(self, df: DataFrame) -> None:
        """Write one more level; ``last_rows`` is the number of its rows, counted as they are written."""
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.option("compression", "zstd").parquet(f"{self._path}/level={self._n:06d}")
        self._n += 1
        self.last_rows = int(seen.get.get("n") or 0)

    def last(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(f"{self._path}/level={self._n - 1:06d}")

    def all(self) -> DataFrame:
        """All levels in one scan."""
        return self._spark.read.schema(self._schema).parquet(self._path).drop("level")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: only the local folder is left
            break
    if _local_root:
        import shutil

        shutil.rmtree(_local_root, ignore_errors=True)
