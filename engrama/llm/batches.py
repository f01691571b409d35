"""Arrow batches bounded in bytes, for texts of very different lengths."""

from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch exceed ``BATCH_BYTES`` (but for a single larger row)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
