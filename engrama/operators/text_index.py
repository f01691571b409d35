"""A stored inverted index over label, tags and summary.

Postings (token, id, column, position) lie in ``BUCKETS`` partitions by a hash of
the token, sorted by it, each with what scoring and filters need of its row.  A
phrase reads the partitions of its own words only, and of these the row groups
that hold them; no text is read or normalised at query time.

Defined cases
-------------
* a phrase without words finds nothing; an empty table has an empty index.
* results equal those of ``search.text_search`` over the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrama.functions import scoring
from engrama.functions.text import phrase_words
from engrama.operators.search import token_frame

BUCKETS = 256
KEPT = ("project_uuid", "node_type", "type")


class TextIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.mean = float(spark.read.parquet(f"{root}/mean").first()[0] or 0.0)

    @classmethod
    def build(cls, nodes: DataFrame, root: str) -> TextIndex:
        """Write the index of (id, label, tags, summary, project_uuid, node_type, type) below ``root``."""
        tokens = token_frame(nodes)
        columns = F.array(*(F.split(F.trim(f"n_{c}"), " ") for c in ("label", "tags", "summary")))
        lists = tokens.select("id", *KEPT, "n_length", F.posexplode(columns).alias("column", "words"))
        rows = lists.select("id", *KEPT, "n_length", "column", F.posexplode("words").alias("position", "token")).where("token <> ''")
        bucket = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")
        placed = rows.withColumn("bucket", bucket)
        # a frequent token is spread over tasks by its rows' ids
        placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(f"{root}/postings")
        tokens.agg(F.avg("n_length").alias("mean")).coalesce(1).write.parquet(f"{root}/mean")
        return cls(nodes.sparkSession, root)

    def postings(self, words: list[str]) -> DataFrame:
        """The postings of some words, out of their partitions."""
        place = self.spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(BUCKETS)).cast("int").alias(f"w{i}") for i, w in enumerate(words))).first()
        schema = "id long, project_uuid string, node_type string, type string, n_length int, column int, position int, token string, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.root}/postings").where(F.col("bucket").isin(*set(place)) & F.col("token").isin(*set(words)))

    def matches(self, phrase: str) -> DataFrame:
        """(id, project_uuid, node_type, type, n_length, hits) of the rows that hold the phrase."""
        words = phrase_words(phrase)
        if not words:
            return self.postings([""]).select("id", *KEPT, "n_length", F.lit(0).alias("hits")).where("false")
        steps = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(words)))
        begins = F.transform(F.filter(steps, lambda s: s["w"] == F.col("token")), lambda s: F.col("position") - s["i"])
        found = self.postings(words).withColumn("begin", F.explode(begins))
        whole = found.groupBy("id", *KEPT, "n_length", "column", "begin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words))
        return whole.groupBy("id", *KEPT, "n_length").agg(F.count(F.lit(1)).alias("hits"))

    def search(self, phrase: str, project: str | None = None, node_type: str | None = None, limit: int = 20, where: Column | None = None) -> DataFrame:
        """(id, bm25_score) as ``search.text_search`` gives them."""
        m = self.matches(phrase)
        for column, value in (("project_uuid", project), ("node_type", node_type)):
            if value is not None:
                m = m.where(F.col(column) == value)
        if where is not None:
            m = m.where(where)
        raw = m.select("id", scoring.saturation(F.col("hits"), F.col("n_length"), F.lit(self.mean or 1.0)).alias("raw"))
        top = raw.orderBy(F.desc("raw"), F.asc("id")).limit(limit)
        best = F.max("raw").over(Window.partitionBy(F.lit(0)))  # at most ``limit`` rows
        return top.select("id", F.round(F.col("raw") / best, 4).alias("bm25_score"))
