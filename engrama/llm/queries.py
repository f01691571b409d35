"""Named queries of the training-data operators, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm import credentials, handwritten, leakage, neighbours, packing, reading, splitting
from engrama.tables import table

#: Parameter: file of a public tokenizer, present on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Parameter: texts that one container may join.
MAX_SEGMENTS = 64
#: Parameter: loss-bearing tokens that a container may hold, as a share of its tokens.
LOSS_SHARE = 31 / 32


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut."""
    return splitting.oversized(p1_pieces(spark, d))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk as ordered pieces within its category's limit."""
    return splitting.split_items(table(spark, d, "parsed_chunks"), table(spark, d, "size_limits"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other nodes of every usable current embedding."""
    found = neighbours.nearest(table(spark, d, "vectors"), 10)
    return found.select("node_id", "neighbour_id", F.round("similarity", 6).alias("similarity"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least 0.80 in which one is among the ten nearest of the other."""
    return neighbours.similar_pairs(neighbours.nearest(table(spark, d, "vectors"), 10), 0.80)


def p5_credentials(spark: SparkSession, d: str) -> DataFrame:
    """Place and score of every credential; the value itself is not given out."""
    found = credentials.find_credentials(table(spark, d, "nodes"))
    return found.groupBy("node_id", "line_no").agg(F.round(F.max("score"), 3).alias("score"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a credential begins."""
    return credentials.find_credentials(table(spark, d, "nodes")).select("node_id", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Contents that hold credentials, with these redacted."""
    nodes = table(spark, d, "nodes")
    return credentials.redact(nodes, credentials.find_credentials(nodes))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """Why each current code file is, or is not, hand-written."""
    return handwritten.not_handwritten(table(spark, d, "crawl_results"), table(spark, d, "nodes"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Code files that nobody in the project wrote by hand."""
    return p6_files(spark, d).where("generated or minified or data or vendored").select("file_id")


def _capacity(spark: SparkSession, d: str) -> packing.Capacity:
    row = table(spark, d, "size_limits").where("purpose = 'fill'").agg({"max_tokens": "min"}).first()
    tokens = int(row[0])
    return packing.Capacity(tokens, MAX_SEGMENTS, int(tokens * LOSS_SHARE))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text of documents with its container."""
    return packing.pack_documents(table(spark, d, "documents"), _capacity(spark, d), TOKENIZER)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p7_pack(spark, d), _capacity(spark, d))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document and item that leaked into it, with the words covered."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold test passages, with these cut out."""
    docs = table(spark, d, "documents")
    return leakage.without_spans(docs, p8_leaks(spark, d))


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold no test passage."""
    docs = table(spark, d, "documents")
    return leakage.without_documents(docs.select("doc_id", "text"), p8_leaks(spark, d)).select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every text."""
    docs = table(spark, d, "documents")
    return reading.reading_levels(docs, reading.fit(docs, table(spark, d, "reading_labels")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document of at least 60 words."""
    return p9_levels(spark, d).where("n_words >= 60").select("doc_id", "reading_level")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p4_found, p4_neighbours, p5_found, p5_credentials, p5_redacted, p6_found, p6_files, p7_pack, p7_fill, p8_found, p8_leaks, p8_clean, p8_kept, p9_found, p9_levels)
}

SQL = {
    "p4_found": """
WITH ranked AS (
  SELECT node_id, embedding, row_number() OVER (PARTITION BY doc_id ORDER BY stored_at DESC, embedding DESC) AS rn FROM vectors
),
pts AS (
  SELECT node_id, CAST(embedding AS DOUBLE[]) AS e FROM ranked
  WHERE rn = 1 AND len(embedding) = 384 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
),
sims AS (SELECT a.node_id AS a, b.node_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM pts a JOIN pts b ON a.node_id <> b.node_id),
top AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rk FROM sims)
SELECT DISTINCT least(a, b) AS node_id_a, greatest(a, b) AS node_id_b FROM top WHERE rk <= 10 AND s >= 0.8""",
    "p1_found": """
SELECT DISTINCT c.chunk_id FROM parsed_chunks c JOIN size_limits s ON s.purpose = 'split' AND s.category = c.category
WHERE greatest(1, length(c.content) // 4) > s.max_tokens""",
}
