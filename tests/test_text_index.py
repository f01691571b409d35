import random

from helpers import rows
from pyspark.sql import functions as F

from engrama.operators import search
from engrama.operators.text_index import TextIndex

SCHEMA = "id long, project_uuid string, label string, summary string, tags string, node_type string, type string"


def test_index_equals_the_scan(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("alpha beta beta gamma Delta ação x_1".split()) for _ in range(rng.randrange(12)))
    data = [(i, rng.choice(["p", "q", None]), text(), rng.choice([None, text()]), rng.choice([None, "", text()]), rng.choice(["FACT", "CLASS"]), "file") for i in range(300)]
    n = spark.createDataFrame([*data, data[0]], SCHEMA).dropDuplicates(["id"])
    index = TextIndex.build(n, f"file://{tmp_path}/i")
    tokens = search.token_frame(n)
    for phrase in ("alpha", "beta beta", "beta gamma", "ACAO", "acao x 1", "nowhere", "", "beta beta beta"):
        assert rows(index.search(phrase), "id", "bm25_score") == rows(search.text_search(tokens, phrase), "id", "bm25_score"), phrase
    assert rows(index.search("beta", "p", "FACT", 5), "id", "bm25_score") == rows(search.text_search(tokens, "beta", "p", "FACT", 5), "id", "bm25_score")
    assert {f.split("bucket=")[1].split("/")[0] for f in index.postings(["alpha"]).inputFiles()} and "PartitionFilters: [isnotnull(bucket" in index.postings(["alpha"])._jdf.queryExecution().toString()


def test_empty_index(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e")
    assert index.search("a").count() == 0 and index.search("").count() == 0
