"""Crawling a source tree into file rows: hash, category and delta."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.operators import delta
from engrama.sources.ignore import IgnoreRules

MAX_FILE_BYTES = 10 * 1024 * 1024
# File extensions by category.
EXTENSIONS = {
    "code": (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".cpp", ".c", ".h", ".hpp", ".rb", ".cs", ".swift", ".kt", ".php", ".lua", ".sh", ".bash", ".ps1", ".sql", ".r", ".scala", ".ex", ".exs"),
    "doc": (".md", ".txt", ".rst", ".adoc", ".org"),
    "config": (".json", ".yaml", ".yml", ".toml", ".env", ".ini", ".cfg", ".xml", ".properties"),
    "conversation": (".log", ".chat"),
}


def extension(path: Column) -> Column:
    """The extension in lower case with its dot; null without one (also of hidden files)."""
    e = F.regexp_extract(F.lower(path), r"[^/\\](\.[^./\\]+)$", 1)
    return F.when(e != "", e)


def category(path: Column) -> Column:
    e = extension(path)
    out = F.lit("unknown")
    for name, kinds in EXTENSIONS.items():
        out = F.when(e.isin(*kinds), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


#: Files of ignore rules in a tree's root; later ones are added to earlier ones.
IGNORE_FILES = (".gitignore", ".engramaignore")


def rules_of(spark: SparkSession, root: str, rules: IgnoreRules | None = None, names: tuple[str, ...] = IGNORE_FILES) -> IgnoreRules:
    """The given or built-in rules, and those of the ignore files in ``root``."""
    rules = copy.deepcopy(rules) if rules else IgnoreRules()
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.getFileStatus(path).isFile():
            stream = fs.open(path)
            try:
                rules.add(bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines())
            finally:
                stream.close()
    return rules


def files_of(spark: SparkSession, root: str, rules: IgnoreRules | None = None, with_content: bool = False) -> DataFrame:
    """One row per file under ``root`` that the rules let pass, empty and large ones left out.

    The path and size filters come before the content is read.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.col("path"), r"^(?:file:)?/*" + _escape(base.removeprefix("file:").lstrip("/")) + "/", "")
    kept = raw.withColumn("relative_path", rel).where((F.col("length") > 0) & (F.col("length") <= MAX_FILE_BYTES)).where(~(rules or IgnoreRules()).column(F.col("relative_path")))
    cols = [
        F.regexp_replace("path", "^file:", "").alias("absolute_path"), "relative_path", F.sha2("content", 256).alias("file_hash"), category(F.col("relative_path")).alias("category"),
        extension(F.col("relative_path")).alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
    ]
    if with_content:
        cols.append(F.decode("content", "utf-8").alias("content"))
    return kept.select(*cols)


def _escape(text: str) -> str:
    import re

    return re.escape(text)


def crawl(spark: SparkSession, root: str, project: str, nodes: DataFrame, rules: IgnoreRules | None = None, with_content: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files with is_new, nodes of deleted files, a report of one row) of one project."""
    files = files_of(spark, root, rules_of(spark, root, rules), with_content).withColumn("project_uuid", F.lit(project))
    mine = nodes.where(F.col("project_uuid") == project)
    seen = delta.file_delta(files, mine)
    gone = delta.deleted_file_nodes(mine, files.withColumnRenamed("relative_path", "path"))
    report = seen.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("unchanged"),
        *(F.count_if(F.col("category") == c).alias(c) for c in (*EXTENSIONS, "unknown")),
    )
    return seen, gone, report
