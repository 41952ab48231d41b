"""File inventory and content fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import catalog


def read_binary(spark: SparkSession, root: str) -> DataFrame:
    """Supported files below a root with content, path relative to the root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^file:/+", "/")
    relative = F.when(
        path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    ).otherwise(path)
    return files.select(
        relative.alias("relative_path"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        "content",
    ).withColumn("media_type", catalog.media_type(F.col("relative_path"))).where(F.col("media_type").isNotNull())


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Technical facts of every supported file; the content itself is dropped."""
    return read_binary(spark, root).withColumn("content_sha256", F.sha2("content", 256)).drop("content")


def write_inventory(records: DataFrame, target: str) -> None:
    """One JSON line per file in path order."""
    records.select(
        "relative_path", "extension", "size_bytes", F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("modified_at"),
        "content_sha256",
    ).orderBy("relative_path").write.mode("errorifexists").json(target)


def verify_fingerprint(spark: SparkSession, path: str, expected: str) -> None:
    """Refuse an input file whose content is not the frozen one."""
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
    if row is None or row.h != expected:
        raise ValueError("input fingerprint does not match")
