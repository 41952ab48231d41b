"""A vector cache that grows by what is missing, as committed deltas of a keyed table.

A delta is a folder of its own.  It counts only once its row stands in the manifest, so a write that was cut off is
invisible and is replaced by the next refresh, which gets the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing
from evidencelake.operators import catalog, metrics, vectors

#: Gives (chunk_id, embedding) for rows of (chunk_id, text); a chunk may be left out.
Encoder = Callable[[DataFrame], DataFrame]
_DELTA = "version bigint, model string, revision string, strategy string, rows bigint, dimensions int"


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """One row for each committed delta."""
    try:
        return spark.read.schema(_DELTA).parquet(f"{target}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _DELTA)


def read(spark: SparkSession, target: str, key_type: str, *, model: str, revision: str, strategy: str) -> tuple[DataFrame, int, int | None]:
    """Cached vectors, the last version and the dimensions; a cache of another configuration is refused."""
    deltas = manifest(spark, target).collect()  # a row for each refresh that added something
    if any((d.model, d.revision, d.strategy) != (model, revision, strategy) for d in deltas):
        raise ValueError("the vector cache was made by another model configuration")
    schema = f"chunk_id {key_type}, text_sha256 string, embedding array<float>, version bigint"
    if not deltas:
        return spark.createDataFrame([], schema), 0, None
    folders = [f"{target}/vectors/version={d.version}" for d in deltas]
    rows = spark.read.schema(schema).option("basePath", f"{target}/vectors").parquet(*folders)
    return rows, max(d.version for d in deltas), deltas[0].dimensions


def refresh(
    chunks: DataFrame, encode: Encoder, target: str, *, model: str, revision: str, strategy: str
) -> DataFrame:
    """Add the vectors that the cache lacks; chunk_id and state of every chunk.

    ``hit`` was cached, ``added`` is now, ``stale`` has other text under a cached id, ``not_encoded`` got no vector,
    ``not_finite`` and ``wrong_dimensions`` got a bad one.  Only what is added is written; nothing cached is touched.
    """
    spark = chunks.sparkSession
    catalog.require_empty(metrics.duplicates(chunks, "chunk_id"), "a chunk id occurs twice")
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    cached, last, dimensions = read(spark, target, kind, model=model, revision=revision, strategy=strategy)
    states = vectors.cache_plan(chunks, cached)
    missing = chunks.select("chunk_id", "text").join(states.where("state = 'miss'"), "chunk_id", "left_semi")
    given = encode(missing).select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    found = missing.select("chunk_id", hashing.text_digest(F.col("text")).alias("text_sha256")).join(given, "chunk_id", "left")
    if dimensions is None:  # the width that most new vectors have
        widths = found.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("n")).count()
        common = widths.orderBy(F.desc("count"), F.desc("n")).first()
        dimensions = common.n if common else None
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    verdict = (
        F.when(F.col("embedding").isNull(), "not_encoded")
        .when(F.size("embedding") != F.lit(dimensions), "wrong_dimensions")
        .when(~finite, "not_finite")
        .otherwise("added")
    )
    judged = found.withColumn("state", verdict)
    folder = f"{target}/vectors/version={last + 1}"
    judged.where("state = 'added'").drop("state").write.mode("overwrite").parquet(folder)
    stored = spark.read.schema(f"chunk_id {kind}, text_sha256 string, embedding array<float>").parquet(folder)
    rows = stored.count()
    if rows:
        delta = [(last + 1, model, revision, strategy, rows, dimensions)]
        spark.createDataFrame(delta, _DELTA).coalesce(1).write.mode("append").parquet(f"{target}/manifest")
    refused = judged.where("state <> 'added'").select("chunk_id", "state")
    done = stored.select("chunk_id", F.lit("added").alias("state"))
    return states.where("state <> 'miss'").unionByName(done).unionByName(refused)
