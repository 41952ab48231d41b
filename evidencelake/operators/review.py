"""Review queue: map source labels to exactly one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import text


def label_index(labels: DataFrame) -> DataFrame:
    """Normalized label with the number of documents it names.

    ``labels``: label, document_id.  Ambiguity is a count, so a label shared by
    very many documents costs one row.
    """
    normalized = labels.select(text.label_text(F.col("label")).alias("label"), "document_id").where(
        F.col("label") != ""
    )
    return normalized.distinct().groupBy("label").agg(
        F.count(F.lit(1)).cast("bigint").alias("owners"), F.min("document_id").alias("document_id")
    )


def map_labels(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Per candidate label: the only document, or why there is none.

    ``candidates``: candidate_id, label.
    """
    wanted = candidates.select("candidate_id", text.label_text(F.col("label")).alias("label"))
    joined = wanted.join(index, "label", "left")
    status = (
        F.when(F.col("owners").isNull(), "missing").when(F.col("owners") > 1, "ambiguous").otherwise("mapped")
    )
    return joined.select(
        "candidate_id",
        "label",
        status.alias("status"),
        F.when(status == "mapped", F.col("document_id")).alias("document_id"),
    )


def merge_queue(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Existing review cases kept as they are, new candidates as pending.

    A candidate id that is already queued fails.
    """
    known = existing.select("candidate_id").withColumn("queued", F.lit(True))
    fresh = candidates.join(known, "candidate_id", "left").withColumn(
        "candidate_id",
        F.when(
            F.col("queued"), F.raise_error(F.lit("a new candidate has the id of a queued one"))
        ).otherwise(F.col("candidate_id")),
    )
    return existing.unionByName(
        fresh.drop("queued").withColumn("review_status", F.lit("pending")), allowMissingColumns=True
    )
