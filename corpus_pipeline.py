"""From raw documents to packed training sequences: five stages, each written and read again.

The stages reject low quality, keep one document of each near-duplicate class, redact personal data, mix the sources
and pack the token pieces. All but the last return the columns of documents. Sources are mixed without losing a
document: the largest source is used once, the rarest at most mixing.REPETITION times.

Defined results: an empty table gives no row at any stage; null texts are empty ones, which the classifier judges by
its bias and of which near-dedup keeps one; null ids and repeated rows pass like any other; further columns are kept up
to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from evidencelake.llm import common, mixing, neardup, packing, pii, quality


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained models, signatures and token ids can't be stated in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is stored before the next stage reads it."""
    common.prepare(spark)
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
