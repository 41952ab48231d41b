"""The operators of this folder over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidencelake.llm import common, divergence, importance, language, middle, mixing, mixture, neardup, packing, passages, pii, quality, syncmers, varbyte

Query = Callable[[SparkSession, str], DataFrame]


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir))


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(common.documents(spark, sf_dir))


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(common.documents(spark, sf_dir))


def op4_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(common.documents(spark, sf_dir)).drop("version")


def op5_rank_varbyte_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    return varbyte.export(common.documents(spark, sf_dir), folder).drop("file")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(common.documents(spark, sf_dir)).drop("node")


def op7_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare(common.documents(spark, sf_dir))


def op8_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op9_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_ngram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(common.documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(common.documents(spark, sf_dir))


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.held_out_scores(common.documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_temperature_mixing, op2_bootstrapped_pii, op3_distribution_divergence, op4_content_defined_chunks, op5_rank_varbyte_files,
        op6_dart_minhash, op7_closed_syncmers, op8_configuration_packing, op9_ngram_quality, op10_ngram_language,
        op11_importance_resampling, op12_fill_in_middle, op13_context_mixing,
    )
}
ORACLES: dict[str, str] = {
    "op1_temperature_mixing": mixing.ORACLE, "op3_distribution_divergence": divergence.ORACLE,
    "op11_importance_resampling": importance.oracle(), "op12_fill_in_middle": middle.ORACLE,
}
