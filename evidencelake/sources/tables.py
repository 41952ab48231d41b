"""JSON sources and sinks of catalogs, chunks, golden sets and reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import validity
from evidencelake.operators import catalog, metrics

ENTRY_FIELDS = (
    "document_id string, content_sha256 string, relative_paths array<string>, media_type string, size_bytes bigint, "
    "review_status string, title string, family string, organization string, version string, published_at string, "
    "effective_from string, effective_until string, supersedes array<string>"
)
CATALOG_SCHEMA = f"schema_version int, entries array<struct<{', '.join(f.replace(' ', ':', 1) for f in ENTRY_FIELDS.split(', '))}>>"
CHUNK_SCHEMA = (
    "schema_version int, reference_date string, document struct<document_id:string,version:string,effective_from:string,"
    "effective_until:string,media_type:string,metadata:map<string,string>>, chunk struct<chunk_id:string,document_id:string,"
    "text:string,page:int,section:string,metadata:map<string,string>>"
)
GOLDEN_SCHEMA = (
    "schema_version int, reference_date string, relevance_level string, cases array<struct<id:string,question:string,"
    "category:string,relevant_document_ids:array<string>,relevant_chunk_ids:array<string>>>"
)
REVIEW_STATES = ("pending", "reviewed", "missing")


def _require(df: DataFrame, bad, message: str) -> None:
    if df.where(bad).limit(1).count():
        raise ValueError(message)


def read_catalog(spark: SparkSession, path: str, *, validate: bool = True) -> DataFrame:
    """Catalog document as entry rows; rejected when any rule is broken."""
    parts = spark.read.format("binaryFile").load(path).where(F.col("path").rlike("/part-[^/]*$"))
    if parts.select("path").limit(1).count():  # as write_catalog leaves it: an entry a line
        found = spark.read.schema(f"schema_version int, {ENTRY_FIELDS}").json(path)
        _require(found, ~F.col("schema_version").eqNullSafe(1), "the catalog is not of schema version 1")
        entries = found.drop("schema_version")
    else:
        document = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
        _require(document, ~F.col("schema_version").eqNullSafe(1), "the catalog is not of schema version 1")
        entries = document.select(F.inline("entries"))
    dates = ("published_at", "effective_from", "effective_until")
    for name in dates:
        parsed = validity.catalog_date(F.col(name))
        _require(entries, F.col(name).isNotNull() & parsed.isNull(), f"invalid {name}")
        entries = entries.withColumn(name, parsed)
    entries = entries.withColumn("supersedes", F.coalesce("supersedes", F.array().cast("array<string>")))
    _require(entries, ~F.col("review_status").isin(*REVIEW_STATES), "unknown review status")
    if validate:
        catalog.require_empty(catalog.violations(entries), "a catalog rule is broken")
        links = entries.select("document_id", F.explode("supersedes").alias("target"))
        catalog.require_empty(catalog.on_or_before_cycle(links), "documents supersede each other in a circle")
    return entries


def write_catalog(entries: DataFrame, target: str) -> None:
    """Entry rows as JSON lines in a new folder, which read_catalog reads; an old catalog is never replaced in place."""
    entries.select(F.lit(1).alias("schema_version"), *entries.columns).write.mode("errorifexists").json(target)


def write_chunks(chunks: DataFrame, target: str) -> None:
    """Chunks with their document envelope, partitioned by reference date."""
    chunks.write.mode("overwrite").partitionBy("reference_date").json(target)


def chunk_records(chunks: DataFrame, entries: DataFrame, reference_date) -> DataFrame:
    """Chunk rows in the exchange format."""
    keep = ["document_id", "version", "effective_from", "effective_until", "media_type"]
    joined = chunks.join(entries.select(*keep), "document_id")
    return joined.select(
        F.lit(1).alias("schema_version"),
        F.lit(reference_date).cast("string").alias("reference_date"),
        F.struct(
            "document_id", "version",
            F.col("effective_from").cast("string").alias("effective_from"),
            F.col("effective_until").cast("string").alias("effective_until"), "media_type",
        ).alias("document"),
        F.struct("chunk_id", "document_id", "text", "page", "section").alias("chunk"),
    )


def read_chunks(spark: SparkSession, path: str, *, single_date: bool = True) -> DataFrame:
    """Chunk rows of one or many snapshots, checked before use."""
    records = spark.read.schema(CHUNK_SCHEMA).json(path)
    _require(records, ~F.col("schema_version").eqNullSafe(1), "unsupported chunk schema")
    rows = records.select(F.col("reference_date").cast("date").alias("reference_date"), "document.media_type", "chunk.*")
    if single_date:
        dates = rows.select("reference_date").distinct().limit(2).count()
        if dates != 1:
            raise ValueError("chunk file must hold exactly one reference date")
        catalog.require_empty(metrics.duplicates(rows, "chunk_id"), "duplicate chunk ids")
    return rows


def unique_chunks(rows: DataFrame) -> DataFrame:
    """One row per chunk id over all snapshots; differing texts fail."""
    grouped = rows.groupBy("chunk_id").agg(
        F.min("text").alias("text"), F.max("text").alias("other"), F.min("document_id").alias("document_id"),
        F.min("page").alias("page"), F.min("section").alias("section"),
    )
    checked = F.when(
        F.col("text") != F.col("other"), F.raise_error(F.lit("two snapshots hold other text under one chunk id"))
    ).otherwise(F.col("text"))
    return grouped.withColumn("text", checked).drop("other")


def read_golden_sets(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases of all dates as rows."""
    documents = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", True).json(path)
    _require(documents, ~F.col("schema_version").eqNullSafe(1), "unsupported golden set schema")
    cases = documents.select(F.col("reference_date").cast("date").alias("reference_date"), F.inline("cases"))
    _require(
        cases,
        (F.size(F.coalesce("relevant_document_ids", F.array().cast("array<string>"))) > 0)
        & (F.size(F.coalesce("relevant_chunk_ids", F.array().cast("array<string>"))) > 0),
        "relevance must be at chunk or at document level",
    )
    catalog.require_empty(metrics.duplicates(cases, "id"), "duplicate case id")
    return cases


def write_golden_sets(cases: DataFrame, target: str) -> None:
    """Cases partitioned by date; existing sets are never overwritten."""
    cases.write.mode("errorifexists").partitionBy("reference_date").json(target)


def unknown_references(references: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Relevant ids that the corpus does not hold."""
    return references.join(known.select(key).distinct(), key, "left_anti")


def write_report(report: DataFrame, target: str) -> None:
    """Atomically write a one-row aggregate as a private JSON file."""
    if not target.endswith(".local.json"):
        raise ValueError("reports must end with .local.json")
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is one aggregated row")
    folder = os.path.dirname(os.path.abspath(target))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as handle:
        json.dump(rows[0].asDict(recursive=True), handle, ensure_ascii=False, indent=2, sort_keys=True, default=str)
        handle.write("\n")
    os.replace(handle.name, target)


def read_cache(spark: SparkSession, path: str, *, model: str, revision: str, strategy: str) -> DataFrame:
    """Vector cache of exactly one model configuration."""
    rows = spark.read.parquet(path)
    same = (F.col("model") == model) & (F.col("revision") == revision) & (F.col("strategy") == strategy)
    _require(rows, ~same, "embedding cache belongs to a different configuration")
    return rows.select("chunk_id", "text_sha256", "embedding")


def write_cache(vectors: DataFrame, path: str, *, model: str, revision: str, strategy: str) -> None:
    """Vector cache as a keyed table with its configuration."""
    vectors.withColumns(
        {"model": F.lit(model), "revision": F.lit(revision), "strategy": F.lit(strategy)}
    ).write.mode("errorifexists").parquet(path)
