"""Record-level checks: identities, references and stored catalogs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing, text
from evidencelake.operators import catalog, confidence, fusion
from evidencelake.plans import catalogs, inputs
from evidencelake.plans.registry import query
from evidencelake.session import ensure_checkpoint_dir
from evidencelake.sources import tables


@query(
    "word_token_estimate",
    r"""SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0
      ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS words FROM documents""",
)
def word_token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("words"))


@query(
    "media_type_key",
    """SELECT lower(trim(split_part(' ' || upper(lang) || '/Plain ; charset=' || source, ';', 1))) AS media_type, count(*) AS documents
    FROM documents GROUP BY ALL""",
)
def media_type_key(spark: SparkSession, folder: str) -> DataFrame:
    """Declared types with parameters, blanks and capitals."""
    declared = F.concat(F.lit(" "), F.upper("lang"), F.lit("/Plain ; charset="), F.col("source"))
    typed = inputs.table(spark, folder, "documents").select(catalog.normalize_media_type(declared).alias("media_type"))
    return typed.groupBy("media_type").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "catalog_copy_paths",
    f"""WITH {inputs.CATALOG_SQL} SELECT content_sha256, relative_path,
      relative_path = min(relative_path) OVER (PARTITION BY content_sha256) AS is_first FROM catalog""",
)
def catalog_copy_paths(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.copy_paths(catalogs.inventory(spark, folder))


STORED = ("document_id", "content_sha256", "relative_path", "size_bytes", "review_status", "version", "effective_from", "effective_until")


@query("catalog_round_trip", f"WITH {inputs.CATALOG_SQL} SELECT {', '.join(STORED)} FROM catalog")
def catalog_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog written as entries and read again."""
    ensure_checkpoint_dir(spark)
    entries = inputs.catalog(spark, folder).select(
        *(c for c in STORED if c != "relative_path"), F.array("relative_path").alias("relative_paths"), F.lit("text/plain").alias("media_type"),
        "title", "family", "organization",
    )
    target = f"{spark.sparkContext.getCheckpointDir()}/catalog-{uuid.uuid4().hex}"
    tables.write_catalog(entries, target)
    return tables.read_catalog(spark, target, validate=False).select(
        *(F.col("relative_paths")[0].alias(c) if c == "relative_path" else F.col(c) for c in STORED)
    )


REVISED_SQL = """revised AS (
  SELECT d.doc_id AS chunk_id, CASE WHEN l.quality = 0 THEN 'moved' ELSE d.source END AS document_id FROM documents d LEFT JOIN labels l USING (doc_id)
  WHERE l.toxic IS NULL OR l.toxic = 0)"""


def revised(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of a later corpus: toxic documents are gone, those of low quality have moved."""
    labels = inputs.table(spark, folder, "labels")
    rows = inputs.chunks(spark, folder).join(labels, F.col("chunk_id") == labels["doc_id"], "left")
    kept = rows.where(F.col("toxic").isNull() | (F.col("toxic") == 0))
    return kept.select("chunk_id", F.when(F.col("quality") == 0, "moved").otherwise(F.col("document_id")).alias("document_id"))


@query(
    "foreign_results",
    f"""WITH {inputs.RELEVANCE_SQL}, {REVISED_SQL}
    SELECT query_id, r.chunk_id, d.source AS document_id FROM rel r JOIN documents d ON d.doc_id = r.chunk_id
    LEFT JOIN revised n ON n.chunk_id = r.chunk_id WHERE n.document_id IS DISTINCT FROM d.source""",
)
def foreign_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of an older corpus that the later one doesn't hold as they are."""
    ranked = inputs.relevance(spark, folder).join(inputs.chunks(spark, folder).select("chunk_id", "document_id"), "chunk_id")
    return confidence.foreign_results(ranked, revised(spark, folder)).select("query_id", "chunk_id", "document_id")


@query(
    "retriever_disagreements",
    f"WITH {REVISED_SQL} SELECT chunk_id FROM revised r JOIN documents d ON d.doc_id = r.chunk_id WHERE r.document_id <> d.source",
)
def retriever_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks for which lists over two corpora name other documents."""
    today = inputs.chunks(spark, folder).select("chunk_id", "document_id")
    return fusion.disagreements([today, revised(spark, folder)], ["document_id"])


@query(
    "unknown_references",
    f"""WITH {inputs.RELEVANCE_SQL}, {REVISED_SQL}
    SELECT query_id, chunk_id FROM rel WHERE chunk_id NOT IN (SELECT chunk_id FROM revised)""",
)
def unknown_references(spark: SparkSession, folder: str) -> DataFrame:
    wanted = inputs.relevance(spark, folder)
    return tables.unknown_references(wanted, revised(spark, folder), "chunk_id").select("query_id", "chunk_id")


@query(
    "snapshot_unique_chunks",
    """SELECT doc_id AS chunk_id, source AS document_id, sha256(text) AS digest FROM documents""",
)
def snapshot_unique_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk of two snapshots that share most of theirs."""
    rows = inputs.chunks(spark, folder).withColumn("page", F.lit(None).cast("int"))
    both = rows.unionByName(rows.where(F.col("section") == "en"))
    return tables.unique_chunks(both).select("chunk_id", "document_id", hashing.text_digest(F.col("text")).alias("digest"))
