"""Corpus runs, committed snapshots and vector caches over the given tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing
from evidencelake.operators import ingestion, profiles, vector_cache
from evidencelake.plans import documents, inputs
from evidencelake.plans.registry import query
from evidencelake.session import ensure_checkpoint_dir

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=90 * k) for k in range(4)]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the place that the cluster shares."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of the rendered documents and, reviewed as well, of the raw web pages."""
    held = documents.rendered(spark, folder).select("doc_id", hashing.text_digest(F.col("text")).alias("content_sha256"))
    texts = inputs.catalog(spark, folder).drop("content_sha256").join(held, "doc_id").select(
        "document_id", "content_sha256", F.array("relative_path").alias("relative_paths"), F.lit("Text/Plain; charset=utf-8").alias("media_type"),
        "review_status", "title", "version", "effective_from", "effective_until",
    )
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"))
    pages = inputs.table(spark, folder, "pages").select(
        name.alias("document_id"), hashing.text_digest(F.col("html")).alias("content_sha256"),
        F.array(F.concat(name, F.lit(".html"))).alias("relative_paths"), F.lit("text/html").alias("media_type"),
        F.lit("reviewed").alias("review_status"), F.col("url").alias("title"), F.lit("v1").alias("version"),
        F.lit(dt.date(2024, 3, 1)).alias("effective_from"), F.lit(None).cast("date").alias("effective_until"),
    )
    return texts.unionByName(pages)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """What the corpus folder holds: every 13th file was edited after its review, every 19th is gone."""
    body = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    paths = inputs.catalog(spark, folder).select("doc_id", "relative_path")
    texts = documents.rendered(spark, folder).where(F.col("doc_id") % 19 != 0).join(paths, "doc_id")
    pages = inputs.table(spark, folder, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("relative_path"), F.encode("html", "utf-8").alias("content")
    )
    return texts.select("relative_path", F.encode(body, "utf-8").alias("content")).unionByName(pages)


def corpus_run(spark: SparkSession, folder: str) -> ingestion.Run:
    return ingestion.Run(entries(spark, folder), files(spark, folder), DAYS, scratch(spark, "corpus-run"))


RUN_SQL = f"""{inputs.CATALOG_SQL.strip()},
{documents.CHUNKS_SQL.strip()},
chunked AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1),
held AS (SELECT sha256(CASE WHEN doc_id % 13 = 0 THEN text || ' edited' ELSE text END) AS sha FROM rendered WHERE doc_id % 19 <> 0),
entries AS (
  SELECT c.document_id, c.review_status, c.effective_from, c.effective_until, c.version, 'Text/Plain; charset=utf-8' AS media_type,
    CASE WHEN c.doc_id % 19 <> 0 THEN CASE WHEN c.doc_id % 13 = 0 THEN 'content_mismatch' END
      WHEN sha256(r.text) NOT IN (SELECT sha FROM held) THEN 'missing_source' END AS reason
  FROM catalog c JOIN rendered r USING (doc_id)
  UNION ALL SELECT 'page-' || page_id, 'reviewed', date '2024-03-01', NULL, 'v1', 'text/html', 'unsupported_media_type' FROM pages),
days AS (SELECT unnest([date '2024-01-01', date '2024-03-31', date '2024-06-29', date '2024-09-27']) AS reference_date),
judged AS (
  SELECT e.*, reference_date, CASE WHEN review_status <> 'reviewed' THEN 'not_reviewed'
    WHEN effective_from IS NULL OR reference_date < effective_from THEN 'not_yet_effective' WHEN reference_date > effective_until THEN 'expired' END AS selection
  FROM entries e, days),
outcomes AS (
  SELECT document_id, reference_date, coalesce(selection, CASE WHEN reason IS NOT NULL THEN 'error' WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'processed' END) AS status,
    CASE WHEN selection IS NULL THEN reason END AS reason, CASE WHEN selection IS NULL AND reason IS NULL THEN coalesce(n, 0) ELSE 0 END AS chunk_count
  FROM judged LEFT JOIN chunked USING (document_id))"""


@query(
    "corpus_process",
    f"""WITH RECURSIVE {RUN_SQL}
    SELECT reference_date, status, coalesce(reason, '') AS reason, count(*) AS documents, sum(chunk_count)::BIGINT AS chunks FROM outcomes GROUP BY ALL""",
)
def corpus_process(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry on every reference date: left out, refused with a reason, empty or processed."""
    return ingestion.summary(corpus_run(spark, folder).outcomes())


@query(
    "corpus_snapshots",
    f"""WITH RECURSIVE {RUN_SQL}
    SELECT o.reference_date, count(*) AS rows, count(DISTINCT document_id) AS documents, count(DISTINCT chunk_id) AS distinct_chunks,
      sum(length(text))::BIGINT AS characters, count(DISTINCT document_id || version || effective_from::VARCHAR || coalesce(effective_until::VARCHAR, '')) AS envelopes, true AS written
    FROM outcomes o JOIN chunks USING (document_id) JOIN entries USING (document_id) WHERE status = 'processed' GROUP BY 1""",
)
def corpus_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of all dates, staged, committed as partitions and read from the committed table."""
    target = scratch(spark, "snapshots")
    state = ingestion.commit_snapshots(corpus_run(spark, folder).records(), target, version=1)
    rows = spark.read.parquet(f"{target}/chunks")
    envelope = F.concat("document.document_id", "document.version", "document.effective_from", F.coalesce("document.effective_until", F.lit("")))
    counted = rows.groupBy("reference_date").agg(
        F.count("*").alias("n"), F.count_distinct("document.document_id").alias("documents"), F.count_distinct("chunk.chunk_id").alias("distinct_chunks"),
        F.sum(F.length("chunk.text")).cast("bigint").alias("characters"), F.count_distinct(envelope).alias("envelopes"),
    )
    return counted.join(state.drop("digest"), "reference_date").where("n = rows").select(
        "reference_date", "rows", "documents", "distinct_chunks", "characters", "envelopes", "written"
    )


@query(
    "ingestion_results",
    f"""WITH RECURSIVE {RUN_SQL},
    done AS (SELECT DISTINCT document_id FROM outcomes WHERE status = 'processed'),
    c AS (SELECT document_id, list({{'chunk_id': chunk_id, 'page': page::INT, 'section': section, 'strategy': 'structure-aware-v1', 'text': text}} ORDER BY chunk_id) AS chunks FROM chunks GROUP BY 1),
    e AS (SELECT document_id, list({{'element_id': element_id, 'kind': kind, 'ordinal': ordinal::INT, 'page': page::INT, 'section': section, 'text': text}} ORDER BY ordinal) AS elements FROM els GROUP BY 1)
    SELECT document_id, sha256(to_json({{'chunks': chunks, 'parsed_document': {{'document': {{'document_id': document_id, 'effective_from': effective_from::VARCHAR,
      'effective_until': effective_until::VARCHAR, 'version': version}}, 'elements': elements}}, 'schema_version': 1}})::VARCHAR) AS result_sha256
    FROM done JOIN entries USING (document_id) JOIN c USING (document_id) JOIN e USING (document_id)""",
)
def ingestion_results(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of the JSON result of every document processed on some date."""
    return ingestion.result_json(corpus_run(spark, folder)).select("document_id", hashing.text_digest(F.col("result")).alias("result_sha256"))


@query(
    "embedding_cache_refresh",
    """WITH first AS (SELECT d.doc_id, l.quality, v.vec_id IS NOT NULL AS known FROM documents d JOIN labels l USING (doc_id) LEFT JOIN embeddings v ON v.vec_id = d.doc_id),
    s AS (SELECT d.doc_id, CASE WHEN f.doc_id IS NULL THEN '' WHEN f.known THEN 'added' ELSE 'not_encoded' END AS first_state, f.quality, v.vec_id IS NOT NULL AS known
      FROM documents d LEFT JOIN first f USING (doc_id) LEFT JOIN embeddings v ON v.vec_id = d.doc_id),
    t AS (SELECT *, CASE WHEN first_state = 'added' THEN CASE WHEN quality = 1 THEN 'hit' ELSE 'stale' END WHEN known THEN 'added' ELSE 'not_encoded' END AS second_state FROM s)
    SELECT doc_id AS chunk_id, first_state, second_state, CASE WHEN second_state = 'added' THEN 'hit' ELSE second_state END AS third_state,
      CASE WHEN first_state = 'added' THEN 1 WHEN second_state = 'added' THEN 2 ELSE 0 END AS version FROM t""",
)
def embedding_cache_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Three refreshes: the labelled documents, all of them after the poor ones changed, all of them once more."""
    target, settings = scratch(spark, "vector-cache"), {"model": "given", "revision": "1", "strategy": "whole"}
    held = inputs.table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    encode = lambda missing: missing.join(held, "chunk_id")
    corpus = inputs.chunks(spark, folder).select("chunk_id", "text")
    labels = inputs.table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    earlier = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat(F.lit("old "), "text"))
    before = corpus.join(labels, "chunk_id").select("chunk_id", earlier.alias("text"))
    first = vector_cache.refresh(before, encode, target, **settings)
    second = vector_cache.refresh(corpus, encode, target, **settings)
    third = vector_cache.refresh(corpus, encode, target, **settings)
    stored = vector_cache.read(spark, target, "bigint", **settings)[0].select("chunk_id", "version")
    named = lambda df, name: df.withColumnRenamed("state", name)
    joined = named(second, "second_state").join(named(third, "third_state"), "chunk_id").join(named(first, "first_state"), "chunk_id", "left")
    return joined.join(stored, "chunk_id", "left").select(
        "chunk_id", F.coalesce("first_state", F.lit("")).alias("first_state"), "second_state", "third_state",
        F.coalesce("version", F.lit(0)).cast("int").alias("version"),
    )


@query(
    "corpus_profile",
    f"""WITH RECURSIVE {inputs.CATALOG_SQL.strip()}, {documents.ELEMENTS_SQL.strip()}, n AS (SELECT doc_id, count(*) AS n FROM els GROUP BY 1)
    SELECT '.txt' AS suffix, CASE WHEN coalesce(n, 0) > 0 THEN 'extracted' ELSE 'empty' END AS status, count(*) AS files, coalesce(sum(n), 0)::BIGINT AS elements FROM rendered LEFT JOIN n USING (doc_id) WHERE doc_id % 19 <> 0 GROUP BY ALL
    UNION ALL SELECT '.html', 'error', count(*), 0 FROM pages""",
)
def corpus_profile(spark: SparkSession, folder: str) -> DataFrame:
    """What parsing every file of the corpus folder gives, without a catalog."""
    suffix = lambda name: F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    kind = F.when(suffix("relative_path") == ".txt", "text/plain").otherwise("text/html")
    sources = files(spark, folder).select(F.col("relative_path").alias("document_id"), kind.alias("media_type"), "content", F.lit(None).cast("string").alias("reason"))
    found = ingestion.parsed(sources).select(
        suffix("document_id").alias("suffix"), F.coalesce(F.size("elements"), F.lit(0)).alias("n"), F.when(F.col("reason").isNotNull(), "error").alias("failed"),
        F.size(F.array_distinct(F.transform("elements", lambda e: e["page"]))).alias("pages"),
    )
    status = profiles.extraction_status(F.col("suffix"), F.col("n"), F.col("pages"), F.lit(False), F.col("failed"))
    return found.groupBy("suffix", status.alias("status")).agg(F.count("*").cast("bigint").alias("files"), F.sum("n").cast("bigint").alias("elements"))
