"""Catalog and snapshot queries; every document row is one catalog entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing
from evidencelake.operators import catalog, lexical, metrics, review, temporal
from evidencelake.plans import inputs, measurement, retrieval
from evidencelake.plans.registry import query

DAY = "2024-06-01"
WITH_CATALOG = f"WITH {inputs.CATALOG_SQL}"


def day() -> Column:
    return F.to_date(F.lit(DAY))


@query(
    "catalog_selection_status",
    f"""{WITH_CATALOG} SELECT document_id, CASE WHEN review_status <> 'reviewed' THEN 'not_reviewed'
      WHEN effective_from IS NULL OR date '{DAY}' < effective_from THEN 'not_yet_effective'
      WHEN effective_until IS NOT NULL AND date '{DAY}' > effective_until THEN 'expired' ELSE 'selected' END AS selection FROM catalog""",
)
def catalog_selection_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = catalog.with_selection(inputs.catalog(spark, folder), day())
    return rows.select("document_id", F.coalesce("selection", F.lit("selected")).alias("selection"))


@query(
    "catalog_access_reason",
    f"""{WITH_CATALOG} SELECT document_id, CASE WHEN review_status = 'missing' THEN 'missing_source'
      WHEN review_status <> 'reviewed' THEN 'pending_review' WHEN effective_from IS NULL THEN 'invalid_entry'
      WHEN date '{DAY}' < effective_from THEN 'not_yet_effective'
      WHEN effective_until IS NOT NULL AND date '{DAY}' > effective_until THEN 'expired'
      WHEN size_bytes % 7 = 0 THEN 'content_mismatch' ELSE 'granted' END AS access FROM catalog""",
)
def catalog_access_reason(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh file was edited after review."""
    entries = inputs.catalog(spark, folder)
    content = F.when(F.col("size_bytes") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    status = catalog.access_status(catalog.entry_columns(), day(), F.encode(content, "utf-8"))
    return entries.select("document_id", status.alias("access"))


def catalog_with_links(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog with supersession links; some unknown, some circular."""
    n = F.col("doc_id")
    name = lambda number: F.concat(F.lit("doc-"), number.cast("string"))
    links = (
        F.when(n % 4 != 0, F.array(name(n - 1)))
        .when(F.col("organization") == "fr", F.array(name(n + 3)))
        .when(F.col("organization") == "de", F.array(F.concat(F.lit("doc-x"), n.cast("string"))))
        .when(F.col("organization") == "es", F.array(name(n)))
        .otherwise(F.array().cast("array<string>"))
    )
    return inputs.catalog(spark, folder).withColumn("supersedes", links).withColumn(
        "relative_paths", F.array("relative_path")
    )


LINKS_SQL = f"""{inputs.CATALOG_SQL},
linked AS (SELECT *, CASE WHEN doc_id % 4 <> 0 THEN 'doc-' || (doc_id - 1) WHEN organization = 'fr' THEN 'doc-' || (doc_id + 3)
  WHEN organization = 'de' THEN 'doc-x' || doc_id WHEN organization = 'es' THEN 'doc-' || doc_id END AS target FROM catalog)"""


@query(
    "catalog_violations",
    f"""WITH {LINKS_SQL}
    SELECT document_id, 'invalid_period' AS code, '' AS detail FROM linked WHERE effective_until < effective_from
    UNION ALL SELECT document_id, 'missing_fields', 'effective_from' FROM linked WHERE review_status = 'reviewed' AND effective_from IS NULL
    UNION ALL SELECT document_id, 'self_supersedes', '' FROM linked WHERE target = document_id
    UNION ALL SELECT min(document_id), 'duplicate_content_sha256', content_sha256 FROM linked GROUP BY content_sha256 HAVING count(*) > 1
    UNION ALL SELECT document_id, 'unknown_supersedes', target FROM linked
      WHERE target IS NOT NULL AND target NOT IN (SELECT document_id FROM catalog)""",
)
def catalog_violations(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.violations(catalog_with_links(spark, folder))


@query(
    "catalog_supersession_cycle",
    f"""WITH RECURSIVE {LINKS_SQL},
    links AS (SELECT document_id, target FROM linked WHERE target IS NOT NULL),
    reach AS (SELECT document_id, target FROM links UNION
      SELECT r.document_id, l.target FROM reach r JOIN links l ON l.document_id = r.target),
    ring AS (SELECT document_id FROM reach WHERE document_id = target)
    SELECT DISTINCT document_id FROM (SELECT document_id FROM ring
      UNION ALL SELECT r.document_id FROM reach r JOIN ring ON ring.document_id = r.target)""",
)
def catalog_supersession_cycle(spark: SparkSession, folder: str) -> DataFrame:
    links = catalog_with_links(spark, folder).select("document_id", F.explode("supersedes").alias("target"))
    return catalog.on_or_before_cycle(links)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Every document row as a file of the corpus."""
    return inputs.catalog(spark, folder).select(
        "relative_path", "size_bytes", "content_sha256", F.lit("text/plain").alias("media_type")
    )


def previous_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of an earlier run: labelled documents, some with other content."""
    labelled = inputs.catalog(spark, folder).join(inputs.table(spark, folder, "labels"), "doc_id")
    old = F.when(F.col("quality") == 0, F.concat(F.lit("old "), F.col("text"))).otherwise(F.col("text"))
    return (
        labelled.withColumn("content_sha256", hashing.text_digest(old))
        .groupBy("content_sha256")
        .agg(
            F.min_by("document_id", "doc_id").alias("document_id"),
            F.min_by("review_status", "doc_id").alias("review_status"),
            F.min_by("size_bytes", "doc_id").alias("size_bytes"),
            F.min_by("title", "doc_id").alias("title"),
        )
    )


PREVIOUS_SQL = f"""{inputs.CATALOG_SQL},
current AS (SELECT content_sha256, min(relative_path) AS first_path, min(size_bytes) AS size_bytes, count(*) AS copy_count
  FROM catalog GROUP BY content_sha256),
previous AS (SELECT CASE WHEN l.quality = 0 THEN sha256('old ' || c.text) ELSE c.content_sha256 END AS sha,
    arg_min(document_id, c.doc_id) AS document_id, arg_min(review_status, c.doc_id) AS review_status,
    arg_min(size_bytes, c.doc_id) AS size_bytes, arg_min(title, c.doc_id) AS title
  FROM catalog c JOIN labels l ON l.doc_id = c.doc_id GROUP BY 1)"""


@query(
    "catalog_refresh_merge",
    f"""WITH {PREVIOUS_SQL}
    SELECT coalesce(p.document_id, 'doc-' || left(c.content_sha256, 16)) AS document_id, coalesce(c.content_sha256, p.sha) AS content_sha256,
      CASE WHEN c.content_sha256 IS NULL THEN 'missing' WHEN p.sha IS NULL OR p.review_status = 'missing' THEN 'pending'
        ELSE p.review_status END AS review_status,
      coalesce(c.size_bytes, p.size_bytes) AS size_bytes, coalesce(c.first_path, '') AS first_path,
      coalesce(c.copy_count, 0) AS copy_count, coalesce(p.title, '') AS title
    FROM current c FULL JOIN previous p ON p.sha = c.content_sha256""",
)
def catalog_refresh_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = catalog.refresh(inventory(spark, folder), previous_catalog(spark, folder))
    return merged.drop("media_type").na.fill("", ["first_path", "title"])


@query(
    "catalog_audit_counts",
    f"""WITH {PREVIOUS_SQL.replace('arg_min(title, c.doc_id) AS title', 'arg_min_null(effective_from, c.doc_id) AS effective_from, arg_min_null(effective_until, c.doc_id) AS effective_until')},
    state AS (SELECT p.*, c.content_sha256 IS NOT NULL AS held FROM previous p LEFT JOIN current c ON c.content_sha256 = p.sha),
    counts AS (SELECT count(*) AS document_count, (SELECT count(*) FROM current) AS corpus_document_count,
      count(*) FILTER (review_status = 'missing') AS missing_count, count(*) FILTER (review_status = 'pending') AS pending_count,
      count(*) FILTER (review_status = 'reviewed') AS reviewed_count,
      count(*) FILTER (review_status = 'reviewed' AND NOT coalesce(date '{DAY}' < effective_from, false)
        AND NOT coalesce(date '{DAY}' > effective_until, false)) AS effective_reviewed_count,
      count(*) FILTER (review_status = 'reviewed' AND date '{DAY}' < effective_from) AS not_yet_effective_count,
      count(*) FILTER (review_status = 'reviewed' AND NOT coalesce(date '{DAY}' < effective_from, false) AND date '{DAY}' > effective_until) AS expired_count,
      (SELECT count(*) FROM current c WHERE c.content_sha256 NOT IN (SELECT sha FROM previous)) AS untracked_content_count,
      count(*) FILTER (NOT held) AS unavailable_content_count,
      count(*) FILTER (held AND review_status = 'missing') AS inconsistent_missing_status_count FROM state)
    SELECT *, pending_count = 0 AND untracked_content_count = 0 AND unavailable_content_count = 0
      AND inconsistent_missing_status_count = 0 AS ready FROM counts""",
)
def catalog_audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The earlier catalog against today's corpus."""
    labelled = inputs.catalog(spark, folder).join(inputs.table(spark, folder, "labels"), "doc_id")
    old = F.when(F.col("quality") == 0, F.concat(F.lit("old "), F.col("text"))).otherwise(F.col("text"))
    picked = ["document_id", "review_status", "effective_from", "effective_until"]
    entries = (
        labelled.withColumn("content_sha256", hashing.text_digest(old))
        .groupBy("content_sha256")
        .agg(*[F.min_by(F.struct(c), "doc_id")[c].alias(c) for c in picked])
    )
    return catalog.audit(entries, inventory(spark, folder), day())


def reference_dates(spark: SparkSession, folder: str) -> DataFrame:
    """First days of the months in which orders were placed, moved by 28 years."""
    orders = inputs.table(spark, folder, "orders")
    moved = F.date_add(F.to_date("o_orderdate"), 10227)
    return orders.select(F.to_date(F.trunc(moved, "MM")).alias("reference_date")).distinct()


DATES_SQL = """dates AS (SELECT DISTINCT date_trunc('month', o_orderdate::DATE + 10227)::DATE AS reference_date FROM orders)"""


@query(
    "temporal_snapshot_join",
    f"""{WITH_CATALOG}, {DATES_SQL} SELECT reference_date::VARCHAR AS reference_date, document_id FROM dates JOIN catalog
    ON reference_date >= effective_from AND (effective_until IS NULL OR reference_date <= effective_until)
    WHERE review_status = 'reviewed'""",
)
def temporal_snapshot_join(spark: SparkSession, folder: str) -> DataFrame:
    reviewed = inputs.catalog(spark, folder).where(F.col("review_status") == "reviewed")
    rows = temporal.snapshots(reviewed, reference_dates(spark, folder))
    return rows.select(F.col("reference_date").cast("string").alias("reference_date"), "document_id")


@query(
    "snapshot_summary",
    f"""{WITH_CATALOG}, {DATES_SQL} SELECT reference_date::VARCHAR AS reference_date, count(*) AS documents,
      sum(size_bytes)::BIGINT AS characters FROM dates JOIN catalog
    ON reference_date >= effective_from AND (effective_until IS NULL OR reference_date <= effective_until)
    WHERE review_status = 'reviewed' GROUP BY 1""",
)
def snapshot_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Size of each snapshot."""
    reviewed = inputs.catalog(spark, folder).where(F.col("review_status") == "reviewed")
    rows = temporal.snapshots(
        reviewed.withColumn("document", F.struct("document_id", "size_bytes")),
        reference_dates(spark, folder),
        id_col="document",
    )
    return rows.groupBy(F.col("reference_date").cast("string").alias("reference_date")).agg(
        F.count(F.lit(1)).cast("bigint").alias("documents"),
        F.sum("document.size_bytes").cast("bigint").alias("characters"),
    )


def references(spark: SparkSession, folder: str) -> DataFrame:
    """Dated references of the golden cases; every fifth case cites unknown ids."""
    dated = inputs.relevance(spark, folder).join(
        inputs.cases(spark, folder).select("query_id", "reference_date"), "query_id"
    )
    cited = F.when(F.col("query_id") % 5 == 0, F.col("chunk_id") + 1_000_000_000).otherwise(F.col("chunk_id"))
    return dated.select(
        F.col("query_id").alias("case_id"),
        F.concat(F.lit("doc-"), cited.cast("string")).alias("document_id"),
        "reference_date",
    )


REFERENCES_SQL = f"""{inputs.RELEVANCE_SQL}, {inputs.CASES_SQL},
refs AS (SELECT query_id AS case_id, 'doc-' || (CASE WHEN query_id % 5 = 0 THEN chunk_id + 1000000000 ELSE chunk_id END) AS document_id,
  reference_date FROM rel JOIN cases USING (query_id))"""


@query(
    "temporal_reference_conflicts",
    f"""{WITH_CATALOG}, {REFERENCES_SQL}
    SELECT * FROM (SELECT case_id, r.document_id, reference_date::VARCHAR AS reference_date,
      CASE WHEN c.document_id IS NULL THEN 'unknown_document' WHEN effective_from IS NULL OR reference_date < effective_from THEN 'not_yet_effective'
        WHEN reference_date > effective_until THEN 'expired' END AS reason
      FROM refs r LEFT JOIN catalog c ON c.document_id = r.document_id) WHERE reason IS NOT NULL""",
)
def temporal_reference_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    found = temporal.reference_conflicts(references(spark, folder), inputs.catalog(spark, folder))
    return found.withColumn("reference_date", F.col("reference_date").cast("string"))


@query(
    "golden_finalize",
    f"""WITH {REFERENCES_SQL}, n AS (SELECT case_id, count(DISTINCT document_id) AS n FROM refs GROUP BY case_id)
    SELECT (CASE WHEN c.query_id % 7 = 0 THEN date '2025-01-01' ELSE reference_date END)::VARCHAR AS snapshot_date, c.query_id AS case_id, category,
      coalesce(n, 0) AS relevant_documents FROM cases c LEFT JOIN n ON n.case_id = c.query_id""",
)
def golden_finalize(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh case has no date of its own and gets the default."""
    cited = references(spark, folder)
    answerable = cited.select("case_id").distinct().withColumn("answerable", F.lit(True))
    cases = (
        inputs.cases(spark, folder)
        .withColumnRenamed("query_id", "case_id")
        .withColumn("reference_date", F.when(F.col("case_id") % 7 != 0, F.col("reference_date")))
        .join(answerable, "case_id", "left")
        .withColumn("answerable", F.coalesce("answerable", F.lit(False)))
    )
    final = temporal.finalize_cases(cases, cited, F.to_date(F.lit("2025-01-01")))
    return final.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


def dated_questions(spark: SparkSession, folder: str) -> DataFrame:
    dates = inputs.cases(spark, folder).select("query_id", "reference_date")
    return inputs.questions(spark, folder).join(dates, "query_id")


def snapshot_scopes(spark: SparkSession, folder: str, dates: DataFrame) -> lexical.Scopes:
    """Which chunks each reference date holds."""
    entries = inputs.catalog(spark, folder).where(F.col("review_status") == "reviewed")
    valid = temporal.snapshots(
        entries.withColumnRenamed("doc_id", "chunk_id"), dates, id_col="chunk_id"
    )
    return lexical.Scopes(valid.select(F.col("reference_date").alias("scope"), "chunk_id"))


def snapshot_bm25_sql() -> str:
    """BM25 with corpus statistics per snapshot date."""
    t = inputs.TOKENS_SQL.format("text")
    return f"""{inputs.CATALOG_SQL}, {inputs.CASES_SQL}, {inputs.RELEVANCE_SQL},
days AS (SELECT DISTINCT reference_date AS d FROM cases),
snap AS (SELECT d, doc_id, {t} AS toks FROM days JOIN catalog ON review_status = 'reviewed' AND d >= effective_from
  AND (effective_until IS NULL OR d <= effective_until)),
st AS (SELECT d, count(*) AS n, sum(len(toks)) * 1.0 / count(*) AS avgdl FROM snap GROUP BY d),
tf AS (SELECT d, doc_id, term, dl, count(*) AS tf FROM (SELECT d, doc_id, len(toks) AS dl, unnest(toks) AS term FROM snap) GROUP BY ALL),
dfreq AS (SELECT d, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, reference_date AS d, unnest({inputs.TOKENS_SQL.format('b.text')}) AS term
  FROM benchmark b JOIN cases c ON c.query_id = b.item_id),
scored AS (SELECT query_id, d, doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) *
    (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 9) AS score
  FROM qt JOIN tf USING (d, term) JOIN dfreq USING (d, term) JOIN st USING (d) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0)"""


def snapshot_ranking(spark: SparkSession, folder: str) -> DataFrame:
    asked = dated_questions(spark, folder)
    within = snapshot_scopes(spark, folder, asked.select("reference_date"))
    return lexical.search(inputs.chunks(spark, folder), asked, k=retrieval.TOP_K, scope_col="reference_date", scopes=within)


@query(
    "temporal_bm25_topk",
    f"WITH {snapshot_bm25_sql()} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 5",
)
def temporal_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Each question against the snapshot of its own date."""
    ranked = snapshot_ranking(spark, folder)
    return ranked.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "temporal_weighted_metrics",
    f"""WITH {snapshot_bm25_sql()}, best AS (SELECT * FROM ranked WHERE rank <= 5),
    {measurement.outcomes_sql('best', 'rel', 'chunk_id', 'o')},
    per AS (SELECT reference_date, {measurement.SUMMARY_SQL.replace(', -1.0), 6)', ', 0.0), 6)')} FROM o JOIN cases USING (query_id) GROUP BY reference_date)
    SELECT sum(case_count)::BIGINT AS case_count, sum(answerable_count)::BIGINT AS answerable_count, sum(unanswerable_count)::BIGINT AS unanswerable_count,
      round(sum(hit_rate * answerable_count) / sum(answerable_count), 6) AS hit_rate, round(sum(recall * answerable_count) / sum(answerable_count), 6) AS recall,
      round(sum(mrr * answerable_count) / sum(answerable_count), 6) AS mrr,
      round(sum(abstention_accuracy * unanswerable_count) / sum(unanswerable_count), 6) AS abstention_accuracy FROM per""",
)
def temporal_weighted_metrics(spark: SparkSession, folder: str) -> DataFrame:
    asked = dated_questions(spark, folder)
    rows = metrics.outcomes(snapshot_ranking(spark, folder), inputs.relevance(spark, folder), asked)
    dated = rows.join(asked.select("query_id", "reference_date"), "query_id")
    return metrics.weighted_summary(dated, "reference_date")


CANDIDATES_SQL = """candidates AS (SELECT 'supplier-' || s_suppkey AS candidate_id, 'Nation (' || s_nationkey || ')' AS label FROM supplier
  UNION ALL SELECT 'part-' || p_partkey, upper(p_name) FROM part UNION ALL SELECT 'customer-' || c_custkey, c_mktsegment FROM customer)"""


@query(
    "label_mapping_exactly_one",
    f"""WITH {CANDIDATES_SQL}, named AS (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS label, 'nation-' || n_nationkey AS document_id FROM nation
      UNION ALL SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), 'part-' || p_partkey FROM part),
    idx AS (SELECT label, count(DISTINCT document_id) AS owners, min(document_id) AS document_id FROM named GROUP BY label),
    want AS (SELECT candidate_id, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS label FROM candidates)
    SELECT candidate_id, label, CASE WHEN owners IS NULL THEN 'missing' WHEN owners > 1 THEN 'ambiguous' ELSE 'mapped' END AS status,
      CASE WHEN owners = 1 THEN document_id ELSE '' END AS document_id FROM want LEFT JOIN idx USING (label)""",
)
def label_mapping_exactly_one(spark: SparkSession, folder: str) -> DataFrame:
    nation = inputs.table(spark, folder, "nation")
    part = inputs.table(spark, folder, "part")
    named = nation.select(
        F.col("n_name").alias("label"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("document_id")
    ).unionByName(
        part.select(
            F.col("p_name").alias("label"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("document_id")
        )
    )
    candidates = (
        inputs.table(spark, folder, "supplier")
        .select(
            F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("candidate_id"),
            F.concat(F.lit("Nation ("), F.col("s_nationkey").cast("string"), F.lit(")")).alias("label"),
        )
        .unionByName(
            part.select(
                F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("candidate_id"),
                F.upper("p_name").alias("label"),
            )
        )
        .unionByName(
            inputs.table(spark, folder, "customer").select(
                F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("candidate_id"),
                F.col("c_mktsegment").alias("label"),
            )
        )
    )
    return review.map_labels(candidates, review.label_index(named)).na.fill("", ["document_id"])


@query(
    "processing_summary",
    f"""{WITH_CATALOG}, s AS (SELECT CASE WHEN review_status <> 'reviewed' THEN 'not_reviewed' WHEN effective_from IS NULL OR date '{DAY}' < effective_from THEN 'not_yet_effective'
      WHEN effective_until IS NOT NULL AND date '{DAY}' > effective_until THEN 'expired' WHEN size_bytes % 13 = 0 THEN 'error' WHEN size_bytes < 100 THEN 'empty' ELSE 'processed' END AS status FROM catalog)
    SELECT status, count(*) AS documents FROM s GROUP BY status""",
)
def processing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome counts of one snapshot run; some files fail, short ones are empty."""
    entries = inputs.catalog(spark, folder)
    counts = entries.where(F.col("size_bytes") % 13 != 0).select(
        "document_id", F.when(F.col("size_bytes") < 100, 0).otherwise(1).alias("chunk_count")
    )
    return catalog.processing_summary(entries, counts, day())


@query(
    "source_resolution",
    f"""{WITH_CATALOG}, files AS (SELECT relative_path AS path, content_sha256 AS sha FROM catalog), by_hash AS (SELECT sha, max(path) AS path FROM files GROUP BY sha)
    SELECT document_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN relative_path END, h.path) AS source_path FROM catalog c JOIN by_hash h ON h.sha = c.content_sha256""",
)
def source_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Entries whose own path is gone or leaves the root are found by content."""
    entries = inputs.catalog(spark, folder)
    path = (
        F.when(F.col("doc_id") % 3 == 0, F.col("relative_path"))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("../"), "relative_path"))
        .otherwise(F.concat(F.lit("moved/"), "relative_path"))
    )
    moved = entries.select("document_id", "content_sha256", F.array(path).alias("relative_paths"))
    return catalog.resolve_sources(moved, inventory(spark, folder)).select("document_id", "source_path")
