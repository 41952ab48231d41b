"""Audit-shaped views over the given tables, with the same views as SQL text.

The given tables hold no catalogs, rules, graphs or questions, so these are
derived from whole tables by fixed formulas; nothing is filtered or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing, sizing

#: Characters that stand for several letters, as far as the inputs hold them, with what they stand for.
SEVERAL = {"ﬁ": "fi", "ﬀ": "ff", "½": "1⁄2", "™": "TM", "㎏": "kg"}
FOLD_SQL = "strip_accents(replace(lower({0}), 'ß', 'ss'))"
for _sign, _letters in SEVERAL.items():
    FOLD_SQL = f"replace({FOLD_SQL}, '{_sign}', '{_letters}')"
TOKENS_SQL = f"regexp_extract_all({FOLD_SQL}, '[a-z0-9]+(?:[.-][a-z0-9]+)*')"

#: What is written in the place of parts of the documents, so that ligatures, fractions and signs occur.
_WIDE = {"fi": "ﬁ", "ff": "ﬀ", " de ": " ½ ", "and": "an™d", " la ": " 5㎏ "}
WIDE_SQL = "text"
for _part, _sign in _WIDE.items():
    WIDE_SQL = f"replace({WIDE_SQL}, '{_part}', '{_sign}')"
WIDE_SQL = f"wide AS (SELECT doc_id, {WIDE_SQL} AS text FROM documents)"


def wide_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with characters in them that stand for several letters."""
    written = F.col("text")
    for part, sign in _WIDE.items():
        written = F.replace(written, F.lit(part), F.lit(sign))
    return table(spark, folder, "documents").select("doc_id", written.alias("text"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document row as one chunk; its source plays the document."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("document_id"),
        "text",
        F.col("lang").alias("section"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Whole benchmark texts as retrieval questions."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


# --- golden relevance: a chunk is relevant when it quotes a whole sentence ---

MIN_SENTENCE = 20


def _sentences(df: DataFrame, key: str, out: str) -> DataFrame:
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return df.select(
        F.col(key).alias(out), F.explode(F.split(flat, r"\. ")).alias("sentence")
    ).select(out, F.trim("sentence").alias("sentence")).where(F.length("sentence") >= MIN_SENTENCE)


def relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Relevant (query_id, chunk_id) pairs by an equi join on quoted sentences.

    A question set that is proven small meets the corpus where it is read;
    otherwise sentences are matched by digest, so no text is shuffled.
    """
    asked = _sentences(table(spark, folder, "benchmark"), "item_id", "query_id")
    held = _sentences(table(spark, folder, "documents"), "doc_id", "chunk_id")
    if sizing.fits(asked):
        found = held.join(F.broadcast(asked), "sentence")
    else:
        digest = F.unhex(F.sha2("sentence", 256)).alias("sentence")
        found = held.select("chunk_id", digest).join(asked.select("query_id", digest), "sentence")
    return found.select("query_id", "chunk_id").distinct()


RELEVANCE_SQL = """
rel AS (
  SELECT DISTINCT b.query_id, d.chunk_id
  FROM (SELECT item_id AS query_id, trim(unnest(string_split(replace(text, chr(10), ' '), '. '))) AS s FROM benchmark) b
  JOIN (SELECT doc_id AS chunk_id, trim(unnest(string_split(replace(text, chr(10), ' '), '. '))) AS s FROM documents) d
    ON b.s = d.s
  WHERE length(b.s) >= 20
)"""


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Reviewed metadata of every question."""
    size = F.length("text")
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(size < 200, "short").when(size < 300, "medium").otherwise("long").alias("category"),
        F.when(F.contains(F.col("text"), F.lit("\n")), "hard").otherwise("easy").alias("difficulty"),
        F.concat(F.lit("type-"), (F.col("item_id") % 3).cast("string")).alias("reasoning_type"),
        F.expr("date '2024-01-01' + CAST((item_id % 4) * 90 AS INT)").alias("reference_date"),
    )


CASES_SQL = """
cases AS (
  SELECT item_id AS query_id,
    CASE WHEN length(text) < 200 THEN 'short' WHEN length(text) < 300 THEN 'medium' ELSE 'long' END AS category,
    CASE WHEN contains(text, chr(10)) THEN 'hard' ELSE 'easy' END AS difficulty,
    'type-' || (item_id % 3) AS reasoning_type,
    date '2024-01-01' + CAST((item_id % 4) * 90 AS INT) AS reference_date
  FROM benchmark
)"""


def bm25_sql(rare_ratio: float = 0.01) -> str:
    """Common tables that score every question against every document."""
    return f"""
tok AS (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len({TOKENS_SQL.format('text')}) AS dl FROM documents),
st AS (SELECT count(*) AS n, sum(dl) * 1.0 / count(*) AS avgdl FROM dl),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark),
qw AS (SELECT query_id, term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf,
         df <= greatest(1, ceil(n * {rare_ratio})) AS rare
       FROM qt JOIN dfreq USING (term), st),
facts AS (SELECT b.item_id AS query_id, len(list_distinct({TOKENS_SQL.format('b.text')})) AS term_count,
            (SELECT count(*) FROM qw WHERE qw.query_id = b.item_id AND rare) AS rare_term_count
          FROM benchmark b),
scored AS (
  SELECT query_id, doc_id AS chunk_id,
    round(sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 9) AS score,
    count(*) AS matched_terms, sum(CASE WHEN rare THEN 1 ELSE 0 END)::BIGINT AS matched_rare
  FROM qw JOIN tf USING (term) JOIN dl USING (doc_id), st
  GROUP BY ALL),
ranked AS (
  SELECT s.*, d.source AS document_id,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM scored s JOIN documents d ON d.doc_id = s.chunk_id WHERE score > 0)"""


SIGNALS_SQL = """
top AS (SELECT * FROM ranked WHERE rank <= 5),
perdoc AS (SELECT query_id, document_id, count(*) AS copies FROM top GROUP BY ALL),
conc AS (SELECT query_id, max(copies) AS largest, sum(copies) AS n FROM perdoc GROUP BY ALL),
signals AS (
  SELECT f.query_id, coalesce(t1.score, 0.0) AS top_score,
    round(CASE WHEN t1.score > 0 THEN (t1.score - coalesce(t2.score, 0.0)) / t1.score ELSE 0.0 END, 6) AS normalized_margin,
    round(CASE WHEN c.n > 0 AND f.term_count > 0 THEN t1.matched_terms / f.term_count ELSE 0.0 END, 6) AS query_coverage,
    round(CASE WHEN c.n > 0 AND f.rare_term_count > 0 THEN t1.matched_rare / f.rare_term_count END, 6) AS rare_query_coverage,
    round(CASE WHEN c.n > 0 THEN c.largest / c.n ELSE 0.0 END, 6) AS top_document_concentration,
    coalesce(c.n, 0)::BIGINT AS result_count
  FROM facts f
  LEFT JOIN top t1 ON t1.query_id = f.query_id AND t1.rank = 1
  LEFT JOIN top t2 ON t2.query_id = f.query_id AND t2.rank = 2
  LEFT JOIN conc c ON c.query_id = f.query_id)"""


# --- catalog: one entry per document row ---


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog entries: reviewed by quality label, missing when toxic."""
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    start = F.expr("date '2023-01-01' + CAST(doc_id % 700 AS INT)")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        hashing.text_digest(F.col("text")).alias("content_sha256"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"),
        F.col("n_chars").alias("size_bytes"),
        F.when(F.col("toxic") == 1, "missing").when(F.col("quality") == 1, "reviewed").otherwise("pending").alias(
            "review_status"
        ),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("family"),
        F.col("lang").alias("organization"),
        F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version"),
        F.when(F.col("doc_id") % 11 != 0, start).alias("effective_from"),
        F.when(
            F.col("doc_id") % 5 != 0, F.date_add(start, (F.lit(150) + F.col("n_chars") % 400).cast("int"))
        ).alias("effective_until"),
        "text",
    )


CATALOG_SQL = """
catalog AS (
  SELECT d.doc_id, 'doc-' || d.doc_id AS document_id, sha256(d.text) AS content_sha256,
    d.source || '/' || d.doc_id || '.txt' AS relative_path, d.n_chars AS size_bytes,
    CASE WHEN l.toxic = 1 THEN 'missing' WHEN l.quality = 1 THEN 'reviewed' ELSE 'pending' END AS review_status,
    'Document ' || d.doc_id AS title, d.source AS family, d.lang AS organization, 'v' || (d.doc_id % 3) AS version,
    CASE WHEN d.doc_id % 11 <> 0 THEN date '2023-01-01' + CAST(d.doc_id % 700 AS INT) END AS effective_from,
    CASE WHEN d.doc_id % 5 <> 0 THEN date '2023-01-01' + CAST(d.doc_id % 700 AS INT)
      + CAST(150 + d.n_chars % 400 AS INT) END AS effective_until,
    d.text
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""
