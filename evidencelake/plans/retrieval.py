"""Ranked retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing, sizing, text
from evidencelake.operators import confidence, fusion, lexical, vectors
from evidencelake.plans import inputs
from evidencelake.plans.registry import query

TOP_K = 5
THRESHOLD = 12.0


@query(
    "tokenize_terms",
    f"""WITH {inputs.WIDE_SQL} SELECT doc_id, len(t) AS token_count, len(list_distinct(t)) AS distinct_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT doc_id, {inputs.TOKENS_SQL.format('text')} AS t FROM wide)""",
)
def tokenize_terms(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.tokenize(inputs.wide_documents(spark, folder)).select(
        "doc_id",
        F.size("terms").cast("bigint").alias("token_count"),
        F.size(F.array_distinct("terms")).cast("bigint").alias("distinct_tokens"),
        F.array_join("terms", " ").alias("tokens"),
    )


@query(
    "term_statistics",
    f"""SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS chunk_frequency
        FROM (SELECT doc_id, unnest({inputs.TOKENS_SQL.format('text')}) AS term FROM documents) GROUP BY term""",
)
def term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.term_statistics(inputs.table(spark, folder, "documents"))


@query(
    "bm25_topk",
    f"WITH {inputs.bm25_sql()} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 5",
)
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    ranked = lexical.search(inputs.chunks(spark, folder), inputs.questions(spark, folder), k=TOP_K)
    return ranked.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "bm25_min_score_abstain",
    f"""WITH {inputs.bm25_sql()},
    kept AS (SELECT query_id, count(*) AS n FROM ranked WHERE score >= 25.0 AND rank <= 5 GROUP BY query_id)
    SELECT b.item_id AS query_id, coalesce(n, 0) AS result_count, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS abstained
    FROM benchmark b LEFT JOIN kept ON kept.query_id = b.item_id""",
)
def bm25_min_score_abstain(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.questions(spark, folder)
    ranked = lexical.search(inputs.chunks(spark, folder), asked, k=TOP_K, min_score=25.0)
    kept = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.select("query_id").join(kept, "query_id", "left").select(
        "query_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("result_count"),
        F.when(F.col("n").isNull(), 1).otherwise(0).alias("abstained"),
    )


def ranked_with_documents(spark: SparkSession, folder: str, k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """Top-k lexical rows with their document, and the per-query facts."""
    asked = inputs.questions(spark, folder)
    corpus = inputs.chunks(spark, folder)
    scored = lexical.score(corpus, asked)
    ranked = lexical.top_k(scored.pairs, k)
    small = sizing.fits(asked, sizing.DEFAULT_ROWS // k)
    placed = confidence.attach(ranked, corpus, proven_small=small, columns=["document_id"])
    return placed, scored.query_facts


def question_signals(spark: SparkSession, folder: str) -> DataFrame:
    ranked, facts = ranked_with_documents(spark, folder)
    return confidence.signals(ranked, facts)


@query(
    "confidence_signals",
    f"""WITH {inputs.bm25_sql()}, {inputs.SIGNALS_SQL}
    SELECT query_id, top_score, normalized_margin, query_coverage,
      coalesce(rare_query_coverage, -1.0) AS rare_query_coverage, top_document_concentration, result_count FROM signals""",
)
def confidence_signals(spark: SparkSession, folder: str) -> DataFrame:
    return question_signals(spark, folder).withColumn(
        "rare_query_coverage", F.coalesce("rare_query_coverage", F.lit(-1.0))
    )


@query(
    "gated_retrieval",
    f"""WITH {inputs.bm25_sql()}, {inputs.SIGNALS_SQL},
    decided AS (SELECT query_id, CASE WHEN result_count > 0 AND top_score >= {THRESHOLD} THEN 'ready'
      ELSE 'insufficient_evidence' END AS status FROM signals)
    SELECT d.query_id, d.status, coalesce(t.rank, 0) AS rank, coalesce(t.chunk_id, -1) AS chunk_id,
      coalesce(t.score, 0.0) AS score, coalesce(t.document_id, '') AS document_id
    FROM decided d LEFT JOIN top t ON t.query_id = d.query_id AND d.status = 'ready'""",
)
def gated_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """One decision row per refused question, one row per released passage."""
    ranked, facts = ranked_with_documents(spark, folder)
    decisions = confidence.gate(confidence.signals(ranked, facts), THRESHOLD)
    evidence = confidence.gated_evidence(ranked, decisions)
    return decisions.select("query_id", "status").join(evidence, "query_id", "left").select(
        "query_id",
        "status",
        F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"),
        F.coalesce("chunk_id", F.lit(-1)).cast("bigint").alias("chunk_id"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("document_id", F.lit("")).alias("document_id"),
    )


@query(
    "label_text_key",
    f"""WITH {inputs.WIDE_SQL} SELECT label, count(*) AS documents FROM (
      SELECT trim(regexp_replace({inputs.FOLD_SQL.format('text')}, '[^a-z0-9]+', ' ', 'g')) AS label FROM wide)
      GROUP BY label""",
)
def label_text_key(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per normalized label text (near copies share a label)."""
    documents = inputs.wide_documents(spark, folder)
    return documents.groupBy(text.label_text(F.col("text")).alias("label")).agg(
        F.count(F.lit(1)).cast("bigint").alias("documents")
    )


# --- dense, hybrid and reranked retrieval ---
# Vector ``i`` stands for document ``i`` and for question ``i``.


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One unit query vector per label: the mean of all its vectors."""
    table = inputs.table(spark, folder, "embeddings")
    return vectors.window_mean(table, "label", "embedding").select(
        F.col("label").cast("bigint").alias("query_id"), "embedding"
    )


def passages(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def question_vectors(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.questions(spark, folder).select("query_id")
    return passages(spark, folder).withColumnRenamed("chunk_id", "query_id").join(asked, "query_id", "left_semi")


LABEL_MEAN_SQL = """
cells AS (SELECT label, pos, avg(v::DOUBLE) AS mean FROM (
  SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS v FROM embeddings) GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(mean * mean)) AS norm FROM cells GROUP BY label),
centroid AS (SELECT label, pos, mean / norm AS value FROM cells JOIN norms USING (label))"""

DENSE_SQL = f"""{LABEL_MEAN_SQL},
cvec AS (SELECT label, list(value ORDER BY pos) AS vec FROM centroid GROUP BY label),
dscored AS (SELECT cvec.label::BIGINT AS query_id, vec_id AS chunk_id,
  round(list_dot_product(vec, embedding::DOUBLE[]), 9) AS score FROM cvec, embeddings),
dranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM dscored WHERE score >= 0)"""


@query(
    "window_mean_embedding",
    f"WITH {LABEL_MEAN_SQL} SELECT label, pos AS position, round(value, 6) AS value FROM centroid",
)
def window_mean_embedding(spark: SparkSession, folder: str) -> DataFrame:
    means = vectors.window_mean(inputs.table(spark, folder, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("embedding").alias("p", "v")).select(
        "label", (F.col("p") + 1).cast("bigint").alias("position"), F.round("v", 6).alias("value")
    )


@query(
    "dense_topk",
    f"WITH {DENSE_SQL} SELECT query_id, chunk_id, score, rank FROM dranked WHERE rank <= 10",
)
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = vectors.cosine_top_k(passages(spark, folder), label_queries(spark, folder), 10)
    return hits.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "vector_contract",
    """SELECT count(*) AS vectors, sum(CASE WHEN len(embedding) <> w OR len(embedding) = 0 THEN 1 ELSE 0 END)::BIGINT AS invalid
       FROM embeddings, (SELECT max(len(embedding)) AS w FROM embeddings)""",
)
def vector_contract(spark: SparkSession, folder: str) -> DataFrame:
    table = inputs.table(spark, folder, "embeddings")
    bad = vectors.invalid_vectors(table).agg(F.count(F.lit(1)).alias("invalid")).select("invalid").scalar()
    return table.agg(F.count(F.lit(1)).alias("vectors")).select("vectors", bad.alias("invalid"))


HYBRID_SQL = """
corpus AS (SELECT d.doc_id, d.text, d.source, e.embedding::DOUBLE[] AS vec
           FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
asked AS (SELECT b.item_id, b.text, e.embedding::DOUBLE[] AS vec
          FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""


def hybrid_sql() -> str:
    """Lexical, dense, fused and reranked lists over all documents."""
    return f"""{HYBRID_SQL}, {inputs.bm25_sql()},
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT a.item_id AS query_id, c.doc_id AS chunk_id, round(list_dot_product(a.vec, c.vec), 9) AS score
  FROM asked a, corpus c) WHERE score >= 0),
shares AS (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS share FROM ranked WHERE rank <= 20
  UNION ALL SELECT query_id, chunk_id, 1.0 / (60 + rank) FROM dense WHERE rank <= 20),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(sum(share), 9) AS score FROM shares GROUP BY ALL)),
cand AS (SELECT r.query_id, r.chunk_id, r.rank, row_number() OVER (PARTITION BY r.query_id
    ORDER BY coalesce(round(list_dot_product(a.vec, c.vec), 9), -2.0) DESC, r.chunk_id) AS srank
  FROM ranked r LEFT JOIN asked a ON a.item_id = r.query_id LEFT JOIN corpus c ON c.doc_id = r.chunk_id WHERE r.rank <= 20),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(1.0 / (60 + rank) + 1.0 / (60 + srank), 9) AS score FROM cand))"""


def hybrid_lists(spark: SparkSession, folder: str, k: int = TOP_K) -> dict[str, DataFrame]:
    """The four retrievers over all documents and questions; the dense one reaches those with a vector."""
    held = passages(spark, folder)
    corpus = inputs.chunks(spark, folder)
    asked_vectors = question_vectors(spark, folder)
    asked = inputs.questions(spark, folder)
    corpus_vectors = held.join(corpus.select("chunk_id"), "chunk_id", "left_semi")
    deep = fusion.depth(k)
    lexical_list = lexical.search(corpus, asked, k=deep)
    dense_list = vectors.cosine_top_k(corpus_vectors, asked_vectors, deep)
    small = sizing.fits(asked, sizing.DEFAULT_ROWS // deep)
    # without a vector on both sides a candidate is less alike than any with one
    alike = F.round(vectors.dot(F.col("asked"), F.col("embedding")), lexical.SCORE_DIGITS)
    candidates = (
        lexical_list.select("query_id", "chunk_id", "rank")
        .join(held, "chunk_id", "left")
        .join(sizing.hint(asked_vectors.withColumnRenamed("embedding", "asked"), small), "query_id", "left")
        .select("query_id", "chunk_id", "rank", F.coalesce(alike, F.lit(-2.0)).alias("similarity"))
    )
    return {
        "bm25": lexical_list.where(F.col("rank") <= k),
        "dense": dense_list.where(F.col("rank") <= k),
        "hybrid": fusion.reciprocal_rank([(lexical_list, 1.0), (dense_list, 1.0)], k),
        "rerank": fusion.rerank(candidates, k),
    }


@query(
    "rrf_fusion",
    f"WITH {hybrid_sql()} SELECT query_id, chunk_id, score, rank FROM fused WHERE rank <= 5",
)
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    fused = hybrid_lists(spark, folder)["hybrid"]
    return fused.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "semantic_rerank",
    f"WITH {hybrid_sql()} SELECT query_id, chunk_id, score, rank FROM reranked WHERE rank <= 5",
)
def semantic_rerank(spark: SparkSession, folder: str) -> DataFrame:
    ranked = hybrid_lists(spark, folder)["rerank"]
    return ranked.select("query_id", "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "token_windows",
    f"""WITH t AS (SELECT doc_id, {inputs.TOKENS_SQL.format('text')} AS toks FROM documents),
    w AS (SELECT doc_id, toks, unnest(range(0, greatest(len(toks) - 64 - 1, 0)::BIGINT + 1, 448)) AS start FROM t)
    SELECT doc_id, start, len(toks[start + 1 : start + 512]) AS size,
      coalesce(toks[start + 1], '') AS first_token, coalesce(toks[least(start + 512, len(toks))], '') AS last_token FROM w""",
)
def token_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping windows of 512 tokens, 64 shared, over every whole text."""
    tokens = lexical.tokenize(inputs.table(spark, folder, "documents")).select("doc_id", "terms")
    windows = tokens.select("doc_id", F.posexplode(vectors.token_windows(F.col("terms"), 512, 64)).alias("n", "w"))
    return windows.select(
        "doc_id",
        (F.col("n") * 448).cast("bigint").alias("start"),
        F.size("w").cast("bigint").alias("size"),
        F.coalesce(F.try_element_at("w", F.lit(1)), F.lit("")).alias("first_token"),
        F.coalesce(F.try_element_at("w", F.lit(-1)), F.lit("")).alias("last_token"),
    )


@query(
    "embedding_cache_plan",
    """WITH cache AS (
      SELECT d.doc_id AS chunk_id, CASE WHEN l.quality = 1 THEN sha256(d.text) ELSE sha256('old ' || d.text) END AS h
      FROM documents d JOIN labels l USING (doc_id))
    SELECT d.doc_id AS chunk_id, CASE WHEN h IS NULL THEN 'miss' WHEN h <> sha256(d.text) THEN 'stale' ELSE 'hit' END AS state
    FROM documents d LEFT JOIN cache c ON c.chunk_id = d.doc_id""",
)
def embedding_cache_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents are cached, those of low quality with outdated text."""
    corpus = inputs.chunks(spark, folder)
    labels = inputs.table(spark, folder, "labels").select(F.col("doc_id").alias("chunk_id"), "quality")
    cache = corpus.join(labels, "chunk_id").select(
        "chunk_id",
        hashing.text_digest(
            F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat(F.lit("old "), F.col("text")))
        ).alias("text_sha256"),
    )
    return vectors.cache_plan(corpus, cache)
