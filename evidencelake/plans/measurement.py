"""Ranking quality, grouped diagnostics and signal distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import stats
from evidencelake.operators import lexical, metrics, vectors
from evidencelake.plans import inputs, retrieval
from evidencelake.plans.registry import query

DIMENSIONS = ["category", "difficulty", "reasoning_type"]

SUMMARY_SQL = """
  count(*) AS case_count, count(*) FILTER (answerable) AS answerable_count,
  count(*) FILTER (NOT answerable) AS unanswerable_count,
  round(coalesce(avg(hit), 0.0), 6) AS hit_rate, round(coalesce(avg(recall), 0.0), 6) AS recall,
  round(coalesce(avg(rr), 0.0), 6) AS mrr,
  round(coalesce(avg(CASE WHEN NOT answerable THEN (returned = 0)::INT END), -1.0), 6) AS abstention_accuracy"""


def outcomes_sql(ranked: str, relevant: str, unit: str, name: str) -> str:
    """Outcome rows of one ranked table in SQL."""
    return f"""
{name}_need AS (SELECT query_id, count(DISTINCT {unit}) AS needed FROM {relevant} GROUP BY query_id),
{name}_hits AS (SELECT r.query_id, count(*) AS returned,
    min(CASE WHEN v.query_id IS NOT NULL THEN r.rank END) AS first, count(DISTINCT v.{unit}) AS matched
  FROM {ranked} r LEFT JOIN (SELECT DISTINCT query_id, {unit} FROM {relevant}) v
    ON v.query_id = r.query_id AND v.{unit} = r.{unit} GROUP BY r.query_id),
{name} AS (SELECT b.query_id, needed IS NOT NULL AS answerable, coalesce(returned, 0) AS returned,
    CASE WHEN needed IS NOT NULL THEN (first IS NOT NULL)::INT END AS hit,
    CASE WHEN needed IS NOT NULL THEN coalesce(1.0 / first, 0.0) END AS rr,
    CASE WHEN needed IS NOT NULL THEN coalesce(matched, 0) / needed END AS recall
  FROM (SELECT item_id AS query_id FROM benchmark) b
  LEFT JOIN {name}_need USING (query_id) LEFT JOIN {name}_hits USING (query_id))"""


def _filled(df: DataFrame) -> DataFrame:
    """Render undefined rates as -1 so that both engines print them alike."""
    return df.na.fill(-1.0)


LEXICAL_OUTCOMES_SQL = f"""WITH {inputs.bm25_sql()}, {inputs.RELEVANCE_SQL},
best AS (SELECT * FROM ranked WHERE rank <= 5), {outcomes_sql('best', 'rel', 'chunk_id', 'o')}"""


def lexical_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.questions(spark, folder)
    ranked = lexical.search(inputs.chunks(spark, folder), asked, k=retrieval.TOP_K)
    return metrics.outcomes(ranked, inputs.relevance(spark, folder), asked)


@query("ranking_metrics_chunk", f"{LEXICAL_OUTCOMES_SQL} SELECT {SUMMARY_SQL} FROM o")
def ranking_metrics_chunk(spark: SparkSession, folder: str) -> DataFrame:
    return _filled(metrics.summarize(lexical_outcomes(spark, folder)).drop("unanswerable_nonempty_rate"))


@query(
    "ranking_metrics_document",
    f"""WITH {inputs.bm25_sql()}, {inputs.RELEVANCE_SQL},
    reldoc AS (SELECT DISTINCT query_id, source AS document_id FROM rel JOIN documents ON doc_id = chunk_id),
    best AS (SELECT * FROM ranked WHERE rank <= 5), {outcomes_sql('best', 'reldoc', 'document_id', 'o')}
    SELECT {SUMMARY_SQL} FROM o""",
)
def ranking_metrics_document(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance of whole documents: repeated documents keep rank, count once."""
    ranked, _ = retrieval.ranked_with_documents(spark, folder)
    places = inputs.chunks(spark, folder).select("chunk_id", "document_id")
    relevant = inputs.relevance(spark, folder).join(places, "chunk_id").select("query_id", "document_id")
    rows = metrics.outcomes(ranked, relevant, inputs.questions(spark, folder), unit="document_id")
    return _filled(metrics.summarize(rows).drop("unanswerable_nonempty_rate"))


@query(
    "mrr_by_category",
    f"""{LEXICAL_OUTCOMES_SQL}, {inputs.CASES_SQL}
    SELECT category, count(*) AS answerable_count, round(avg(rr), 6) AS mrr FROM o JOIN cases USING (query_id)
    WHERE answerable GROUP BY category""",
)
def mrr_by_category(spark: SparkSession, folder: str) -> DataFrame:
    rows = lexical_outcomes(spark, folder).where("answerable").join(inputs.cases(spark, folder), "query_id")
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).cast("bigint").alias("answerable_count"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
    )


@query(
    "ranking_metrics_by_label",
    f"""WITH {retrieval.DENSE_SQL},
    need AS (SELECT label::BIGINT AS query_id, count(*) AS needed FROM embeddings GROUP BY label),
    hits AS (SELECT r.query_id, min(CASE WHEN e.label = r.query_id THEN rank END) AS first,
      count(*) FILTER (e.label = r.query_id) AS matched
      FROM dranked r JOIN embeddings e ON e.vec_id = r.chunk_id WHERE rank <= 10 GROUP BY r.query_id)
    SELECT query_id AS label, needed, matched, round(coalesce(1.0 / first, 0.0), 6) AS reciprocal_rank,
      round(matched / needed, 6) AS recall FROM need JOIN hits USING (query_id)""",
)
def ranking_metrics_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Dense retrieval where every vector of the query's label is relevant."""
    asked = retrieval.label_queries(spark, folder)
    hits = vectors.cosine_top_k(retrieval.passages(spark, folder), asked, 10)
    relevant = inputs.table(spark, folder, "embeddings").select(
        F.col("label").cast("bigint").alias("query_id"), F.col("vec_id").alias("chunk_id")
    )
    needed = relevant.groupBy("query_id").agg(F.count(F.lit(1)).cast("bigint").alias("needed"))
    rows = metrics.outcomes(hits, relevant, asked).join(needed, "query_id")
    return rows.select(
        F.col("query_id").alias("label"),
        "needed",
        F.round(F.col("recall") * F.col("needed")).cast("bigint").alias("matched"),
        F.round("reciprocal_rank", 6).alias("reciprocal_rank"),
        F.round("recall", 6).alias("recall"),
    )


def _hybrid_outcomes_sql() -> str:
    parts = [f"WITH {retrieval.hybrid_sql()}, {inputs.RELEVANCE_SQL}"]
    for name, source in (("bm25", "ranked"), ("dense", "dense"), ("hybrid", "fused"), ("rerank", "reranked")):
        parts.append(f"best_{name} AS (SELECT * FROM {source} WHERE rank <= 5)")
        parts.append(outcomes_sql(f"best_{name}", "rel", "chunk_id", f"o_{name}"))
    return ",\n".join(parts)


def hybrid_outcomes(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    lists = retrieval.hybrid_lists(spark, folder)
    asked = inputs.questions(spark, folder).select("query_id")
    relevant = inputs.relevance(spark, folder)
    return {name: metrics.outcomes(lists[name], relevant, asked) for name in names}


@query(
    "retriever_benchmark",
    _hybrid_outcomes_sql()
    + " UNION ALL ".join(
        f""" SELECT '{name}' AS retriever, count(*) AS case_count, count(*) FILTER (answerable) AS answerable_count,
        count(*) FILTER (NOT answerable) AS unanswerable_count,
        round(coalesce(avg(hit), 0.0), 6) AS hit_rate, round(coalesce(avg(recall), 0.0), 6) AS recall,
        round(coalesce(avg(rr), 0.0), 6) AS mrr,
        round(coalesce(avg(CASE WHEN NOT answerable THEN (returned > 0)::INT END), -1.0), 6) AS unanswerable_nonempty_rate
        FROM o_{name}"""
        for name in ("bm25", "dense", "hybrid", "rerank")
    ),
)
def retriever_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Four retrievers side by side on the same cases."""
    rows = None
    for name, part in hybrid_outcomes(spark, folder, ("bm25", "dense", "hybrid", "rerank")).items():
        tagged = part.withColumn("retriever", F.lit(name))
        rows = tagged if rows is None else rows.unionByName(tagged)
    return _filled(metrics.summarize(rows, ["retriever"]).drop("abstention_accuracy"))


def _delta_sql(dimension: str, value: str, group: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, {value} AS value, count(*) AS case_count,
      count(*) FILTER (md > 0) AS mrr_win_count, count(*) FILTER (md = 0) AS mrr_tie_count,
      count(*) FILTER (md < 0) AS mrr_loss_count, round(avg(md), 6) AS mean_mrr_delta,
      count(*) FILTER (rd > 0) AS recall_win_count, count(*) FILTER (rd = 0) AS recall_tie_count,
      count(*) FILTER (rd < 0) AS recall_loss_count, round(avg(rd), 6) AS mean_recall_delta FROM pairs {group}"""


@query(
    "paired_retriever_deltas",
    f"""{_hybrid_outcomes_sql()}, {inputs.CASES_SQL},
    pairs AS (SELECT c.*, round(h.rr - b.rr, 9) AS md, round(h.recall - b.recall, 9) AS rd
      FROM o_bm25 b JOIN o_hybrid h USING (query_id) JOIN cases c USING (query_id) WHERE b.answerable)
    {_delta_sql('overall', "'all'", '')} UNION ALL {_delta_sql('category', 'category', 'GROUP BY category')}
    UNION ALL {_delta_sql('difficulty', 'difficulty', 'GROUP BY difficulty')}
    UNION ALL {_delta_sql('reasoning_type', 'reasoning_type', 'GROUP BY reasoning_type')}""",
)
def paired_retriever_deltas(spark: SparkSession, folder: str) -> DataFrame:
    rows = hybrid_outcomes(spark, folder, ("bm25", "hybrid"))
    return metrics.paired_deltas(rows["bm25"], rows["hybrid"], inputs.cases(spark, folder), DIMENSIONS)


def _diagnostic_sql(dimension: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, {dimension} AS value, count(*) AS case_count,
      count(*) FILTER (answerable) AS answerable_count,
      round(coalesce(avg(CASE WHEN answerable THEN (rr > 0)::INT END), -1.0), 6) AS hit_rate,
      round(coalesce(avg(rr), -1.0), 6) AS mean_reciprocal_rank, round(coalesce(avg(recall), -1.0), 6) AS mean_recall,
      round(coalesce(avg(CASE WHEN NOT answerable THEN (returned = 0)::INT END), -1.0), 6) AS abstention_accuracy
      FROM o JOIN cases USING (query_id) GROUP BY {dimension}"""


@query(
    "diagnostics_grouping_sets",
    f"{LEXICAL_OUTCOMES_SQL}, {inputs.CASES_SQL} " + " UNION ALL ".join(_diagnostic_sql(d) for d in DIMENSIONS),
)
def diagnostics_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = lexical_outcomes(spark, folder).join(inputs.cases(spark, folder), "query_id")
    return _filled(metrics.diagnostics(rows, DIMENSIONS))


@query(
    "diagnostics_key_mismatch",
    """SELECT count(*) FILTER (l.doc_id IS NULL) AS only_results, count(*) FILTER (d.doc_id IS NULL) AS only_metadata
       FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""",
)
def diagnostics_key_mismatch(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as results, labels as review metadata: keys on one side only."""
    lost = metrics.unmatched_cases(
        inputs.table(spark, folder, "documents"), inputs.table(spark, folder, "labels"), "doc_id"
    )
    return lost.agg(
        F.count_if(F.col("in_metadata").isNull()).cast("bigint").alias("only_results"),
        F.count_if(F.col("in_results").isNull()).cast("bigint").alias("only_metadata"),
    )


# --- signals of labelled documents: quality plays answerability ---

SIGNALS_SQL = """
doc_signals AS (
  SELECT d.doc_id, l.quality = 1 AS answerable, l.toxic,
    round(n_chars / 100, 2) AS top_score,
    round((n_chars - length(replace(text, ' ', ''))) / n_chars, 2) AS normalized_margin,
    round(length(regexp_replace(text, '[^aeiou]', '', 'g')) / n_chars, 2) AS query_coverage,
    CASE WHEN l.toxic = 0 THEN round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / n_chars, 2) END AS rare_query_coverage
  FROM documents d JOIN labels l USING (doc_id))"""

SIGNAL_NAMES = ["top_score", "normalized_margin", "query_coverage", "rare_query_coverage"]


def document_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Four text statistics per labelled document, shaped like query signals."""
    size = F.col("n_chars")
    joined = inputs.table(spark, folder, "documents").join(inputs.table(spark, folder, "labels"), "doc_id")
    return joined.select(
        "doc_id",
        (F.col("quality") == 1).alias("answerable"),
        "toxic",
        F.round(size / 100, 2).alias("top_score"),
        F.round((size - F.length(F.replace("text", F.lit(" "), F.lit("")))) / size, 2).alias("normalized_margin"),
        F.round(F.length(F.regexp_replace("text", "[^aeiou]", "")) / size, 2).alias("query_coverage"),
        F.when(
            F.col("toxic") == 0, F.round(F.length(F.regexp_replace("text", "[^A-Z]", "")) / size, 2)
        ).alias("rare_query_coverage"),
    )


def long_signals(spark: SparkSession, folder: str) -> DataFrame:
    """One row per case and signal."""
    return document_signals(spark, folder).unpivot(
        ["doc_id", "answerable"], SIGNAL_NAMES, "signal", "value"
    )


LONG_SQL = f"WITH {SIGNALS_SQL}, long AS (" + " UNION ALL ".join(
    f"SELECT doc_id, answerable, '{name}' AS signal, {name} AS value FROM doc_signals" for name in SIGNAL_NAMES
) + ")"


@query(
    "signal_distribution",
    f"""{LONG_SQL} SELECT signal, answerable, count(value) AS count, min(value) AS min,
      round(median(value), 6) AS median, round(avg(value), 6) AS mean, max(value) AS max
      FROM long WHERE value IS NOT NULL GROUP BY signal, answerable""",
)
def signal_distribution(spark: SparkSession, folder: str) -> DataFrame:
    spread = stats.distribution(long_signals(spark, folder), "value", ["signal", "answerable"])
    return spread.withColumn("median", F.round("median", 6)).withColumn("mean", F.round("mean", 6))


@query(
    "pairwise_superiority_auc",
    f"""{LONG_SQL} SELECT p.signal, round(avg(CASE WHEN p.value > n.value THEN 1.0 WHEN p.value = n.value THEN 0.5 ELSE 0.0 END), 6) AS rate
      FROM long p JOIN long n ON p.signal = n.signal AND p.answerable AND NOT n.answerable
      WHERE p.value IS NOT NULL AND n.value IS NOT NULL GROUP BY p.signal""",
)
def pairwise_superiority_auc(spark: SparkSession, folder: str) -> DataFrame:
    rates = stats.superiority(long_signals(spark, folder), "value", F.col("answerable"), ["signal"])
    return rates.select("signal", F.round("rate", 6).alias("rate"))


@query(
    "question_signal_report",
    f"""WITH {inputs.bm25_sql()}, {inputs.SIGNALS_SQL}, {inputs.RELEVANCE_SQL},
    s AS (SELECT signals.*, query_id IN (SELECT query_id FROM rel) AS answerable FROM signals),
    long AS ({' UNION ALL '.join(f"SELECT answerable, '{n}' AS signal, {n} AS value FROM s" for n in SIGNAL_NAMES)})
    SELECT signal, answerable, count(value) AS count, min(value) AS min, round(median(value), 6) AS median,
      round(avg(value), 6) AS mean, max(value) AS max FROM long WHERE value IS NOT NULL GROUP BY signal, answerable""",
)
def question_signal_report(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of the retrieval signals by answerability of the question."""
    answerable = inputs.relevance(spark, folder).select("query_id").distinct().withColumn("answerable", F.lit(True))
    rows = retrieval.question_signals(spark, folder).join(answerable, "query_id", "left")
    rows = rows.withColumn("answerable", F.coalesce("answerable", F.lit(False)))
    spread = stats.distribution(
        rows.unpivot(["query_id", "answerable"], SIGNAL_NAMES, "signal", "value"), "value", ["signal", "answerable"]
    )
    return spread.withColumn("median", F.round("median", 6)).withColumn("mean", F.round("mean", 6))


@query(
    "exact_match_rollup",
    """WITH o AS (SELECT role AS category, length(text) > 200 AS correct FROM conversations)
    SELECT coalesce(category, 'all') AS name, count(*) AS case_count, sum(correct::INT)::BIGINT AS correct_count,
      round(avg(correct::INT), 6) AS exact_match FROM o GROUP BY ROLLUP (category)""",
)
def exact_match_rollup(spark: SparkSession, folder: str) -> DataFrame:
    turns = inputs.table(spark, folder, "conversations").withColumnRenamed("role", "category")
    return metrics.exact_match(turns, F.length("text") > 200)


@query(
    "repetition_stability",
    """SELECT conv_id, count(*) AS attempt_count, count(DISTINCT sha256(role)) = 1 AS stable FROM conversations GROUP BY conv_id""",
)
def repetition_stability(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as repetitions of a case: do all carry one fingerprint?"""
    return metrics.stability(inputs.table(spark, folder, "conversations"), "conv_id", F.sha2("role", 256))


@query(
    "duplicate_identifiers",
    "SELECT text_key, copies FROM (SELECT sha256(text) AS text_key, count(*) AS copies FROM documents GROUP BY 1) WHERE copies > 1",
)
def duplicate_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    keyed = inputs.table(spark, folder, "documents").select(F.sha2(F.encode("text", "utf-8"), 256).alias("text_key"))
    return metrics.duplicates(keyed, "text_key")
