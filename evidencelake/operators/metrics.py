"""Ranking metrics, grouped diagnostics and exact-match roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(flag: Column) -> Column:
    """Aggregate: share of rows with a true flag; NULL without rows."""
    return F.avg(flag.cast("int"))


def outcomes(ranked: DataFrame, relevance: DataFrame, queries: DataFrame, unit: str = "chunk_id") -> DataFrame:
    """One row per query: answerable, hit, reciprocal_rank, recall, returned.

    ``ranked`` holds at most ``k`` rows per query; repeated units keep their
    rank but count once for recall.  Queries without relevant units are
    unanswerable and should return nothing.
    """
    relevant = relevance.select("query_id", unit).distinct()
    needed = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    marked = ranked.join(relevant.withColumn("relevant", F.lit(True)), ["query_id", unit], "left")
    found = marked.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.count_distinct(F.when(F.col("relevant"), F.col(unit))).alias("matched"),
    )
    base = queries.select("query_id").join(needed, "query_id", "left").join(found, "query_id", "left")
    answerable = F.col("needed").isNotNull()
    return base.select(
        "query_id",
        answerable.alias("answerable"),
        F.coalesce("returned", F.lit(0)).alias("returned"),
        F.when(answerable, F.col("first").isNotNull()).alias("hit"),
        F.when(answerable, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(answerable, F.coalesce("matched", F.lit(0)) / F.col("needed")).alias("recall"),
    )


def summary_columns() -> list[Column]:
    """Aggregates shared by every ranking report."""
    answerable = F.col("answerable")
    return [
        F.count(F.lit(1)).cast("bigint").alias("case_count"),
        F.count_if(answerable).cast("bigint").alias("answerable_count"),
        F.count_if(~answerable).cast("bigint").alias("unanswerable_count"),
        F.round(F.coalesce(share(F.col("hit")), F.lit(0.0)), 6).alias("hit_rate"),
        F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 6).alias("mrr"),
        F.round(share(F.when(~answerable, F.col("returned") == 0)), 6).alias("abstention_accuracy"),
        F.round(share(F.when(~answerable, F.col("returned") > 0)), 6).alias("unanswerable_nonempty_rate"),
    ]


def summarize(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Metrics of outcome rows, over all or per group."""
    return rows.groupBy(*(by or [])).agg(*summary_columns())


def weighted_summary(rows: DataFrame, snapshot: str) -> DataFrame:
    """Consolidate per-snapshot rates by their applicable case counts.

    A snapshot without unanswerable cases contributes zero to abstention.
    """
    per = rows.groupBy(snapshot).agg(*summary_columns())

    def weighted(metric: str, count: str) -> Column:
        total = F.sum(count)
        return F.round(
            F.when(total > 0, F.sum(F.coalesce(metric, F.lit(0.0)) * F.col(count)) / total), 6
        ).alias(metric)

    return per.agg(
        F.sum("case_count").cast("bigint").alias("case_count"),
        F.sum("answerable_count").cast("bigint").alias("answerable_count"),
        F.sum("unanswerable_count").cast("bigint").alias("unanswerable_count"),
        weighted("hit_rate", "answerable_count"),
        weighted("recall", "answerable_count"),
        weighted("mrr", "answerable_count"),
        weighted("abstention_accuracy", "unanswerable_count"),
    )


def _dimension(dimensions: list[str]) -> list[Column]:
    name, value = F.lit("overall"), F.lit("all")
    for column in dimensions:
        active = F.grouping(column) == 0
        name = F.when(active, column).otherwise(name)
        value = F.when(active, F.col(column)).otherwise(value)
    return [name.alias("dimension"), value.alias("value")]


def by_dimensions(rows: DataFrame, dimensions: list[str], measures: list[Column], *, overall: bool = False) -> DataFrame:
    """Aggregate once per single dimension (and overall) in one pass."""
    sets = [[F.col(d)] for d in dimensions] + ([[]] if overall else [])
    grouped = rows.groupingSets(sets, *dimensions).agg(*_dimension(dimensions), *measures)
    return grouped.drop(*dimensions)


def diagnostics(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Six measures per value of every reviewed dimension."""
    answerable = F.col("answerable")
    return by_dimensions(
        rows,
        dimensions,
        [
            F.count(F.lit(1)).cast("bigint").alias("case_count"),
            F.count_if(answerable).cast("bigint").alias("answerable_count"),
            F.round(share(F.when(answerable, F.col("reciprocal_rank") > 0)), 6).alias("hit_rate"),
            F.round(F.avg("reciprocal_rank"), 6).alias("mean_reciprocal_rank"),
            F.round(F.avg("recall"), 6).alias("mean_recall"),
            F.round(share(F.when(~answerable, F.col("returned") == 0)), 6).alias("abstention_accuracy"),
        ],
    )


def unmatched_cases(results: DataFrame, metadata: DataFrame, key: str = "query_id") -> DataFrame:
    """Keys found on one side only; diagnostics require none."""
    left = results.select(key, F.lit(True).alias("in_results"))
    right = metadata.select(key, F.lit(True).alias("in_metadata"))
    joined = left.join(right, key, "full")
    return joined.where(F.col("in_results").isNull() | F.col("in_metadata").isNull())


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("copies")).where(F.col("copies") > 1)


def paired_deltas(base: DataFrame, other: DataFrame, metadata: DataFrame, dimensions: list[str]) -> DataFrame:
    """Win, tie and loss counts with mean deltas of answerable cases."""
    pairs = (
        base.where("answerable")
        .select("query_id", F.col("reciprocal_rank").alias("rr_a"), F.col("recall").alias("recall_a"))
        .join(
            other.where("answerable").select(
                "query_id", F.col("reciprocal_rank").alias("rr_b"), F.col("recall").alias("recall_b")
            ),
            "query_id",
        )
        .join(metadata.select("query_id", *dimensions), "query_id")
        .withColumn("mrr_delta", F.round(F.col("rr_b") - F.col("rr_a"), 9))
        .withColumn("recall_delta", F.round(F.col("recall_b") - F.col("recall_a"), 9))
    )
    measures = [F.count(F.lit(1)).cast("bigint").alias("case_count")]
    for name in ("mrr", "recall"):
        delta = F.col(f"{name}_delta")
        measures += [
            F.count_if(delta > 0).cast("bigint").alias(f"{name}_win_count"),
            F.count_if(delta == 0).cast("bigint").alias(f"{name}_tie_count"),
            F.count_if(delta < 0).cast("bigint").alias(f"{name}_loss_count"),
            F.round(F.avg(delta), 6).alias(f"mean_{name}_delta"),
        ]
    return by_dimensions(pairs, dimensions, measures, overall=True)


def exact_match(rows: DataFrame, correct: Column, category: str = "category") -> DataFrame:
    """Exact-match rate overall and by category."""
    scored = rows.select(category, correct.cast("int").alias("correct"))
    return scored.rollup(category).agg(
        F.when(F.grouping(category) == 1, "all").otherwise(F.col(category)).alias("name"),
        F.count(F.lit(1)).cast("bigint").alias("case_count"),
        F.sum("correct").cast("bigint").alias("correct_count"),
        F.round(F.avg("correct"), 6).alias("exact_match"),
    ).drop(category)


def confusion(rows: DataFrame, actual: Column, expected: Column) -> DataFrame:
    """Binary confusion with accuracy, precision, recall and false-positive rate."""
    flags = rows.select(actual.alias("a"), expected.alias("e"))
    counts = flags.agg(
        F.count_if(F.col("a") & F.col("e")).cast("bigint").alias("true_positive"),
        F.count_if(F.col("a") & ~F.col("e")).cast("bigint").alias("false_positive"),
        F.count_if(~F.col("a") & ~F.col("e")).cast("bigint").alias("true_negative"),
        F.count_if(~F.col("a") & F.col("e")).cast("bigint").alias("false_negative"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))

    def rate(top: Column, bottom: Column, name: str) -> Column:
        return F.round(F.when(bottom > 0, top / bottom), 6).alias(name)

    return counts.select(
        "*",
        rate(tp + tn, tp + fp + tn + fn, "accuracy"),
        rate(tp, tp + fp, "precision"),
        rate(tp, tp + fn, "recall"),
        rate(fp, fp + tn, "false_positive_rate"),
    )


def stability(attempts: DataFrame, case: str, fingerprint: Column) -> DataFrame:
    """Whether all repetitions of a case produced the same fingerprint."""
    return attempts.groupBy(case).agg(
        F.count(F.lit(1)).cast("bigint").alias("attempt_count"),
        (F.min(fingerprint) == F.max(fingerprint)).alias("stable"),
    )


def chain_recovery(rows: DataFrame) -> DataFrame:
    """Complete-chain rates of lexical retrieval and of the graph.

    ``rows``: expected_chain, graph_chunks (arrays), lexical_complete, status,
    expected_status.  Lexical retrieval must contain the chain, the graph must
    return it in order; controls expect no chain.
    """
    chained = F.size("expected_chain") > 0
    lexical = F.col("lexical_complete")
    ordered = F.col("graph_chunks") == F.col("expected_chain")
    same = F.col("status") == F.col("expected_status")
    return rows.agg(
        F.count(F.lit(1)).cast("bigint").alias("case_count"),
        F.round(share(F.when(chained, lexical)), 6).alias("lexical_complete_chain_rate"),
        F.round(share(F.when(chained, ordered)), 6).alias("graph_complete_chain_rate"),
        F.round(share(F.when(~chained, same)), 6).alias("control_exact_match"),
        F.round(share(same & ordered), 6).alias("exact_match"),
    )


def gap(expected_chain: Column, lexical_complete: Column, rule_applied: Column, plan_ready: Column) -> Column:
    """Whether a chain question is left unanswered by every simpler method."""
    return expected_chain & ~(lexical_complete | rule_applied | plan_ready)
