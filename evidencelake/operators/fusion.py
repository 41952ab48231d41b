"""Rank fusion and candidate-constrained reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.operators import lexical

RANK_CONSTANT = 60
CANDIDATE_DEPTH = 20


def depth(k: int, candidate_depth: int = CANDIDATE_DEPTH) -> int:
    """How many rows each retriever has to deliver before fusing."""
    if candidate_depth <= 0:
        raise ValueError("candidate_depth counts rows: 1 or more")
    return max(k, candidate_depth)


def reciprocal_rank(
    rankings: list[tuple[DataFrame, float]],
    k: int,
    *,
    rank_constant: int = RANK_CONSTANT,
    min_score: float = 0.0,
) -> DataFrame:
    """Fuse ranked lists (query_id, chunk_id, rank) by weighted reciprocal rank."""
    if len(rankings) < 2:
        raise ValueError("give two ranked lists or more to fuse")
    if rank_constant < 0 or any(weight <= 0 for _, weight in rankings):
        raise ValueError("weights are above 0, the rank constant is 0 or more")
    parts = [
        ranked.select(
            "query_id", "chunk_id", (F.lit(float(weight)) / (F.lit(rank_constant) + F.col("rank"))).alias("share")
        )
        for ranked, weight in rankings
    ]
    fused = (
        reduce(DataFrame.unionAll, parts)
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum("share"), lexical.SCORE_DIGITS).alias("score"))
    )
    return lexical.top_k(fused, k, min_score=min_score)


def rerank(
    candidates: DataFrame,
    k: int,
    *,
    rank_constant: int = RANK_CONSTANT,
    base_weight: float = 1.0,
    semantic_weight: float = 1.0,
    min_score: float = 0.0,
) -> DataFrame:
    """Fuse base and semantic ranks of the base candidates only.

    ``candidates``: query_id, chunk_id, rank, similarity; at most the candidate
    depth per query, so the window works on small groups.
    """
    if base_weight <= 0 or semantic_weight <= 0 or rank_constant < 0:
        raise ValueError("both rerank weights are above 0, the rank constant is 0 or more")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("chunk_id"))
    both = candidates.withColumn("semantic_rank", F.row_number().over(order))
    scored = both.select(
        "query_id",
        "chunk_id",
        F.round(
            F.lit(base_weight) / (F.lit(rank_constant) + F.col("rank"))
            + F.lit(semantic_weight) / (F.lit(rank_constant) + F.col("semantic_rank")),
            lexical.SCORE_DIGITS,
        ).alias("score"),
    )
    return lexical.top_k(scored, k, min_score=min_score)


def disagreements(rankings: list[DataFrame], identity: list[str]) -> DataFrame:
    """Chunk ids for which retrievers returned different chunk contents."""
    rows = reduce(DataFrame.unionAll, [r.select("chunk_id", *identity) for r in rankings])
    return rows.distinct().groupBy("chunk_id").count().where(F.col("count") > 1).select("chunk_id")
