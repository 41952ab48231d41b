"""Cosine retrieval over unit vectors, window means and the vector cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType

from evidencelake.functions import hashing
from evidencelake.operators import lexical

#: Bytes of a block of queries, vectors of a block, vectors and score cells handled at once.
MAX_MATRIX_BYTES = 64 * 1024 * 1024
BLOCK_VECTORS, BATCH_VECTORS, TILE_CELLS = 100_000, 4_096, 4_000_000


def dot(left: Column, right: Column) -> Column:
    """Dot product of two arrays, accumulated in double."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def invalid_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows that break the matrix contract: empty, odd width or non-finite.

    Widths are compared with the widest vector through one scalar subquery.
    """
    width = vectors.agg(F.max(F.size(vector_col)).alias("w")).select("w").scalar()
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNull() | (F.size(v) == 0) | (F.size(v) != width) | ~finite)


def window_mean(windows: DataFrame, owner: str, vector_col: str) -> DataFrame:
    """Mean of the vectors of each owner, scaled back to unit length.

    Sums are combined per dimension map-side, so an owner may hold any share of
    the windows.  Zero means are rejected rather than normalized.
    """
    per_dimension = (
        windows.select(owner, F.posexplode(vector_col).alias("position", "value"))
        .groupBy(owner, "position")
        .agg(F.avg(F.col("value").cast("double")).alias("mean"))
    )
    ordered = per_dimension.groupBy(owner).agg(
        F.sort_array(F.collect_list(F.struct("position", "mean"))).alias("cells"),
        F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"),
    )
    unit = F.when(
        F.col("norm") > 0, F.transform("cells", lambda c: c["mean"] / F.col("norm"))
    ).otherwise(F.raise_error(F.lit("the windows of an owner cancel out: no direction is left")))
    return ordered.select(owner, unit.alias(vector_col))


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best rows of each query number, ties by id."""
    order = np.lexsort((ids, -scores, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    first = np.searchsorted(queries, queries)
    kept = np.arange(len(queries)) - first < k
    return queries[kept], ids[kept], scores[kept]


class _RunningBest:
    """Best rows per query over the batches of a task; score blocks have at most TILE_CELLS cells."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor = k, floor
        self.rows: tuple[np.ndarray, ...] | None = None

    def add(self, matrix: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, TILE_CELLS // max(len(vectors), 1))
        found = [] if self.rows is None else [self.rows]
        for low in range(0, len(matrix), step):
            scores = np.round(matrix[low : low + step] @ vectors.T, lexical.SCORE_DIGITS)
            if scores.shape[1] > self.k:  # all that tie with the k-th best stay until ids decide
                least = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
                rows, columns = np.nonzero(scores >= np.maximum(least, self.floor)[:, None])
            else:
                rows, columns = np.nonzero(scores >= self.floor)
            found.append(_best(rows + low, ids[columns], scores[rows, columns], self.k))
        self.rows = _best(*(np.concatenate(part) for part in zip(*found)), self.k)

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        queries, ids, scores = self.rows
        columns = {"query_id": query_ids[queries], "chunk_id": ids, "score": scores}
        return pd.DataFrame({name: pd.Series(values, dtype=values.dtype) for name, values in columns.items()})


def _hits(queries: DataFrame, vectors: DataFrame) -> StructType:
    """query_id and chunk_id in their own types, and the score."""
    return StructType(
        [
            StructField("query_id", queries.schema["query_id"].dataType),
            StructField("chunk_id", vectors.schema["chunk_id"].dataType),
            StructField("score", DoubleType()),
        ]
    )


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def cosine_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    *,
    min_score: float = 0.0,
    max_matrix_bytes: int = MAX_MATRIX_BYTES,
) -> DataFrame:
    """Exact cosine top-k of many queries.

    ``vectors``: chunk_id, embedding.  ``queries``: query_id, embedding; ids are
    of any type.  Blocks of queries, of at most ``max_matrix_bytes``, meet blocks
    of vectors, hashed by id so that their number grows with both sides; a task
    keeps the ``k`` best rows per query while it reads, so its memory does not
    grow with its block.
    """
    if k <= 0:
        raise ValueError("k counts rows: 1 or more")
    if not -1 <= min_score <= 1:
        raise ValueError("min_score is a cosine: -1 to 1")
    spark = vectors.sparkSession
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("w")).first()
    held = vectors.agg(F.count(F.lit(1)).alias("n")).first()
    query_blocks = max(1, -(-(asked.n or 0) * (asked.w or 0) * 8 // max_matrix_bytes))
    vector_blocks = max(1, -(-(held.n or 0) // BLOCK_VECTORS), spark.sparkContext.defaultParallelism // query_blocks)
    left = queries.select(
        "query_id",
        "embedding",
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))).alias("vb"),
    )
    right = vectors.select(
        "chunk_id",
        "embedding",
        F.pmod(F.xxhash64("chunk_id"), F.lit(vector_blocks)).cast("int").alias("vb"),
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"),
    )
    schema = _hits(queries, vectors)

    def block(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        best = _RunningBest(k, min_score)
        query_ids = asked["query_id"].to_numpy()
        if len(asked) and len(held):
            matrix = _stack(asked["embedding"])
            for low in range(0, len(held), BATCH_VECTORS):
                part = held.iloc[low : low + BATCH_VECTORS]
                best.add(matrix, _stack(part["embedding"]), part["chunk_id"].to_numpy())
        if best.rows is None:
            best.rows = (np.empty(0, np.int64), held["chunk_id"].to_numpy()[:0], np.empty(0))
        return best.frame(query_ids)

    hits = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(block, schema)
    return lexical.top_k(hits, k)


def token_windows(tokens: Column, capacity: int, overlap: int) -> Column:
    """Overlapping windows; stops with the window that reaches the end."""
    if capacity <= 0 or overlap < 0 or overlap >= capacity:
        raise ValueError("windows need a capacity and a smaller overlap of 0 or more")
    step = capacity - overlap
    last = F.greatest(F.size(tokens) - F.lit(overlap) - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last, F.lit(step)),
        lambda start: F.slice(tokens, start + 1, F.lit(capacity)),
    )


def cache_plan(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Classify every chunk against a vector cache: hit, miss or stale.

    ``cache``: chunk_id, text_sha256 (unique).  Stale means that the cached id
    refers to other content, which callers must treat as an error.
    """
    current = chunks.select("chunk_id", hashing.text_digest(F.col("text")).alias("digest"))
    return current.join(cache.select("chunk_id", "text_sha256"), "chunk_id", "left").select(
        "chunk_id",
        F.when(F.col("text_sha256").isNull(), "miss")
        .when(F.col("text_sha256") != F.col("digest"), "stale")
        .otherwise("hit")
        .alias("state"),
    )


def encode_missing(
    chunks: DataFrame, cache: DataFrame, encode, *, batch_rows: int = 256
) -> DataFrame:
    """Vectors of all chunks: cached ones as they are, misses through ``encode``.

    ``encode`` is the plug-in ``list[str] -> 2-D float array`` and runs per Arrow
    batch in the tasks.  A stale entry fails the job.
    """
    state = cache_plan(chunks, cache)
    checked = state.withColumn(
        "state",
        F.when(
            F.col("state") == "stale", F.raise_error(F.lit("the cache holds other text under this chunk id"))
        ).otherwise(F.col("state")),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                part = batch.iloc[start : start + batch_rows]
                matrix = np.asarray(encode(part["text"].tolist()), dtype=np.float32)
                if matrix.ndim != 2 or len(matrix) != len(part) or not np.isfinite(matrix).all():
                    raise ValueError("encode has to give one finite vector for each text")
                yield pd.DataFrame(
                    {
                        "chunk_id": part["chunk_id"].to_numpy(),
                        "text_sha256": part["text_sha256"].to_numpy(),
                        "embedding": list(matrix),
                    }
                )

    schema = StructType(
        [
            StructField("chunk_id", chunks.schema["chunk_id"].dataType),
            StructField("text_sha256", StringType()),
            StructField("embedding", ArrayType(FloatType())),
        ]
    )
    missing = (
        chunks.join(checked.where(F.col("state") == "miss"), "chunk_id", "left_semi")
        .select("chunk_id", "text", hashing.text_digest(F.col("text")).alias("text_sha256"))
        .mapInPandas(run, schema)
    )
    hits = cache.join(checked.where(F.col("state") == "hit"), "chunk_id", "left_semi")
    return hits.select("chunk_id", "text_sha256", "embedding").unionByName(missing)


