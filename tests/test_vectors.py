import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.operators import fusion, vectors


def unit(rng, n, width=6):
    m = rng.normal(size=(n, width))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def frame(spark, matrix, key):
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{key} bigint, embedding array<double>"
    )


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_cosine_top_k_equals_numpy(spark, limit):
    rng = np.random.default_rng(3)
    held, asked = unit(rng, 60), unit(rng, 7)
    got = vectors.cosine_top_k(
        frame(spark, held, "chunk_id"), frame(spark, asked, "query_id"), 5, max_matrix_bytes=limit
    ).orderBy("query_id", "rank").collect()
    scores = np.round(asked @ held.T, 9)
    for q in range(len(asked)):
        order = [int(i) for i in np.lexsort((np.arange(60), -scores[q])) if scores[q][i] >= 0][:5]
        assert [r.chunk_id for r in got if r.query_id == q] == order


def test_ids_of_any_type_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_CELLS", 8)
    monkeypatch.setattr(vectors, "BATCH_VECTORS", 3)
    held = [(f"c{i:02d}", [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(20)]
    df = spark.createDataFrame(held, "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "query_id string, embedding array<double>")
    got = vectors.cosine_top_k(df, asked, 4).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got] == ["c01", "c02", "c04", "c05", "c00", "c03", "c06", "c09"]
    assert vectors.cosine_top_k(df, asked.limit(0), 4).count() == 0


def test_window_mean_and_zero_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [0.0, 3.0])]
    df = spark.createDataFrame(rows, "owner string, v array<double>")
    got = {r.owner: r.v for r in vectors.window_mean(df, "owner", "v").collect()}
    assert got["a"] == pytest.approx([0.5**0.5, 0.5**0.5]) and got["b"] == [0.0, 1.0]
    zero = spark.createDataFrame([("z", [1.0, 0.0]), ("z", [-1.0, 0.0])], "owner string, v array<double>")
    with pytest.raises(Exception, match="no direction"):
        vectors.window_mean(zero, "owner", "v").collect()


def test_token_windows(spark):
    rows = [(n, list(map(str, range(n)))) for n in (0, 1, 4, 5, 8, 9, 23)]
    df = spark.createDataFrame(rows, "n int, t array<string>")
    for r in df.select("n", vectors.token_windows(F.col("t"), 5, 2).alias("w")).collect():
        want, start = [], 0
        while True:
            want.append([str(i) for i in range(start, min(start + 5, r.n))])
            if start + 5 >= r.n:
                break
            start += 3
        assert r.w == want


def test_invalid_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, []), (4, [float("nan"), 0.0]), (5, None)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    assert sorted(r.id for r in vectors.invalid_vectors(df).collect()) == [2, 3, 4, 5]


def test_cache_encodes_only_misses(spark):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    chunks = spark.createDataFrame([(1, "um"), (2, "dois")], "chunk_id bigint, text string")
    cache = spark.createDataFrame(
        [(1, digest("um"), [9.0, 9.0])], "chunk_id bigint, text_sha256 string, embedding array<float>"
    )
    encode = lambda texts: [[float(len(t)), 0.0] for t in texts]
    got = {r.chunk_id: r.embedding for r in vectors.encode_missing(chunks, cache, encode).collect()}
    assert got == {1: [9.0, 9.0], 2: [4.0, 0.0]}
    stale = cache.withColumn("text_sha256", F.lit(digest("outro")))
    with pytest.raises(Exception, match="other text"):
        vectors.encode_missing(chunks, stale, encode).collect()


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id bigint, chunk_id bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id bigint, chunk_id bigint, rank int")
    got = [(r.chunk_id, r.score) for r in fusion.reciprocal_rank([(a, 1.0), (b, 2.0)], 5).orderBy("rank").collect()]
    assert got == [(11, round(1 / 62 + 2 / 61, 9)), (12, round(2 / 62, 9)), (10, round(1 / 61, 9))]
    candidates = a.withColumn("similarity", F.when(F.col("chunk_id") == 11, 0.9).otherwise(0.1))
    order = [r.chunk_id for r in fusion.rerank(candidates, 5, semantic_weight=2.0).orderBy("rank").collect()]
    assert order == [11, 10]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank([(a, 1.0)], 5)
