"""Text quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are the shares of its word 1- and 2-grams and of the 1-, 2- and 3-grams of its words' shapes
("THE!!" has the shape "A!"), hashed into a fixed number of buckets. Training reads a bounded sample of the labelled
rows, dealt into shards of bounded length that learn by themselves; their weights are averaged (at most BUCKETS numbers). Scoring
reads every text once, without a shuffle: a sparse dot product per text.

Defined results: a null or empty text has no feature and gets the score of the bias alone; a null doc_id is scored
and never held out; repeated rows get equal scores; with no usable label the score is 0.5; an empty table gives no
row. Labels are joined by doc_id; a label that is null or a doc_id with several labels counts as it stands in the
table. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import common

SHAPE_BUCKETS, BUCKETS = 1 << 16, 1 << 18
#: At most so many labelled rows are learnt from; those whose hashed ids are smallest.
TRAIN_ROWS = 16_000
#: Bytes of text that a shard learns from, about; bytes whose n-grams are held at once.
SHARD_BYTES, PORTION_BYTES, EPOCHS = 6_000_000, 500_000, 5
#: Bytes of text that are scored at once; a worker holds several numbers for each of their words.
SCORE_BYTES = 1_000_000
ALPHA, BETA, L1, L2 = 0.5, 0.05, 0.002, 0.0
#: Texts up to this score are taken as low quality.
THRESHOLD = 0.3

_SHAPES: dict[str, int] = {}
_RUNS = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w])\1+"), r"\1"))


def shape(word: str) -> str:
    """Runs of capitals, other letters, digits and equal signs, each as one sign."""
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word


def _shape_hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    if len(_SHAPES) > common.CACHE_WORDS:
        _SHAPES.clear()
    out = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words.to_pylist()):
        value = _SHAPES.get(word)
        if value is None:
            value = _SHAPES[word] = xxhash.xxh3_64_intdigest(shape(word).encode())
        out[i] = value
    return out


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family of n-grams in turn: row, bucket and share of each occurrence."""
    offsets, codes, words = common.split_words(texts)
    surface, shapes = common.word_hashes(words)[codes], _shape_hashes(words)[codes]
    for hashes, n, low, size in (
        (shapes, 1, 0, SHAPE_BUCKETS), (shapes, 2, 0, SHAPE_BUCKETS), (shapes, 3, 0, SHAPE_BUCKETS),
        (surface, 1, SHAPE_BUCKETS, BUCKETS - SHAPE_BUCKETS), (surface, 2, SHAPE_BUCKETS, BUCKETS - SHAPE_BUCKETS),
    ):
        grams, row = common.ngram_hashes(hashes, offsets, n)
        with np.errstate(over="ignore"):
            bucket = (common.mix(grams + np.uint64(n)) % np.uint64(size)).astype(np.int64) + low
        yield row, bucket, (1.0 / np.bincount(row, minlength=len(texts)).clip(1))[row]


def follow_the_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal with elastic-net penalties over sparse examples (buckets, values, label); weights and bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        for at, x, label in examples:
            zi, root = z[at], np.sqrt(n[at])
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] = zi + g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
            n[at] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:BUCKETS], float(w[BUCKETS])


def _examples(texts: pa.Array, labels: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Distinct buckets of each text and their values; families are folded one at a time, so few occurrences are held."""
    keys, values = np.empty(0, np.int64), np.empty(0, np.float32)
    for row, bucket, share in features(texts):
        own, at, times = np.unique(row * BUCKETS + bucket, return_index=True, return_counts=True)
        keys = np.concatenate([keys, own])
        values = np.concatenate([values, (times * share[at]).astype(np.float32)])
    keys, inverse = np.unique(keys, return_inverse=True)
    values = np.bincount(inverse, weights=values)
    edges = np.searchsorted(keys, np.arange(len(texts) + 1) * BUCKETS)
    for label, a, b in zip(labels, edges[:-1], edges[1:], strict=True):
        yield np.append(keys[a:b] % BUCKETS, BUCKETS).astype(np.int32), np.append(values[a:b], 1.0).astype(np.float32), label


def _train(table: pa.Table) -> pa.Table:
    ids = table["doc_id"].to_numpy()
    order = np.lexsort((ids, common.mix(ids.astype(np.uint64))))
    examples = []
    for at in _portions(pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy()[order]):
        part = table.take(pa.array(order[at]))
        examples += _examples(pa.concat_arrays(part["text"].chunks), part["label"].to_pylist())
    weights, bias = follow_the_leader(examples, EPOCHS)
    used = np.flatnonzero(weights)
    return pa.table({"bucket": np.append(used, BUCKETS).astype(np.int64), "weight": np.append(weights[used], bias)})


def _portions(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows of about PORTION_BYTES of text."""
    group = np.cumsum(sizes) // PORTION_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return (slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", usable: Column | None = None, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of all buckets and, last, the bias."""
    common.prepare(docs.sparkSession)
    usable = F.lit(True) if usable is None else usable
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & usable)
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)  # the documented bound of what is learnt from
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, round(size / SHARD_BYTES))
    # the text is part of the key, so rows of one doc_id are spread as well
    sharded = chosen.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(shards)))
    learnt = sharded.groupBy("shard").applyInArrow(_train, "bucket long, weight double")
    found = learnt.groupBy("bucket").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()
    weights = np.zeros(BUCKETS + 1)
    shards = max([r["n"] for r in found], default=1)  # every shard reports its bias
    for r in found:
        weights[r["bucket"]] = r["weight"] / shards
    return weights


def scores(weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    total = np.full(len(texts), float(weights[BUCKETS]))
    for row, bucket, share in features(texts):
        total += np.bincount(row, weights=weights[bucket] * share, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """The columns `keep` of every row and, last, its score."""
    common.prepare(docs.sparkSession)
    small = weights.astype(np.float32)

    found = common.free_names(docs, "score_found")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, size=SCORE_BYTES):
            values = pa.array(scores(small, batch["text"]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), values], [*keep, found])

    narrow = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).schema.add(found, "double")
    return narrow.mapInArrow(run, schema)


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) is divisible by five are never learnt from."""
    usable = F.coalesce(common.crc_remainder("doc_id", 5) != 0, F.lit(False))
    weights = fit(docs, labels, usable=usable)
    found = score(docs.select("doc_id", "text"), weights, "doc_id").toDF("doc_id", "score")
    held_out = F.coalesce(common.crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    return found.select("doc_id", held_out, "score", predicted)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier doesn't reject, with their columns."""
    found = score(docs, fit(docs, labels), *docs.columns)
    return found.filter(F.col(found.columns[-1]) >= THRESHOLD).select(*docs.columns)
