"""Helpers that the text operators share: word splitting, stable hashes, shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.session import ensure_checkpoint_dir, ship_package

#: Text handled at once inside a task; longer batches are cut, single texts never.
SLICE_CHARS = 4_000_000
#: Entries that a worker's word caches hold before they start anew (a cache, not a limit on words).
CACHE_WORDS = 200_000

_HASHES: dict[str, int] = {}


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the executors and name a checkpoint folder."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder that checkpoints use and read it back: lineage ends, nothing runs twice."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece stay near ``size`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // size
        edges = np.flatnonzero(np.diff(group)) + 1
        for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(int(low), int(high - low))


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after another, and where each begins and the last one ends; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ([^\\x20\\x09-\\x0D]+) of each text: offsets per text, code per word, the distinct words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    if len(flat) and not pc.all(filled).as_py():
        rows = np.repeat(np.arange(len(counts)), counts)[filled.to_numpy(zero_copy_only=False)]
        counts = np.bincount(rows, minlength=len(counts))
        flat = flat.filter(filled)
    coded = flat.dictionary_encode()
    return np.concatenate([[0], np.cumsum(counts)]), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(words: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each word."""
    if len(_HASHES) > CACHE_WORDS:
        _HASHES.clear()
    out = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words.to_pylist()):
        value = _HASHES.get(word)
        if value is None:
            value = _HASHES[word] = xxhash.xxh3_64_intdigest(word.encode())
        out[i] = value
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads 64-bit keys."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and their text's number; texts shorter than n words give one window of all."""
    with np.errstate(over="ignore"):
        if len(words) == 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        total = len(words)
        state = np.zeros(total, dtype=np.uint64)
        counts = np.diff(offsets)
        rows = np.repeat(np.arange(len(counts)), counts)
        left = np.repeat(offsets[1:], counts) - np.arange(total)
        for step in range(n):
            inside = left > step
            nearby = np.zeros(total, dtype=np.uint64)
            nearby[: total - step] = words[step:]
            state = np.where(inside, mix(state * np.uint64(0x9E3779B97F4A7C15) + nearby), state)
        first = np.zeros(total, dtype=bool)
        first[offsets[:-1][counts > 0]] = True
        keep = (left >= n) | (first & (np.repeat(counts, counts) < n))
        return state[keep], rows[keep]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where the columns of df have them already."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        found.append(name)
    return found


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
