"""Document fingerprints of closed syncmers.

A closed syncmer is a k-mer of code points whose least s-mer lies at its start or its end. Whether a k-mer is one
depends on the k-mer alone, so equal passages give equal anchors wherever they stand. A fingerprint lists the
anchors of the whole text in order, three bytes each, in base 64; the likeness of two is the share of anchors that
they match: each anchor's occurrences are paired in order of place, and of the pairs the longest chain counts that
stands in one order in both. So moved passages aren't matched, nor is what hashes of 24 bits share by chance: of m
chance pairs about 2 * sqrt(m) stand in one order.

Comparing a document with the next one needs an order of all rows: ranges of doc_id are cut by approximate
percentiles, every range also gets the first document of the range after it, and each is read once, in order.

Defined results: a null text is an empty one, without anchors; a text without a closed syncmer (each one
shorter than k, and some longer ones) has one anchor, the hash of the whole text; so only empty texts have none, which
are alike (1) among themselves and not (0) with others. Rows with one doc_id are
ordered by text; null ids come first; the last row's next is the first row. An empty table gives no row, further
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm import common

K, S = 16, 4
#: Code points that are hashed at once; a longer text is one piece of its own.
SLICE_POINTS = 1_500_000
RANGES_PER_PARTITION = 4


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_POINTS:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _anchors(texts: list[str], k: int, s: int) -> list[np.ndarray]:
    """24-bit hashes of the closed syncmers of each text; k and s are powers of two."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    with np.errstate(over="ignore"):
        grams, width = common.mix(points.astype(np.uint64) + np.uint64(1)), 1
        small = None
        while width < k:
            if width == s:
                small = common.mix(grams)
            if len(grams) <= width:
                grams = grams[:0]
                break
            factor = np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64))
            grams = grams[:-width] * factor + grams[width:]
            width *= 2
        chosen = np.zeros(len(points), dtype=bool)
        if len(grams) and small is not None:
            window = k - s + 1
            least, span = small, 1
            while span * 2 <= window:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < window:
                least = np.minimum(least[: -(window - span)], least[window - span :])
            many = len(least)
            closed = (small[:many] == least) | (small[window - 1 : window - 1 + many] == least)
            chosen[:many] = closed
        left = np.repeat(ends, sizes) - np.arange(len(points))
        chosen &= left >= k
        at = np.flatnonzero(chosen)
        values = (common.mix(grams[at]) >> np.uint64(40)).astype(np.uint32) if len(at) else np.empty(0, np.uint32)
    edges = np.searchsorted(at, np.concatenate([[0], ends]))
    found = [values[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for i in np.flatnonzero((np.diff(edges) == 0) & (sizes > 0)):
        digest = hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).digest()
        found[i] = np.array([int.from_bytes(digest[:3], "big")], dtype=np.uint32)
    return found


def anchors(texts: list[str], k: int = K, s: int = S) -> list[np.ndarray]:
    return [x for a, b in _pieces(texts) for x in _anchors(texts[a:b], k, s)]


def fingerprint(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()).decode()


def read_fingerprint(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, 3).astype(np.uint32)
    return raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each anchor with the number of its occurrence, sorted, and the places."""
    order = np.argsort(values, kind="stable")
    value = values[order].astype(np.int64)
    fresh = np.concatenate([[True], value[1:] != value[:-1]])
    starts = np.flatnonzero(fresh)
    return value << 32 | np.arange(len(value)) - starts[np.cumsum(fresh) - 1], order


def _rising(places: np.ndarray) -> int:
    """Length of the longest rising chain."""
    if (places[1:] > places[:-1]).all():
        return len(places)
    ends: list[int] = []
    for place in places.tolist():
        if not ends or place > ends[-1]:
            ends.append(place)
        else:
            ends[bisect.bisect_left(ends, place)] = place
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the anchors matched in one order in both over all anchors of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    (own, at), (other, there) = _numbered(a), _numbered(b)
    _, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
    return 2 * _rising(there[j][np.argsort(at[i])]) / (len(a) + len(b))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and text by ranges of doc_id; `sentinel` marks, at a range's end, the document after it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    many = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / many for i in range(1, many)], 20 * many)).first()[0]
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(out)

    # at most `many` ranges: their first ids, which range follows which, and the first documents themselves
    firsts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("range", range_of("doc_id"))
    firsts = firsts.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))
    order = Window.orderBy("range")
    after = firsts.select(
        "range", F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy())).alias("before"), F.col("first.doc_id").alias("first_id")
    )
    texts = rows.join(F.broadcast(after), rows["doc_id"].eqNullSafe(after["first_id"])).groupBy("before").agg(F.min("text").alias("text"))
    sentinels = texts.select(F.col("before").alias("range"), F.lit(True).alias("sentinel"), F.lit(None).cast("long").alias("doc_id"), "text")
    own = rows.select(range_of("doc_id").alias("range"), F.lit(False).alias("sentinel"), "doc_id", "text")
    dealt = own.unionByName(sentinels).repartition(many // RANGES_PER_PARTITION, "range")
    return dealt.sortWithinPartitions("range", "sentinel", F.asc_nulls_first("doc_id"), "text")


def compare(docs: DataFrame, *, k: int = K, s: int = S) -> DataFrame:
    """The fingerprints of every document and of its edited text, and their likeness; see the contract of op7."""
    common.prepare(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row whose next one isn't read yet
        for batch in common.slices(batches):
            rows = held + list(zip(*(batch[c].to_pylist() for c in ("sentinel", "doc_id", "text")), strict=True))
            held = rows[-1:]
            texts = [text for *_, text in rows]
            own = anchors(texts, k, s)
            keep = [i for i in range(len(rows) - 1) if not rows[i][0]]
            edited = []
            for i in keep:
                tail = len(texts[i]) // 4
                edited.append(texts[i][: len(texts[i]) - tail] + texts[i + 1][:tail])
            changed = anchors(edited, k, s)
            columns = [
                pa.array([rows[i][1] for i in keep], pa.int64()),
                pa.array([len(texts[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array([fingerprint(own[i]) for i in keep]),
                pa.array([fingerprint(x) for x in changed]),
                pa.array([likeness(own[i], x) for i, x in zip(keep, changed, strict=True)], pa.float64()),
                pa.array([likeness(own[i], own[i + 1]) for i in keep], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if pa.types.is_null(c.type) else c for c in columns], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)
