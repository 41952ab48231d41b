"""Near duplicates by DartMinHash: weighted signatures, banded joining, exact check of every link.

Darts fall on each element (a hash of five words) as a Poisson stream ordered by rank, over dyadic cells of the
weight axis; a dart counts if it lies below the element's weight. Each dart belongs to one of the signature's
coordinates, and the earliest dart of a coordinate is kept. A text throws about k ln k + 2k darts however many
elements it has; where a coordinate stays empty, its rank limit is doubled.

Texts are nodes (copies share one). Texts with equal bands meet in a bucket; every text is first compared with the
least of all texts that it meets, which joins large groups with one comparison each. Components that still meet in
buckets are then compared text by text in blocks of bounded size; of the links found, those that join components are
kept. A link is a pair with a Jaccard similarity of the exact shingle sets (32-bit hashes) of at least the threshold.
A pair at the threshold is missed by all 24 bands with a probability of 7 in 100,000.

Defined results: a null text is an empty one; equal texts are one class, so are all empty texts; a text of fewer than
five words is one shingle; a null doc_id gets the class of its text, and classes are named by their least id that
isn't null. Repeated rows give repeated rows. An empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import common
from evidencelake.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Texts of a bucket that are compared at once; larger buckets are cut into blocks that meet pairwise.
BLOCK = 256
#: Elements that are counted at once when the sets of two blocks are compared.
COLUMNS = 4096


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, element (32 bits) and count of each distinct shingle, ordered by row and element."""
    offsets, codes, vocabulary = common.split_words(texts)
    grams, rows = common.ngram_hashes(common.word_hashes(vocabulary)[codes], offsets, words)
    packed, counts = np.unique((rows.astype(np.uint64) << np.uint64(32)) | (grams >> np.uint64(32)), return_counts=True)
    return (packed >> np.uint64(32)).astype(np.int64), packed.astype(np.uint32), counts


def _uniform(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _darts(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, limits: np.ndarray, k: int):
    """Slot (row and coordinate), rank and name of all darts below their row's rank limit."""
    slots, ranks, names = [], [], []
    low, width, cell = 0.0, 1.0, 0
    with np.errstate(over="ignore"):
        while True:
            live = np.flatnonzero(weights > low)
            if not len(live):
                break
            state = common.mix(elements[live].astype(np.uint64) + np.uint64((cell << 32) + (1 << 40)))
            rank = np.zeros(len(live))
            row, weight = rows[live], weights[live]
            while len(state):
                state = common.mix(state + np.uint64(0x9E3779B97F4A7C15))
                rank = rank - np.log(_uniform(state)) / width
                inside = rank <= limits[row]
                state, rank, row, weight = state[inside], rank[inside], row[inside], weight[inside]
                dart = common.mix(state ^ np.uint64(0xD1B54A32D192ED03))
                hit = low + width * _uniform(dart) < weight
                name = common.mix(dart + np.uint64(1))[hit]
                slots.append(row[hit] * k + ((name >> np.uint64(32)) % np.uint64(k)).astype(np.int64))
                ranks.append(rank[hit])
                names.append(name.astype(np.uint32))
            low, width, cell = low + width, max(low + width, 1.0), cell + 1
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, count: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate for each of `count` texts; rows without elements stay zero."""
    found = np.zeros(count * k, dtype=np.uint32)
    total = np.bincount(rows, weights=weights, minlength=count)
    limits = np.divide(k * np.log(k) + 2 * k, total, out=np.zeros(count), where=total > 0)
    open_rows = total > 0
    while open_rows.any():
        mine = open_rows[rows]
        slots, ranks, names = _darts(rows[mine], elements[mine], weights[mine], limits, k)
        filled = np.zeros(count * k, dtype=bool)
        order = np.argsort(-ranks, kind="stable")  # the earliest is written last
        found[slots[order]] = names[order]
        filled[slots] = True
        open_rows = open_rows & ~filled.reshape(count, k).all(axis=1)
        limits = limits * 2
    return found.reshape(count, k)


def band_keys(found: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = found.reshape(len(found), BANDS, ROWS).astype(np.uint64)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(ROWS):
            keys = common.mix(keys + parts[:, :, i] * np.uint64(0xBF58476D1CE4E5B9))
        return keys.view(np.int64)


def sketch(docs: DataFrame, weighted: bool) -> DataFrame:
    """doc_id, node (digest of the text) and the bucket of each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows, elements, counts = shingles(batch["text"])
            weights = counts.astype(float) if weighted else np.ones(len(counts))
            found = signatures(rows, elements, weights, batch.num_rows)
            some = np.bincount(rows, minlength=batch.num_rows) > 0
            keys = band_keys(found)
            buckets = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), pa.array(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["node"], buckets], ["doc_id", "node", "buckets"])

    return nodes(docs).mapInArrow(run, "doc_id long, node binary, buckets array<long>")


def nodes(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))


def _check(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                alike.append(shared >= threshold * (len(both) - shared) - 1e-9)
            keep = pa.array(alike, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share: products of their incidence matrix, COLUMNS elements at a time."""
    sizes = np.array([len(x) for x in sets])
    elements, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    common = times > 1
    number = np.cumsum(common) - 1
    row, column = row[common[column]], number[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[row[a:b], column[a:b] - low] = 1
        shared += part @ part.T
    return shared


def _block_links(rows: list[tuple], threshold: float) -> Iterator[tuple[bytes, bytes]]:
    """Links that join different components among the texts of two blocks, as few as join them.

    rows: component, i, j, block, node, root, set. Two texts of one block are compared where the block meets itself.
    """
    sets = [np.frombuffer(r[6], np.uint32) for r in rows]
    sizes = np.array([len(x) for x in sets])
    shared = _shared(sets)
    alike = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    blocks = np.array([r[3] for r in rows])
    if rows[0][1] != rows[0][2]:
        alike &= blocks[:, None] != blocks[None, :]
    parent = {r[5]: r[5] for r in rows}

    def top(root: bytes) -> bytes:
        while parent[root] != root:
            parent[root] = parent[parent[root]]
            root = parent[root]
        return root

    for x, y in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
        a, b = top(rows[x][5]), top(rows[y][5])
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield rows[x][4], rows[y][4]


def _cross_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between texts of different components that meet in a bucket; members: bucket, node, root.

    Components that meet, directly or through others, are one group; a group beyond BLOCK texts is cut into blocks by
    the nodes' hash, and a text goes to every pair of blocks that holds its own, where the sets are compared.
    """
    mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    met = common.store(members.join(mixed.select("bucket", "low"), "bucket").select("node", "root", "low").distinct(), "mixed")
    groups = components(met.select(F.col("root").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("component"))
    texts = met.select("node", "root").distinct().join(groups, "root")
    sizes = texts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"))
    dealt = texts.join(sizes, "component").join(sets, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "set")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    found += _block_links(group, threshold)
                    group = []
                group.append(row)
            yield _pair_batch(found)
        if group:
            yield _pair_batch(list(_block_links(group, threshold)))

    return dealt.mapInArrow(run, "a binary, b binary")


def _pair_batch(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])


def links(docs: DataFrame, *, threshold: float = THRESHOLD, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows (doc_id, node) and the component of every node that has a link (node, root)."""
    common.prepare(docs.sparkSession)
    sketches = common.store(sketch(docs, weighted), "sketches")
    each = sketches.select("node", F.explode("buckets").alias("bucket"))
    met = each.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last").select("bucket", "leader")
    members = common.store(each.join(met, "bucket").select("bucket", "node", "leader").distinct(), "members")
    firsts = members.groupBy("node").agg(F.min("leader").alias("leader"))
    named = sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = firsts.join(named, "node").select("doc_id", F.col("node").alias("wanted"))

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows, elements, _ = shingles(batch["text"])
            edges = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            sets = [elements[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], ["node", "set"])

    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = full.join(wanted, full["doc_id"].eqNullSafe(wanted["doc_id"])).select("wanted", "text", F.unhex(F.md5("text")).alias("node"))
    sets = chosen.filter(F.col("wanted") == F.col("node")).select("node", "text").mapInArrow(as_sets, "node binary, set binary")
    sets = common.store(sets.dropDuplicates(["node"]), "sets")

    stars = firsts.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    sure = common.store(_check(stars, sets, threshold), "links")
    joined = components(sure)
    placed = members.join(joined, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    more = common.store(_cross_links(placed, sets, threshold), "links")
    return sketches.select("doc_id", "node"), components(sure.unionByName(more))


def classes(docs: DataFrame, *, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size, node: one row per row of docs."""
    rows, roots = links(docs, threshold=threshold, weighted=weighted)
    counted = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    counted = counted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = counted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = counted.select("node", "root").join(named, "root").select("node", "class_id", "class_size")
    return rows.join(of_node, "node").select("doc_id", "class_id", "class_size", "node")


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the least doc_id, with its columns."""
    rows, roots = links(docs, threshold=threshold)
    counted = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    counted = counted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    node, least_id = common.free_names(docs, "node_of", "least_id")
    least = F.struct(F.col("least").isNull().alias("none"), "least", "node")
    chosen = counted.groupBy("root").agg(F.min(least).alias("first")).select(F.col("first.node").alias(node), F.col("first.least").alias(least_id))
    keyed = docs.withColumn(node, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    kept = keyed.join(chosen, node).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(least_id)))
    return kept.dropDuplicates([node]).select(*docs.columns)
