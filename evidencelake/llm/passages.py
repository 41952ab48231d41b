"""Repeated passages by content-defined chunking.

A gear hash rolls over a text's bytes; a cut is at the start of a word where it is least in some window of a number of
word starts, so cuts depend on the bytes near them alone, and an insertion changes only the chunks around it. A chunk
is known by the digest of the words that follow its cut, as many as any passage of `min_words` words holds after its
first cut (`shape`): such a passage holds a whole chunk for certain, however short its words.

Chunks whose digest two documents hold choose where to look closely: there the digest of each window of `min_words`
words is compared with all others, and the document with the least id that holds the window is the one its text is laid
on. Equal stretches are extended byte by byte along the two texts to whole passages.

Defined results: a null text is an empty one; rows with one doc_id are versions of one document, between which no
passage is sought; a null doc_id is one (the first) document; a text repeated in full is one passage if it is long
enough; repeats inside one document alone aren't reported; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm import common

#: Bytes that the gear hash reaches back, and bytes within which stretches found again are laid on a text together.
REACH, WINDOW = 16, 96
MIN_WORDS = 50
#: Stands for a null doc_id inside.
NO_ID = -(2**63)
GEAR = (common.mix(np.arange(256, dtype=np.uint64) + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)
GEAR[0] = 0
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """Least or greatest of each window of `width` places that begins at a place."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def shape(min_words: int) -> tuple[int, int, int]:
    """Bytes that the hash reaches back, word starts in a window, words in a digest.

    Of the words of a passage, the first reach // 2 may start less than `reach` bytes after its start, so that their
    hashes depend on what stands before it; the window of word starts after them holds a cut; the words from that cut
    on to the passage's end are as many as the digest takes.
    """
    reach = REACH
    while reach > 1 and reach > min_words // 3:
        reach //= 2
    clear = min_words - reach // 2
    window = max(1, clear * 5 // 8)
    return reach, window, clear - window + 1


def _words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    edges = np.diff(np.concatenate([[False], ~WHITE[data], [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _rolled(texts: list[bytes], reach: int) -> tuple[np.ndarray, ...]:
    """Word starts of all texts: place, text and gear hash; and where the texts begin."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    gap = b"\0" * REACH
    # a blank after the zeros, so that a text's first sign starts a word
    data = np.frombuffer(b"".join(gap + b" " + t for t in texts), dtype=np.uint8)
    starts = np.cumsum(sizes + REACH + 1) - sizes
    rolled, step = GEAR[data], 1
    while step < reach:  # the shift drops what lies further back than 32 bytes, this stops sooner
        rolled[step:] += rolled[:-step] << np.uint32(step)
        step *= 2
    rolled ^= rolled >> np.uint32(16)
    rolled *= np.uint32(0x85EBCA6B)
    rolled ^= rolled >> np.uint32(13)
    solid = ~WHITE[data]
    at = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    owner = np.searchsorted(starts, at, side="right") - 1
    fine = (owner >= 0) & (at < (starts + sizes)[owner])  # the zeros between texts are no words of theirs
    return at[fine], owner[fine], rolled[at[fine]], starts


def cuts(texts: list[bytes], min_words: int = MIN_WORDS) -> list[np.ndarray]:
    """Where each text's chunks begin and end: from 0 to its length."""
    reach, window, _ = shape(min_words)
    at, owner, rolled, starts = _rolled(texts, reach)
    chosen = np.zeros(len(at), dtype=bool)
    if len(at) >= window:
        least = _slide(rolled, window, np.minimum).astype(np.int64)
        least[owner[: len(least)] != owner[window - 1 :]] = -1  # windows that lie in one text
        edge = np.full(window - 1, -1, dtype=np.int64)
        chosen = _slide(np.concatenate([edge, least, edge]), window, np.maximum) == rolled
    at, owner = at[chosen], owner[chosen]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, size in enumerate(map(len, texts)):
        own = at[edges[i] : edges[i + 1]] - starts[i]
        out.append(np.concatenate([[0], own[(own > 0) & (own < size)], [size]]) if size else np.zeros(1, dtype=np.int64))
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _digests(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    found = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return np.array(found, dtype=np.uint64).view(np.int64)


def _chunks(text: bytes, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that a text's chunks begin with, and the chunks' digests; without those that too few words follow."""
    first = np.searchsorted(starts, bounds[:-1])
    first = first[first + many <= len(starts)]
    return first, _digests(text, starts[first], ends[first + many - 1])


KEY = {"digest": pa.int64(), "doc_id": pa.int64(), "version": pa.int32()}
PLACE = {**KEY, "start": pa.int32(), "size": pa.int32()}
HIT = {"doc_id": pa.int64(), "version": pa.int32(), "start": pa.int32(), "size": pa.int32(), "first_doc": pa.int64(), "first_version": pa.int32(), "first_start": pa.int32()}


def chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per text and digest of a chunk in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = _bytes(batch["text"])
            parts = []
            for text, bounds in zip(texts, cuts(texts, min_words), strict=True):
                starts, ends = _words_at(np.frombuffer(text, dtype=np.uint8))
                parts.append(np.unique(_chunks(text, bounds, starts, ends, shape(min_words)[2])[1]))
            row = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
            values = [pa.array(np.concatenate(parts)), batch["doc_id"].take(row), batch["version"].take(row)]
            yield pa.RecordBatch.from_arrays(values, list(KEY))

    return _texts(docs).mapInArrow(run, _schema(KEY))


def shared(rows: DataFrame) -> DataFrame:
    """Texts with the digests that another document holds too."""
    same = Window.partitionBy("digest")
    both = rows.withColumn("least", F.min("doc_id").over(same)).withColumn("most", F.max("doc_id").over(same))
    return both.filter("least < most").groupBy("doc_id", "version").agg(F.collect_list("digest").alias("digests"))


def places(docs: DataFrame, known: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The windows of `min_words` words all of whose sure chunks are shared: digest, place and size.

    Sure is a cut that is least in a window of word starts inside; every text that holds the words has that cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, window, many = shape(min_words)
        for batch in common.slices(batches):
            texts = _bytes(batch["text"])
            ids, versions = batch["doc_id"].to_pylist(), batch["version"].to_pylist()
            _, owner, rolled, _ = _rolled(texts, reach)
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i, text in enumerate(texts):
                starts, ends = _words_at(np.frombuffer(text, dtype=np.uint8))
                if len(starts) < min_words:
                    continue
                order = rolled[edges[i] : edges[i + 1]].astype(np.uint64) << np.uint64(32) | np.arange(len(starts), dtype=np.uint64)
                cut = (_slide(order, window, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)[: len(starts) - many + 1]
                cut = cut[cut + many <= len(starts)]
                first, inverse = np.unique(cut, return_inverse=True)
                known = np.isin(_digests(text, starts[first], ends[first + many - 1]), batch["digests"][i].values.to_numpy())
                alone = np.flatnonzero(~known[inverse])
                steps = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(steps, np.maximum(np.maximum(alone + window, cut[alone] + many) - min_words, 0), 1)
                np.add.at(steps, np.maximum(alone - reach // 2 + 1, 0), -1)
                at = np.flatnonzero(np.cumsum(steps)[: len(starts) - min_words + 1] == 0)
                for low in range(0, len(at), 100_000):
                    begin, end = starts[at[low : low + 100_000]], ends[at[low : low + 100_000] + min_words - 1]
                    values = (_digests(text, begin, end), np.full(len(begin), ids[i]), np.full(len(begin), versions[i]), begin, end - begin)
                    yield pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(values, PLACE.values(), strict=True)], list(PLACE))

    met = known.join(_texts(docs), ["doc_id", "version"]).select("doc_id", "version", "digests", "text")
    return met.mapInArrow(run, _schema(PLACE))


def _version():
    """Tells texts with one doc_id apart; where two of them agree, comparing the bytes decides."""
    return F.pmod(F.xxhash64("text"), F.lit(1 << 16)).cast("int").alias("version")


def found_again(rows: DataFrame) -> DataFrame:
    """Windows that a document with a lesser id holds too, and where the least one does: a row per way to lay two texts.

    The rows of a digest lie together, the least document first; they are read in order and not gathered.
    """
    dealt = rows.repartition("digest").sortWithinPartitions("digest", "doc_id", "version", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: np.ndarray | None = None  # the first row of the digest that a batch ended in
        for batch in batches:
            own = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            data = own if head is None else np.concatenate([head, own], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], data[0, 1:] != data[0, :-1]]))
            first = np.repeat(starts, np.diff(np.append(starts, data.shape[1])))
            head = data[:, first[-1:]]
            other = data[:, first]
            again = data[1] != other[1]
            found = (data[1], data[2], data[3], data[4], other[1], other[2], other[3])
            yield pa.RecordBatch.from_arrays([pa.array(v[again]).cast(t) for v, t in zip(found, HIT.values(), strict=True)], list(HIT))

    hits = dealt.mapInArrow(run, _schema(HIT)).withColumn("shift", F.col("first_start") - F.col("start"))
    laid = hits.groupBy("doc_id", "version", "first_doc", "first_version", "shift")
    return laid.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _texts(docs: DataFrame) -> DataFrame:
    """Both joins ask for these rows by the same keys, so that Spark exchanges the texts once."""
    return _rows(docs).select("doc_id", _version(), "text")


def _words(data: np.ndarray) -> int:
    solid = ~WHITE[data]
    return int(solid[0]) + int((solid[1:] & ~solid[:-1]).sum()) if len(data) else 0


def _points(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


def _stretches(hits: list[dict]) -> Iterator[tuple]:
    """What to compare: for each run of windows found again, and each way to lay it on another text, the stretches of both."""
    hits = sorted(hits, key=lambda h: h["start"])
    run: list[dict] = []
    end = 0
    for hit in [*hits, None]:
        if run and (hit is None or hit["start"] > end + WINDOW):
            low, high = max(0, run[0]["start"] - WINDOW), end + WINDOW
            for first_doc, first_version, shift in sorted({(h["first_doc"], h["first_version"], h["shift"]) for h in run}):
                yield first_doc, first_version, shift, low, high
            run, end = [], 0
        if hit is not None:
            run.append(hit)
            end = max(end, hit["end"])


REQUEST = {
    "pair": pa.int64(), "at_doc": pa.int64(), "at_version": pa.int32(), "side": pa.int32(), "low": pa.int32(), "high": pa.int32(),
    "doc_id": pa.int64(), "version": pa.int32(), "first_doc": pa.int64(), "shift": pa.int32(),
}
PIECE = {**{k: REQUEST[k] for k in ("pair", "side", "doc_id", "version", "first_doc", "shift", "low")}, "points": pa.int32(), "whole_left": pa.bool_(), "whole_right": pa.bool_(), "piece": pa.binary()}
PASSAGE = ["doc_id", "version", "start", "end", "n_words", "first_doc_id", "first_start"]
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}


def _schema(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in columns.items())


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) if rows else [[] for _ in columns]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, columns.values(), strict=True)], list(columns))


def _equal_stretches(region: np.ndarray, other: np.ndarray, shift: int, ends: tuple[dict, dict], least: int) -> Iterator[tuple[int, int]]:
    """Equal stretches of two texts laid on each other, cut to words that are whole in both; of `least` bytes or more."""
    low, high = max(0, -shift), min(len(region), len(other) - shift)
    if high - low < least:
        return
    equal = np.zeros(high - low + 2, dtype=bool)
    equal[1:-1] = region[low:high] == other[low + shift : high + shift]
    edges = np.flatnonzero(equal[1:] != equal[:-1]) + low

    def solid(data: np.ndarray, i: int, known: bool) -> bool:
        """Whether a sign stands there; at the edge of what was cut out, unless the text itself ends."""
        return bool(not WHITE[data[i]]) if 0 <= i < len(data) else not known

    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if end - begin < least:
            continue
        if any(solid(d, i, e["whole_left"]) for d, i, e in ((region, begin - 1, ends[0]), (other, begin + shift - 1, ends[1]))):
            while begin < end and not WHITE[region[begin]]:
                begin += 1
        if any(solid(d, i, e["whole_right"]) for d, i, e in ((region, end, ends[0]), (other, end + shift, ends[1]))):
            while end > begin and not WHITE[region[end - 1]]:
                end -= 1
        while begin < end and WHITE[region[begin]]:
            begin += 1
        while end > begin and WHITE[region[end - 1]]:
            end -= 1
        yield begin, end


def repeated(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, version, start, end (code points), n_words, first_doc_id, first_start: a row per passage found again."""
    common.prepare(docs.sparkSession)
    known = shared(chunks(docs, min_words))
    again = found_again(places(docs, known, min_words))
    per_text = again.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "end", "first_doc", "first_version", "shift")).alias("hits"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, version, hits in zip(*(batch[c].to_pylist() for c in ("doc_id", "version", "hits")), strict=True):
                for first_doc, first_version, shift, low, high in _stretches(hits):
                    key = xxhash.xxh3_64_intdigest(f"{doc_id} {version} {low}".encode()) - (1 << 63)
                    shared = (doc_id, version, first_doc, shift)
                    if not rows or rows[-1][0] != key:  # the own stretch once, then all that it is laid on
                        rows.append((key, doc_id, version, 0, low, high, *shared))
                    # a sign more on both sides shows whether words are whole
                    rows.append((key, first_doc, first_version, 1, max(0, low + shift - 4), max(0, high + shift + 4), *shared))
            yield _batch(rows, REQUEST)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = []
            for r in zip(*(batch[c].to_pylist() for c in (*REQUEST, "text")), strict=True):
                r = dict(zip((*REQUEST, "text"), r, strict=True))
                text = r["text"].encode("utf-8", "surrogatepass")
                low, high = min(r["low"], len(text)), min(r["high"], len(text))
                points = _points(np.frombuffer(text[:low], np.uint8))
                rows.append((*(r[k] for k in ("pair", "side", "doc_id", "version", "first_doc", "shift")), low, points, low == 0, high == len(text), text[low:high]))
            yield _batch(rows, PIECE)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["side"] == 0:
                    if own and own[0]["pair"] != r["pair"]:
                        own = []
                    own.append(r)
                    continue
                for o in own if own and own[0]["pair"] == r["pair"] else []:
                    if (o["doc_id"], o["version"]) == (r["doc_id"], r["version"]):
                        rows += _passages(o, r, min_words)
            yield _batch(rows, dict.fromkeys(PASSAGE, pa.int64()))

    asked = per_text.mapInArrow(ask, _schema(REQUEST))
    full = _texts(docs)
    met = asked.join(full, (asked["at_doc"] == full["doc_id"]) & (asked["at_version"] == full["version"])).select(*(asked[c] for c in REQUEST), "text")
    pieces = met.mapInArrow(cut_out, _schema(PIECE)).repartition("pair").sortWithinPartitions("pair", "side")
    found = pieces.mapInArrow(lay, ", ".join(f"{c} long" for c in PASSAGE))
    found = found.groupBy("doc_id", "version", "start", "end", "n_words").agg(F.min(F.struct("first_doc_id", "first_start")).alias("first"))
    plain = [F.when(F.col(c) != NO_ID, F.col(c)).alias(n) for c, n in (("doc_id", "doc_id"), ("first.first_doc_id", "first_doc_id"))]
    return found.select(plain[0], "version", "start", "end", "n_words", plain[1], F.col("first.first_start").alias("first_start"))


def _passages(own: dict, other: dict, min_words: int) -> Iterator[tuple]:
    """The passages with enough words that two stretches share where a shared chunk lays them on each other."""
    a, b = np.frombuffer(own["piece"], np.uint8), np.frombuffer(other["piece"], np.uint8)
    shift = own["low"] + other["shift"] - other["low"]
    for begin, end in _equal_stretches(a, b, shift, (own, other), 2 * min_words - 1):
        words = _words(a[begin:end])
        if words >= min_words:
            at, first = own["points"] + _points(a[:begin]), other["points"] + _points(b[: begin + shift])
            yield own["doc_id"], own["version"], at, at + _points(a[begin:end]), words, other["first_doc"], first


def without_repeats(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with their columns, repeated passages cut out of their texts."""
    doc, version, cut = common.free_names(docs, "key_doc", "key_version", "cut_spans")
    spans = repeated(docs, min_words=min_words).groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end")))).toDF(doc, version, cut)
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.pmod(F.xxhash64(text), F.lit(1 << 16)).cast("int") == F.col(version)), "left")
    kept = F.aggregate(
        cut,
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda done, s: F.struct(
            F.when(s["start"] > done["at"], F.concat(done["text"], F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")))).otherwise(done["text"]).alias("text"),
            F.greatest(done["at"], s["end"]).alias("at"),
        ),
        lambda done: F.concat(done["text"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return joined.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
