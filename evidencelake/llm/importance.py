"""Importance resampling towards a target: documents are drawn by how much their hashed n-grams resemble the target's.

Prefix CRCs: the texts of a batch are brought to one form (A-Z lower, runs of separators as one space) and scanned
once, which gives the CRC-32 register after every byte. CRCs are linear over GF(2): the CRC of any run of words is the
register at its end plus (xor) the register at its beginning, shifted by the bytes between, so an n-gram of any length
costs two look-ups and one shift and no n-gram is ever built as a string. The scan runs over blocks of bytes side by
side; a block's beginning is carried in by the same shift.

Buckets are counted per task, then summed: at most `buckets` rows a side, which is the proven size of what goes to the
driver and back. The draw is Gumbel top-k: a score is the weight plus noise from a digest of seed and doc_id, so a
rerun draws the same. Scores are whole numbers of a bounded range; their histogram gives the least score drawn, and
only documents from there on are ranked, by ranges of (score, doc_id) and places within a range, never in one task.

Defined results: a null or empty text has no words, no features, weight 0 and is never drawn; a null doc_id is written
as no digits and comes last among ties; repeated rows are documents of their own, drawn in any order among
themselves; with an empty target or no document the gains are 0 or there is no row; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import common

BUCKETS, WORDS, SEED, MIN_WORDS, DRAWN_PERCENT = 10_000, 1, 2024, 20, 10
#: The CRC-32 polynomial, lowest power in the highest bit.
POLYNOMIAL = 0xEDB88320
#: Bytes that a scan takes one after another; as many blocks as there are go side by side.
BLOCK = 1024


@functools.lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    """What one byte does to a register: eight divisions by x."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (table & np.uint32(1)))
    return table


def _apply(tables: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """A linear map of registers, held as what it does to each of their four bytes."""
    r = registers
    return tables[0][r & 0xFF] ^ tables[1][(r >> 8) & 0xFF] ^ tables[2][(r >> 16) & 0xFF] ^ tables[3][r >> 24]


@functools.lru_cache(maxsize=64)
def _shift_tables(power: int) -> np.ndarray:
    """The map of 2**power zero bytes."""
    each = np.arange(256, dtype=np.uint32)
    parts = np.stack([each << np.uint32(8 * i) for i in range(4)])
    if power == 0:
        return np.stack([_byte_table()[p & np.uint32(0xFF)] ^ (p >> np.uint32(8)) for p in parts])
    half = _shift_tables(power - 1)
    return np.stack([_apply(half, _apply(half, p)) for p in parts])


def shift(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes each: multiplication by a power of x, bit by bit of the length."""
    out, lengths = registers.copy(), np.asarray(lengths)
    power = 0
    while len(lengths) and int(lengths.max()) >> power:
        on = np.flatnonzero((lengths >> power) & 1)
        out[on] = _apply(_shift_tables(power), out[on])
        power += 1
    return out


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stream of all texts with A-Z lower and one space between words; beginnings and ends of its words, their texts' numbers.

    Bytes of words are 0-9, letters and everything beyond ASCII, so no multibyte character is ever cut.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, dtype=bool)
    inside[48:58] = inside[97:123] = inside[128:] = True
    stream = lower[data]
    word = inside[stream]
    begins = np.zeros(len(data), dtype=bool)
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:]
    text = np.searchsorted(offsets, np.flatnonzero(first), side="right") - 1
    keep = word.copy()
    keep[1:] |= word[:-1]  # one separator after each word
    stream = np.where(word, stream, np.uint8(32))[keep]
    starts = np.cumsum(keep)[first] - 1
    word, first = word[keep], first[keep]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    return stream, starts, np.flatnonzero(last) + 1, text


class PrefixCrcs:
    """Registers of all prefixes of a stream, from one scan; CRC-32 of any of its substrings."""

    def __init__(self, stream: np.ndarray):
        blocks = max(1, -(-len(stream) // BLOCK))
        padded = np.zeros(blocks * BLOCK, dtype=np.uint8)
        padded[: len(stream)] = stream
        columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
        table, register = _byte_table(), np.zeros(blocks, dtype=np.uint32)
        self.local = np.empty((BLOCK + 1, blocks), dtype=np.uint32)
        self.local[0] = 0
        for i in range(BLOCK):
            register = table[(register ^ columns[i]) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
            self.local[i + 1] = register
        self.carried = np.zeros(blocks, dtype=np.uint32)
        whole, held = _shift_tables(BLOCK.bit_length() - 1), np.zeros(1, dtype=np.uint32)
        for b in range(1, blocks):
            held = _apply(whole, held) ^ register[b - 1 : b]
            self.carried[b] = held[0]

    def substrings(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC-32 (as of zlib) of the bytes from starts to ends, none of them empty."""
        first, last, lengths = starts // BLOCK, (ends - 1) // BLOCK, ends - starts
        before, after = self.local[starts - first * BLOCK, first], self.local[ends - last * BLOCK, last]
        # within a block what was carried into it cancels out
        apart = np.flatnonzero(first != last)
        if len(apart):
            before[apart] ^= shift(self.carried[first[apart]], starts[apart] - first[apart] * BLOCK)
            after[apart] ^= shift(self.carried[last[apart]], ends[apart] - last[apart] * BLOCK)
        ones = np.uint32(0xFFFFFFFF)
        return after ^ shift(before ^ ones, lengths) ^ ones


def features(texts: pa.Array, words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every run of 1 to `words` words, and the number of words of each text."""
    data, offsets = common.utf8_buffer(texts)
    stream, starts, ends, text = normalised(data, offsets)
    counts = np.bincount(text, minlength=len(texts))
    if len(starts) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), counts
    crcs = PrefixCrcs(stream)
    rows, found = [], []
    for n in range(1, min(words, int(counts.max())) + 1):
        whole = text[: len(text) - n + 1] == text[n - 1 :]
        first, last = starts[: len(starts) - n + 1][whole], ends[n - 1 :][whole]
        rows.append(text[: len(text) - n + 1][whole])
        found.append(crcs.substrings(first, last).astype(np.int64) % buckets)
    return np.concatenate(rows), np.concatenate(found), counts


def bucket_counts(docs: DataFrame, words: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in common.slices(batches):
            total += np.bincount(features(batch["text"], words, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    summed = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)  # at most `buckets` rows came
    for r in summed:
        out[r["bucket"]] = r["n"]
    return out


def gains(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """What a feature of each bucket tells for the target, in thousandths of a nat, rounded down."""
    s_all, t_all, size = float(held.sum()), float(wanted.sum()), len(held)
    ratio = [(t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)) for s, t in zip(held.tolist(), wanted.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weigh(docs: DataFrame, target: DataFrame, *, words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    gain = gains(bucket_counts(docs, words, buckets), bucket_counts(target, words, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            row, bucket, counts = features(batch["text"], words, buckets)
            many = np.bincount(row, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            np.add.at(total, row, gain[bucket])
            weight = np.where(many > 0, total // np.maximum(many, 1), 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts), pa.array(many), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))
    return rows.withColumn("score", F.col("weight") + noise.cast("long"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, **more: int) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row.

    Of the N rows with at least `min_words` words the floor(percent * N / 100) of highest score are drawn, ties to the
    smaller doc_id.
    """
    rows = common.store(weigh(docs, target, **more), "weighed")
    eligible = F.col("n_words") >= min_words
    # a gain and the noise are bounded, so the histogram has at most some ten thousand rows at any size
    histogram = rows.filter(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()
    left = sum(r["n"] for r in histogram) * percent // 100
    wanted, least = left, None
    for score, n in sorted(((r["score"], r["n"]) for r in histogram), reverse=True):
        if left > 0:
            least, left = score, left - n
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    near = eligible & (F.col("score") >= least)
    others = rows.filter(~near).select(*columns, F.lit(None).cast("long").alias("rank"))
    return others.unionByName(_ranked(rows.filter(near).select(*columns), wanted))


def _ranked(rows: DataFrame, wanted: int) -> DataFrame:
    """Adds rank by falling score and rising doc_id, null beyond the wanted: ranges of rows, then places in a range."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("salt")]
    # equal rows are told apart by a salt, so no key is longer than a range
    ranged = rows.withColumn("salt", F.rand(7)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = ranged.select(*rows.columns, F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place"))
    placed = common.store(placed, "ranges")  # ranges are drawn from a sample, so they are written once
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per range
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["part"], before))
        before += r["n"]
    ahead = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "part long, ahead long"))
    rank = F.col("ahead") + F.col("place") + 1
    joined = placed.join(ahead, "part")
    return joined.select(*rows.columns, F.when(rank <= wanted, rank).alias("rank"))


def oracle(words: int = WORDS) -> str:
    """The statement for runs of one word; the CRC is divided out byte by byte over the distinct words."""
    if words != 1:
        raise ValueError("the statement holds for single words")
    return rf"""
with t as (select list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, {POLYNOMIAL}) else c >> 1 end) order by i) as v from range(256) r(i)),
dw as (select doc_id, rid, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w
  from (select doc_id, text, row_number() over () as rid from documents)),
bw as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark),
x as (select w, hex(encode(w)) as h from (select w from dw union select w from bw)),
k as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::bigint)), lambda c, b: xor(v[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} as bucket from x, t),
s as (select bucket, count(*) as s from dw join k using (w) group by 1),
g as (select bucket, coalesce(count(b.w), 0) as t from k left join bw b using (w) group by 1),
tot as (select (select count(*) from dw) as sa, (select count(*) from bw) as ta),
gain as (select bucket, floor(1000 * ln((t + 1)::double * (sa + {BUCKETS}) / ((coalesce(s, 0) + 1)::double * (ta + {BUCKETS}))))::bigint as gain from g left join s using (bucket), tot),
f as (select rid, count(*) as n_features, sum(gain)::bigint as total from dw join k using (w) join gain using (bucket) group by 1),
d as (select doc_id, coalesce(n_features, 0)::bigint as n_features, case when n_features > 0 then floor(total / n_features)::bigint else 0 end as weight,
    ('0x' || sha256('{SEED}:' || coalesce(doc_id::varchar, ''))[1:8])::bigint as h
  from (select doc_id, row_number() over () as rid from documents) left join f using (rid)),
e as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from d),
r as (select *, row_number() over (partition by n_features >= {MIN_WORDS} order by score desc, doc_id) as place, count(*) filter (n_features >= {MIN_WORDS}) over () as n from e)
select doc_id, n_features, weight, score, case when n_features >= {MIN_WORDS} and place <= {DRAWN_PERCENT} * n // 100 then place end::bigint as rank from r
"""
