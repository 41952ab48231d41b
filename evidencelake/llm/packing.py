"""Packing token sequences: a configuration linear program over the length histogram.

Only the histogram of piece lengths (at most `room` numbers, whatever the input) is brought to the driver. There
multiplicative weights solve the program: each step raises the price of lengths that are covered least, prices
configurations by a knapsack dynamic program, and uses the best one. The solution is rounded down; what is left
over is solved anew, at last by filling sequences greedily. Every piece then finds its place by its rank among the
pieces of its length, in the tasks, with a binary search in the table of configurations.

Defined results: a null text is an empty one (only the end id); a null doc_id stays null; repeated rows are packed
each; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm import common, encode

ROOM = 1024
#: Steps of multiplicative weights in each round, rounds, how fast covered lengths lose weight, how far from the
#: dearest a used configuration may be, and the part of what its lengths lack that a step covers.
STEPS, ROUNDS, RATE, SLACK, PART = 60, 2, 1.0, 0.02, 0.5


def knapsack(prices: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """By dynamic programming: the dearest filling of each capacity, and the length that it takes last (0: none)."""
    lengths = np.flatnonzero(prices > 0)
    values = prices[lengths]
    best, taken = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(room + 1), side="right").tolist()
    for size in range(1, room + 1):
        best[size] = best[size - 1]
        if upto[size]:
            tried = values[: upto[size]] + best[size - lengths[: upto[size]]]
            most = tried.argmax()
            if tried[most] > best[size]:
                best[size], taken[size] = tried[most], lengths[most]
    return best, taken


def _filling(taken: list[int], size: int) -> dict[int, int]:
    chosen: dict[int, int] = {}
    while size > 0:
        length = taken[size]
        if length:
            chosen[length] = chosen.get(length, 0) + 1
        size -= length or 1
    return chosen


def fractional(counts: np.ndarray, room: int, steps: int = STEPS) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Configurations and how often each is used so that, about, all counts are covered.

    A length's price is its size, the program's dual where sequences can be filled, times a weight that falls
    exponentially with its coverage. Each step uses all configurations within SLACK of the dearest, one for each
    length that lacks coverage, by a part of what they lack.
    """
    sizes = np.arange(len(counts))
    demand = np.maximum(counts, 1).astype(float)
    covered = np.where(counts > 0, 0.0, 1.0)
    used: dict[tuple, float] = {}
    for step in range(steps):
        prices = np.where(covered < demand * 0.999, sizes * np.exp(-RATE * covered / demand), 0.0)
        open_lengths = np.flatnonzero(prices)
        if not len(open_lengths):
            break
        best, taken = knapsack(prices, room)
        value = prices[open_lengths] + best[room - open_lengths]
        near = open_lengths[value >= (1 - SLACK) * best[room]][::-1]
        trace = taken.tolist()
        for length in near.tolist():
            chosen = _filling(trace, room - length)
            chosen[length] = chosen.get(length, 0) + 1
            key = tuple(sorted(chosen.items()))
            amount = min((demand[k] - covered[k]) / v for k, v in key) * PART
            if amount <= 0:
                continue
            for k, v in key:
                covered[k] += amount * v
            used[key] = used.get(key, 0.0) + amount
    return [(np.array([k for k, _ in c]), np.array([v for _, v in c]), x) for c, x in used.items()]


def greedy(counts: np.ndarray, room: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Fill sequences with the longest piece that is left, then as full as can be; each filling is used as often as it fits."""
    counts = counts.copy()
    out = []
    while counts.any():
        chosen: dict[int, int] = {}
        first = int(np.flatnonzero(counts)[-1])
        chosen[first] = 1
        space = room - first
        left = counts.copy()
        left[first] -= 1
        if space:
            for length, times in _fullest(left, space):
                chosen[length] = chosen.get(length, 0) + times
        lengths = np.array(sorted(chosen))
        times = np.array([chosen[x] for x in sorted(chosen)])
        repeat = int((counts[lengths] // times).min())
        counts[lengths] -= times * repeat
        out.append((lengths, times, repeat))
    return out


def _fullest(counts: np.ndarray, space: int) -> list[tuple[int, int]]:
    """Pieces that fill the space as far as they can, long ones first where that fills it, else by subset sums."""
    best: list[tuple[int, int]] = []
    lengths = np.flatnonzero(counts[: space + 1])
    reach = np.zeros(space + 1, dtype=np.int64)
    reach[0] = -1
    for length in lengths[::-1]:
        for _ in range(int(min(counts[length], space // length))):
            fresh = np.flatnonzero((reach[: space + 1 - length] != 0) & (reach[length:] == 0))
            fresh = fresh[reach[fresh] != length] if _ == 0 else fresh
            if not len(fresh):
                break
            reach[fresh + length] = length
        if reach[space]:
            break
    size = int(np.flatnonzero(reach)[-1])
    found: dict[int, int] = {}
    while size > 0:
        length = int(reach[size])
        found[length] = found.get(length, 0) + 1
        size -= length
    if all(counts[k] >= v for k, v in found.items()):
        return list(found.items())
    for length in lengths[::-1]:  # the sums reused a piece too often: take the longest that fit instead
        times = int(min(counts[length], space // length))
        if times:
            best.append((int(length), times))
            space -= times * int(length)
    return best


#: Room that a configuration of the program may leave; others are solved anew with what is left.
SPARE = 0


def rounded(left: np.ndarray, room: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], np.ndarray]:
    """Configurations of the program, fullest first, in whole numbers as far as there are pieces; what is left over."""
    left, out = left.copy(), []
    for lengths, times, amount in sorted(fractional(left, room), key=lambda x: -float((x[0] * x[1]).sum())):
        whole = int(min(np.floor(amount + 0.5), (left[lengths] // times).min()))
        if whole > 0 and (lengths * times).sum() >= room - SPARE:
            left[lengths] -= whole * times
            out.append((lengths, times, whole))
    return out, left


def plan(counts: np.ndarray, room: int = ROOM) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Configurations (lengths, multiplicities, number of sequences) that hold exactly `counts` pieces of each length.

    The program is solved and rounded, then solved again for what is left; only the rest of the last rounding is
    filled greedily. Of the roundings (after each round) the one that needs the fewest sequences is taken.
    """
    left = counts.astype(np.int64).copy()
    full = int(left[room])  # a whole sequence each, in any solution
    left[room] = 0
    done = [(np.array([room]), np.array([1]), full)] if full else []
    options = [] if left.any() else [done]
    for _ in range(ROUNDS):
        if not left.any():
            break
        more, left = rounded(left, room)
        done = done + more
        options.append(done + greedy(left, room))
    return min(options, key=lambda option: sum(repeat for *_, repeat in option))


class Places:
    """Where the piece with a given rank among those of its length goes: sequence and offset."""

    def __init__(self, configurations: list[tuple[np.ndarray, np.ndarray, int]], room: int):
        rows = []
        first = 0
        for lengths, times, repeat in configurations:
            at = 0
            for length, many in zip(lengths.tolist(), times.tolist(), strict=True):
                rows.append((length, first, many, repeat, at))
                at += length * many
            first += repeat
        self.sequences = first
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        table = table[np.argsort(table[:, 0], kind="stable")]
        slots = table[:, 2] * table[:, 3]
        self.length, self.first, self.many, self.at = table[:, 0], table[:, 1], table[:, 2], table[:, 4]
        self.bounds = np.searchsorted(self.length, np.arange(room + 2))
        ends = np.cumsum(slots)
        self.begin = ends - slots
        self.base = np.concatenate([self.begin, [ends[-1] if len(ends) else 0]])[self.bounds]

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.base[lengths] + ranks  # slots of one length lie together
        row = np.searchsorted(self.begin, place, side="right") - 1
        inside = place - self.begin[row]
        return self.first[row] + inside // self.many[row], self.at[row] + (inside % self.many[row]) * self.length[row]


def pieces(docs: DataFrame, path: str, end_id: int, room: int) -> DataFrame:
    """Pieces of all documents with their rank among the task's pieces of that length, stored once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(room + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in common.slices(batches):
            bounds, ids = encode.encoder(path).encode(batch["text"])
            ids = np.insert(ids.astype("<u4"), bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            totals = np.diff(bounds)
            many = -(-totals // room)
            row = np.repeat(np.arange(len(totals)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            head = totals[row] - (many[row] - 1) * room  # the first piece takes what full ones leave
            start = np.where(piece == 0, 0, head + (piece - 1) * room)
            length = np.where(piece == 0, head, room)
            begin = bounds[row] + start
            crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(begin, length, strict=True)]
            order = np.argsort(length, kind="stable")
            runs = np.bincount(length, minlength=room + 1)
            within = np.empty(len(row), dtype=np.int64)
            within[order] = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
            rank = within + seen[length]
            seen += runs
            columns = [piece.astype(np.int32), start, length, np.array(crc, dtype=np.int64), rank, np.full(len(row), task)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(row)), *(pa.array(x) for x in columns)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task long"
    return common.store(narrow.mapInArrow(cut, schema), "pieces")


def pack(docs: DataFrame, *, path: str | None = None, end_id: int = 2, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    common.prepare(docs.sparkSession)
    cut = pieces(docs, path or encode.tokenizer_file(encode.BYTE_FILE), end_id, room)
    each = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(room + 1, dtype=np.int64)
    for row in each.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `room` rows
        counts[row["length"]] = row["n"]
    places = Places(plan(counts, room), room)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = each.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            columns = [*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(earlier, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank")
    )
    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
