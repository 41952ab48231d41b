"""Language-model scores by logistic context mixing of hashed-context bit predictors.

A token is coded in binary decisions. First, is it a known word (one of the training texts)? The rate of words that
training saw once stands for the unknown. A known word is coded by the bits of its 64-bit hash, as far as they tell
known words apart. An unknown word is spelled by the bits of its bytes. Each bit has three predictors: counts of ones
and zeros under hashed contexts. For words these are no context, a hash of the word of at most three bytes that has
occurred most often in the text so far, which follows a text's language and style, and that hash with one of the word
before (one of 15 values, so many words share one); for bytes the two, three and four bytes before. The predictions are mixed in the logistic domain by weights that a gate chooses by how much the
predictors have seen, and refined by an adaptive map from confidence to how often that confidence was right. Weights
and maps are learnt online, in mini-batches, every occurrence predicted from the counts without itself; each shard
learns alone and they are averaged.

Texts are dealt into blocks of bounded size. A block knows each of its (word, context) pairs once, however often it
occurs, and a pair has one price, so all bits are mixed once a pair. Pairs are merged in shards, one for each prefix of
the hash, so the nodes below a prefix are counted in one place; the few nodes above it are summed in a small table.
Shards grow in number with the pairs, blocks with the texts; a word that is in very many blocks is merged in two
steps (`FAN_IN`). Counts cover every training token. To the driver come totals per context, mixing weights and the
tables of byte contexts, all of fixed size.

Defined results: a null or empty text is its end alone; a null doc_id is never held out and is learnt from; equal rows
get equal scores; with nothing to learn from, all tokens are unknown and base_score is that of V = N = 0; an empty
table gives no row; further columns are ignored.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import common

#: Bytes of text in a block, pairs in a shard (about), blocks that one task merges.
BLOCK_BYTES, SHARD_PAIRS, FAN_IN = 12_000_000, 1_000_000, 2_000
#: Context values: coarse ones divide the fine ones. Hashes of leading short words, which have at most so many bytes.
FINE, COARSE, LEADERS, SHORT = 256, 16, 64, 3
END = " "  # no word holds a space
#: Counts start from this.
START = 0.4
#: Gates by what the fine and the coarse context have seen; steps of the adaptive map.
FINE_EDGES, COARSE_EDGES, STEPS = np.array([1, 2, 4, 8, 16, 64, 256]), np.array([1, 4, 16]), 24
GATES = (len(FINE_EDGES) + 1) * (len(COARSE_EDGES) + 1)
BATCH, RATE = 8192, 0.3
#: Hashed contexts of one, two and three bytes; rare words, about, that one shard learns the weights of spelling from.
BYTE_CONTEXTS, SPELL_WORDS = (1024, 4096, 16_384), 20_000
ROW = "kind int, block long, doc_id {0}, held_out boolean, n long, size long, data binary"


# --- mixing ---


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Mixer:
    """Weights chosen by a gate and, behind them, a map from (gate, confidence) to how often the likelier bit came."""

    def __init__(self, gates: int = GATES):
        self.weights = np.tile([0.2, 0.2, 0.6], (gates, 1))
        self.seen = np.zeros(gates)
        self.came, self.tried = np.zeros((gates, STEPS)), np.zeros((gates, STEPS))

    @staticmethod
    def inputs(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
        """Stretched predictions of the bit that came, from counts of it and of the other one (a column for each context)."""
        return np.log((yes + START) / (no + START))

    @staticmethod
    def gate(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
        """By the counts of the coarse (column 1) and fine (column 2) contexts."""
        total = yes + no
        return np.searchsorted(FINE_EDGES, total[:, 2], side="right") * (len(COARSE_EDGES) + 1) + np.searchsorted(COARSE_EDGES, total[:, 1], side="right")

    @staticmethod
    def _step(sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower step of the map and the share of the next one."""
        place = np.minimum(sure * 2, STEPS - 1.001)
        low = place.astype(np.int64)
        return low, place - low

    def learn(self, x: np.ndarray, gate: np.ndarray, times: np.ndarray) -> None:
        """One mini-batch after another: the map counts, then the weights take a step."""
        for at in range(0, len(x), BATCH):
            xs, g, n = x[at : at + BATCH], gate[at : at + BATCH], times[at : at + BATCH]
            mixed = (self.weights[g] * xs).sum(axis=1)
            low, share = self._step(np.abs(mixed))
            for step, part in ((low, 1 - share), (low + 1, share)):
                np.add.at(self.tried, (g, step), n * part)
                np.add.at(self.came, (g, step), n * part * (mixed > 0) + n * part * (mixed == 0) / 2)
            error = n * (1 - squash(mixed))
            weight = np.bincount(g, weights=n, minlength=len(self.seen))
            self.seen += weight
            rate = RATE * weight / np.sqrt((self.seen * weight).clip(1e-9)) / weight.clip(1e-9)
            for c in range(xs.shape[1]):
                self.weights[:, c] += rate * np.bincount(g, weights=error * xs[:, c], minlength=len(self.seen))

    def numbers(self) -> np.ndarray:
        """What shards add up: weights times what they saw, what they saw, the two maps."""
        return np.concatenate([(self.weights * self.seen[:, None]).ravel(), self.seen, self.came.ravel(), self.tried.ravel()])

    @classmethod
    def of(cls, numbers: np.ndarray) -> Mixer:
        made = cls()
        a, b = GATES * 3, GATES * 4
        seen = numbers[a:b]
        made.weights = np.where(seen[:, None] > 0, numbers[:a].reshape(GATES, 3) / seen.clip(1e-9)[:, None], made.weights)
        made.seen, size = seen, GATES * STEPS
        made.came, made.tried = numbers[b : b + size].reshape(GATES, STEPS), numbers[b + size : b + 2 * size].reshape(GATES, STEPS)
        return made

    def log_chance(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """log10 of the chance of the bit that came: the mean of the mixed and the refined one."""
        mixed = (self.weights[gate] * x).sum(axis=1)
        sure = np.abs(mixed)
        middle = squash(np.arange(STEPS) / 2)
        refined = (self.came + 64 * middle) / (self.tried + 64)
        low, share = self._step(sure)
        likelier = (1 - share) * refined[gate, low] + share * refined[gate, low + 1]
        likelier = (likelier + squash(sure)) / 2
        return np.log10(np.where(mixed > 0, likelier, np.where(mixed < 0, 1 - likelier, 0.5)))


# --- blocks ---


def contexts(codes: np.ndarray, offsets: np.ndarray, short: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Context of each word and, last, of each text's end: 0, or a hash of the short word most frequent before it.

    codes: words; short: which of the distinct words are short; spread: hash of each distinct word.
    """
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(short[codes]) if len(codes) else np.empty(0, np.int64)
    code, owner = codes[at].astype(np.int64), text[at]
    order = np.lexsort((code, owner))  # stable, so places rise within a word
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (owner[order][1:] != owner[order][:-1]) | (code[order][1:] != code[order][:-1])
    first = np.flatnonzero(fresh)
    times = np.empty(len(at), dtype=np.int64)
    times[order] = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) + 1
    record = owner * (1 << 40) + times
    best = np.maximum.accumulate(record) if len(at) else record
    new = np.ones(len(at), dtype=bool)
    new[1:] = best[1:] > best[:-1]
    leader = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
    # places: the words of a text, then its end
    place = np.concatenate([np.arange(len(codes)), offsets[1:]])
    owner_of = np.concatenate([text, np.arange(len(counts))])
    before = np.searchsorted(at, place) - 1
    held = before >= 0
    held[held] = owner[before[held]] == owner_of[held]
    out = np.zeros(len(place), dtype=np.uint8)
    out[held] = 1 + (spread[code[leader[before[held]]]] % np.uint64(LEADERS - 1)).astype(np.uint8)
    return out


def words_before(codes: np.ndarray, offsets: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Hash of the word before each word and, last, before each text's end: 0 where a text begins."""
    hashed = 1 + ((spread[codes] >> np.uint64(32)) % np.uint64(FINE // COARSE - 1)).astype(np.uint8)
    out = np.zeros(len(codes) + len(offsets) - 1, dtype=np.uint8)
    out[1 : len(codes)] = hashed[:-1]
    filled = offsets[:-1] < offsets[1:]
    out[offsets[:-1][filled]] = 0
    out[len(codes) :][filled] = hashed[offsets[1:][filled] - 1]
    return out


def byte_events(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of the words and of the space after each: word, the contexts (one a column), the byte."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    stream = np.frombuffer(b" ".join(words) + b" " if words else b"", dtype=np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    within = np.arange(len(stream)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    past, held = np.zeros(len(stream), dtype=np.uint64), []
    with np.errstate(over="ignore"):
        for k in range(4):
            earlier = np.where(within > k, np.concatenate([np.full(k + 1, 32), stream])[: len(stream)], 32)
            past = past * np.uint64(256) + earlier.astype(np.uint64)
            held.append(common.mix(past + np.uint64(k << 40)))
    context = [(h % np.uint64(size)).astype(np.int64) for h, size in zip(held[1:], BYTE_CONTEXTS, strict=True)]
    return word, np.stack(context, axis=1), stream


_BYTE_LOW = np.cumsum([0, *BYTE_CONTEXTS])[:3] * 256


def byte_slots(held: np.ndarray, stream: np.ndarray) -> np.ndarray:
    return (held * 256 + stream[:, None] + _BYTE_LOW).ravel()


class Block:
    """Texts of bounded size: their tokens as numbers of (word, context) pairs."""

    def __init__(self, texts: pa.Array, held_out: np.ndarray):
        self.offsets, codes, words = common.split_words(pc.ascii_lower(pc.fill_null(texts, "")))
        counts, many = np.diff(self.offsets), len(words)
        self.words = [*(w.encode() for w in words.to_pylist()), END.encode()]
        hashes = np.append(common.word_hashes(words), common.word_hashes(pa.array([END])))
        short = np.fromiter(map(len, self.words), dtype=np.int64, count=many + 1) <= SHORT
        with np.errstate(over="ignore"):
            spread = common.mix(hashes)
            apart = common.mix(spread)
        context = contexts(codes, self.offsets, short, spread) % COARSE + words_before(codes, self.offsets, apart) * COARSE
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.order = hashes[order], order
        rank = np.empty(many + 1, dtype=np.int64)
        rank[order] = np.arange(many + 1)
        token = np.concatenate([rank[codes], np.full(len(counts), rank[many])]) * FINE + context
        self.text = np.concatenate([np.repeat(np.arange(len(counts)), counts), np.arange(len(counts))])
        learnt = ~held_out[self.text]
        self.pairs, self.at = np.unique(token, return_inverse=True)
        self.times = np.bincount(self.at[learnt], minlength=len(self.pairs))
        self.word_times = np.bincount(self.pairs // FINE, weights=self.times, minlength=many + 1).astype(np.int64)

    def packed(self) -> bytes:
        """Hash of each word, number of its pairs; context and training count of each pair."""
        many = np.bincount(self.pairs // FINE, minlength=len(self.hashes))
        return pack(self.hashes, many, self.pairs % FINE, self.times)

    def places(self) -> list[bytes]:
        """Of each text the numbers of its tokens' pairs, rising, as differences."""
        order = np.lexsort((self.at, self.text))
        at, text = self.at[order], self.text[order]
        steps = np.diff(at, prepend=0)
        starts = np.searchsorted(text, np.arange(len(self.offsets)))
        steps[starts[:-1]] = at[starts[:-1]]
        steps = steps.astype("<u4")
        return [steps[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def spelled(self, times: int) -> tuple[np.ndarray, list[bytes]]:
        """Places and spelling of the words that training texts of the block hold so often; the end has no letter."""
        chosen = np.flatnonzero(self.word_times == times)
        last = len(self.words) - 1
        return chosen, [b"" if i == last else self.words[i] for i in self.order[chosen].tolist()]


def pack(hashes: np.ndarray, many: np.ndarray, context: np.ndarray, times: np.ndarray) -> bytes:
    head = np.array([len(hashes), len(context)], dtype="<u4").tobytes()
    return b"".join([head, hashes.astype("<u8").tobytes(), many.astype("<u2").tobytes(), context.astype("u1").tobytes(), times.astype("<i8").tobytes()])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    w, p = np.frombuffer(data, dtype="<u4", count=2).astype(np.int64).tolist()
    at = 8
    out = []
    for kind, count in (("<u8", w), ("<u2", w), ("u1", p), ("<i8", p)):
        out.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
        at += count * np.dtype(kind).itemsize
    return out[0].astype(np.uint64), out[1].astype(np.int64), out[2].astype(np.int64), out[3].astype(np.int64)


def _words_packed(places: np.ndarray, words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    return b"".join([np.array([len(words)], dtype="<u4").tobytes(), places.astype("<u4").tobytes(), lengths.tobytes(), *words])


def _words_unpacked(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    n = int(np.frombuffer(data, dtype="<u4", count=1)[0])
    places = np.frombuffer(data, dtype="<u4", count=n, offset=4).astype(np.int64)
    lengths = np.frombuffer(data, dtype="<u4", count=n, offset=4 + 4 * n).astype(np.int64)
    edges = (np.concatenate([[0], np.cumsum(lengths)]) + 4 + 8 * n).tolist()
    return places, [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def in_blocks(docs: DataFrame, held_out) -> DataFrame:
    """Rows of ROW, by kind: 0 a text, 1 the pairs of a block, 2 its words that training texts of it don't hold,
    3 counts of bytes in rare words of a task, 4 these words with their hashes (n)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, bytes_held = None, np.zeros(sum(BYTE_CONTEXTS) * 256, dtype=np.int64)
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def rows(what: int, block: int, data: list[bytes], n: list[int], *more: pa.Array) -> pa.RecordBatch:
            ids, out, sizes = more or (pa.nulls(len(data), schema.field("doc_id").type), pa.nulls(len(data), pa.bool_()), pa.nulls(len(data), pa.int64()))
            same = pa.array([what] * len(data), pa.int32()), pa.array([block] * len(data), pa.int64())
            return pa.RecordBatch.from_arrays([*same, ids, out, pa.array(n, pa.int64()), sizes, pa.array(data, pa.binary())], ["kind", "block", "doc_id", "held_out", "n", "size", "data"])

        def finish() -> Iterator[pa.RecordBatch]:
            texts = pa.concat_arrays([b["text"] for b in held])
            ids, out = pa.concat_arrays([b["doc_id"] for b in held]), pa.concat_arrays([b["held_out"] for b in held])
            made, block = Block(texts, out.to_numpy(zero_copy_only=False).astype(bool)), task * (1 << 32) + number
            places = made.places()
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield rows(0, block, places, [len(p) // 4 for p in places], ids, out, sizes)
            yield rows(1, block, [made.packed()], [len(made.pairs)])
            at, words = made.spelled(0)
            yield rows(2, block, [_words_packed(at, words)], [len(words)])
            at, words = made.spelled(1)
            _, context, stream = byte_events(words)
            np.add(bytes_held, np.bincount(byte_slots(context, stream), minlength=len(bytes_held)), out=bytes_held)
            if words:
                yield rows(4, block, words, (made.hashes[at] >> np.uint64(1)).astype(np.int64).tolist())

        for batch in common.slices(batches):
            schema = batch.schema
            held.append(batch)
            size += batch["text"].nbytes
            if size >= BLOCK_BYTES:
                yield from finish()
                held, size, number = [], 0, number + 1
        if held:
            yield from finish()
        if schema is not None:
            used = np.flatnonzero(bytes_held)
            yield rows(3, task, [used.astype("<u4").tobytes() + bytes_held[used].astype("<i8").tobytes()], [len(used)])

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, ROW.format(kind))


# --- shards ---


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One table of the parts' pairs and, for each pair of theirs, its place in it."""
    hashes = np.concatenate([np.repeat(h, many) for h, many, _, _ in parts])
    context, times = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    order = np.lexsort((context, hashes))
    hashes, context = hashes[order], context[order]
    word = np.ones(len(order), dtype=bool)
    word[1:] = hashes[1:] != hashes[:-1]
    fresh = word.copy()
    fresh[1:] |= context[1:] != context[:-1]
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    at = np.flatnonzero(word[fresh])
    return hashes[word], np.diff(np.append(at, len(first))), context[first], np.add.reduceat(times[order], first), place


MERGED = "shard long, salt long, data binary, blocks array<long>, sizes array<long>, places binary, totals array<long>, once array<long>, words long"


def _merge(table: pa.Table) -> pa.Table:
    """The parts of one shard (and salt) as one row."""
    parts = [unpack(x) for x in table["data"].to_pylist()]
    hashes, many, context, times, place = merged(parts)
    seen = np.add.reduceat(times, np.cumsum(many) - many)
    once = np.repeat(seen == 1, many)
    totals = np.bincount(context, weights=times, minlength=FINE).astype(np.int64)
    single = np.bincount(context[once], weights=times[once], minlength=FINE).astype(np.int64)
    row = {
        "shard": table["shard"][0].as_py(), "salt": table["salt"][0].as_py(), "data": pack(hashes, many, context, times),
        "blocks": table["block"].to_pylist(), "sizes": [len(p[2]) for p in parts], "places": place.astype("<u4").tobytes(),
        "totals": totals.tolist(), "once": single.tolist(), "words": int((seen > 0).sum()),
    }
    return pa.Table.from_pylist([row], schema=_ARROW_MERGED)


_ARROW_MERGED = pa.schema([
    ("shard", pa.int64()), ("salt", pa.int64()), ("data", pa.binary()), ("blocks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("places", pa.binary()), ("totals", pa.list_(pa.int64())), ("once", pa.list_(pa.int64())), ("words", pa.int64()),
])


def _split(bits: int, salts: int):
    """Deals the words of a block to shards by the first bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"], strict=True):
                hashes, many, context, times = unpack(data.as_py())
                shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
                pairs = np.concatenate([[0], np.cumsum(many)])
                cut = [pack(hashes[a:b], many[a:b], context[pairs[a] : pairs[b]], times[pairs[a] : pairs[b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                salt = block * 31 % 1_000_003 % salts
                yield pa.RecordBatch.from_pydict({"shard": shard[edges[:-1]], "salt": [salt] * len(cut), "block": [block] * len(cut), "data": pa.array(cut, pa.binary())})

    return run


def shared_bits(hashes: np.ndarray) -> np.ndarray:
    """Leading bits that each hash shares with the one before it."""
    apart = hashes[1:] ^ hashes[:-1]
    high, low = (apart >> np.uint64(32)).astype(np.float64), (apart & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]).astype(np.int64)


def _sums(fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts under no context and under the coarse contexts, from those of the fine ones (nodes, FINE, 2)."""
    coarse = fine.reshape(len(fine), FINE // COARSE, COARSE, 2).sum(axis=1)
    return coarse.sum(axis=1), coarse


def _counts(fine: np.ndarray, node: np.ndarray, context: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each event how often its bit and the other one came, under the three contexts."""
    none, coarse = _sums(fine)
    both = [np.stack([none[node, b], coarse[node, context % COARSE, b], fine[node, context, b]], axis=1) for b in (bit, 1 - bit)]
    return both[0], both[1]


def bit_events(hashes: np.ndarray, many: np.ndarray, context: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs and counts of every bit that tells words of the table apart, level by level, nodes in bounded portions."""
    shared, ends = shared_bits(hashes), np.concatenate([[0], np.cumsum(many)])
    for level in np.unique(shared):
        middle = np.flatnonzero(shared == level) + 1
        outside = np.concatenate([[0], np.flatnonzero(shared < level) + 1, [len(hashes)]])
        after = np.searchsorted(outside, middle, side="right")
        low, mid, high = ends[outside[after - 1]], ends[middle], ends[outside[after]]
        portion = 1_048_576 // FINE
        for a in range(0, len(middle), portion):
            l, m, h = low[a : a + portion], mid[a : a + portion], high[a : a + portion]
            sizes = h - l
            node = np.repeat(np.arange(len(l)), sizes)
            pair = np.arange(sizes.sum()) + np.repeat(l - (np.cumsum(sizes) - sizes), sizes)
            bit = (pair >= m[node]).astype(np.int64)
            key = (node * FINE + context[pair]) * 2 + bit
            fine = np.bincount(key, weights=times[pair], minlength=len(l) * FINE * 2).reshape(len(l), FINE, 2)
            yield pair, *_counts(fine, node, context[pair], bit)


def upper_events(above: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of the bits that lead to a shard, one event a context; above: totals of its prefixes, shortest first."""
    for outer, inner in zip(above[:-1], above[1:], strict=True):
        if (outer > inner).any():
            fine = np.stack([outer - inner, inner], axis=1)[None].astype(np.float64)
            one = np.ones(FINE, dtype=np.int64)
            yield _counts(fine, np.zeros(FINE, np.int64), np.arange(FINE), one)


def _known(data: bytes) -> tuple[np.ndarray, ...]:
    """The table, which of its words are known, and the table of those alone."""
    hashes, many, context, times = unpack(data)
    seen = np.add.reduceat(times, np.cumsum(many) - many) if len(many) else np.empty(0, np.int64)
    return hashes, many, context, times, seen


def learn_bits(data: bytes, above: np.ndarray) -> Mixer:
    """Weights of one shard; an occurrence is predicted without itself, so words seen once teach nothing here."""
    hashes, many, context, times, seen = _known(data)
    mixer, keep = Mixer(), seen > 0
    pairs = np.repeat(keep, many)
    repeated = np.repeat(seen > 1, many)[pairs]
    context, times = context[pairs], times[pairs]
    often = np.where(repeated, times, 0)
    shares = np.bincount(context, weights=often, minlength=FINE)
    for yes, no in upper_events(above):
        use = (shares > 0) & (yes[:, 2] > 0)
        yes = np.maximum(yes - 1, 0)
        mixer.learn(Mixer.inputs(yes[use], no[use]), Mixer.gate(yes[use], no[use]), shares[use])
    for pair, yes, no in bit_events(hashes[keep], many[keep], context, times):
        use = often[pair] > 0
        yes = yes[use] - 1
        mixer.learn(Mixer.inputs(yes, no[use]), Mixer.gate(yes, no[use]), often[pair][use].astype(np.float64))
    return mixer


def prices(data: bytes, above: np.ndarray, mixer: Mixer, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the chance of each pair of a shard (of an unknown word without its spelling) and counts of its words.

    flags: log10 of the chance of a known and an unknown word under each context.
    """
    hashes, many, context, times, seen = _known(data)
    keep = seen > 0
    pairs = np.repeat(keep, many)
    out = flags[1, context]
    known, total = context[pairs], np.zeros(int(pairs.sum()))
    top = np.zeros(FINE)
    for yes, no in upper_events(above):
        top += mixer.log_chance(Mixer.inputs(yes, no), Mixer.gate(yes, no))
    for pair, yes, no in bit_events(hashes[keep], many[keep], known, times[pairs]):
        total[pair] += mixer.log_chance(Mixer.inputs(yes, no), Mixer.gate(yes, no))
    out[pairs] = total + top[known] + flags[0, known]
    return out, seen


# --- spelling ---


class Speller:
    """Chances of unknown words by their bytes; heaps hold the counts of all beginnings of a byte's bits."""

    def __init__(self, counts: np.ndarray):
        heap = np.zeros((sum(BYTE_CONTEXTS), 512), dtype=np.float32)
        heap[:, 256:] = counts.reshape(-1, 256)
        for width in (128, 64, 32, 16, 8, 4, 2, 1):
            heap[:, width : 2 * width] = heap[:, 2 * width : 4 * width].reshape(-1, width, 2).sum(axis=2)
        self.heap, self.mixer = heap, Mixer()

    def mixed_by(self, mixer: Mixer) -> Speller:
        """The same counts, not copied, mixed by other weights."""
        made = copy.copy(self)
        made.mixer = mixer
        return made

    def _bits(self, words: list[bytes], less: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        word, context, stream = byte_events(words)
        rows = context + np.cumsum([0, *BYTE_CONTEXTS])[:3]
        for depth in range(8):
            child = (1 << (depth + 1)) | (stream >> (7 - depth))
            yes = np.maximum(self.heap[rows, child[:, None]].astype(np.float64) - less, 0)
            yield word, yes, self.heap[rows, child[:, None] ^ 1].astype(np.float64)

    def learn(self, words: list[bytes]) -> None:
        """From words that are among the counted ones, each predicted without itself."""
        for at in range(0, len(words), 500):
            for _, yes, no in self._bits(words[at : at + 500], 1):
                self.mixer.learn(Mixer.inputs(yes, no), Mixer.gate(yes, no), np.ones(len(yes)))

    def log_chance(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            for word, yes, no in self._bits(part, 0):
                out[at : at + 5000] += np.bincount(word, weights=self.mixer.log_chance(Mixer.inputs(yes, no), Mixer.gate(yes, no)), minlength=len(part))
        return out


def speller(blocks: DataFrame) -> Callable[[], Speller]:
    """Byte counts of the rare words of all tasks, and weights that shards of all these words learn; to be called anywhere.

    The counts are sent out once. Shards grow in number with the words; each learns alone and they are averaged.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in zip(batch["n"].to_pylist(), batch["data"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"slot": np.frombuffer(data, "<u4", n).astype(np.int64), "n": np.frombuffer(data, "<i8", n, 4 * n)})

    summed = blocks.filter("kind = 3").select("n", "data").mapInArrow(flat, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(sum(BYTE_CONTEXTS) * 256)  # no more rows than this came
    counts[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    held = blocks.sparkSession.sparkContext.broadcast(Speller(counts))

    def learnt(table: pa.Table) -> pa.Table:
        made = held.value.mixed_by(Mixer())
        made.learn(table.sort_by("n")["data"].to_pylist())
        numbers = made.mixer.numbers()
        return pa.table({"place": np.arange(len(numbers)), "value": numbers})

    found = blocks.filter("kind = 4")
    shards = max(1, round(found.agg(F.approx_count_distinct("n")).first()[0] / SPELL_WORDS))
    words = found.groupBy("n").agg(F.min("data").alias("data"))
    mixer = _added_up(words.groupBy(F.pmod("n", F.lit(shards))).applyInArrow(learnt, "place long, value double"))
    return lambda: held.value.mixed_by(mixer)


def flag_prices(totals: np.ndarray, once: np.ndarray) -> np.ndarray:
    """log10 of the chances of a known (row 0) and an unknown word under each context, from all training tokens."""
    fine = np.stack([totals - once, once], axis=1)[None].astype(np.float64)
    every, zero, one = np.arange(FINE), np.zeros(FINE, np.int64), np.ones(FINE, np.int64)
    mixer = Mixer()
    for _ in range(20):
        for bit, times in ((zero, totals - once), (one, once)):
            yes, no = _counts(fine, zero, every, bit)
            mixer.learn(Mixer.inputs(yes, no), Mixer.gate(yes, no), times.astype(np.float64))
    pair = [_counts(fine, zero, every, bit) for bit in (zero, one)]
    return np.stack([mixer.log_chance(Mixer.inputs(*p), Mixer.gate(*p)) for p in pair])


# --- all together ---


def _answers(row: dict, price: np.ndarray, seen: np.ndarray, many: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """For each block of a merged row: prices of its pairs, where words begin, counts of the words."""
    word_of, at = np.repeat(np.arange(len(many)), many), 0
    for block, size in zip(row["blocks"], row["sizes"], strict=True):
        here = place[at : at + size]
        at += size
        word = word_of[here]
        first = np.diff(word, prepend=-1) != 0
        counts = seen[word[first]]
        yield block, b"".join([np.array([size, len(counts)], "<u4").tobytes(), price[here].astype("<f4").tobytes(), first.astype("u1").tobytes(), counts.astype("<i8").tobytes()])


def _finish(speller_of, n: int, v: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("shard")
        price, first, seen = [], [], []
        for data in answers["data"].to_pylist():
            size, words = np.frombuffer(data, "<u4", 2).tolist()
            price.append(np.frombuffer(data, "<f4", size, 8))
            first.append(np.frombuffer(data, "u1", size, 8 + 4 * size))
            seen.append(np.frombuffer(data, "<i8", words, 8 + 5 * size))
        price, seen = np.concatenate(price).astype(np.float64), np.concatenate(seen)
        word_of = np.cumsum(np.concatenate(first)) - 1
        spelling = np.zeros(len(seen))
        for data in texts.filter(pc.equal(texts["kind"], 2))["data"].to_pylist():
            at, words = _words_unpacked(data)
            unknown = np.flatnonzero(seen[at] == 0)
            spelling[at[unknown]] = speller_of().log_chance([words[i] for i in unknown.tolist()])
        price += spelling[word_of]
        base = np.log10((seen + 1) / (n + v + 1))[word_of]
        known = (seen > 0)[word_of]
        rows = texts.filter(pc.equal(texts["kind"], 0))
        lengths = rows["n"].to_numpy()
        starts = np.cumsum(lengths) - lengths
        steps = np.frombuffer(b"".join(rows["data"].to_pylist()), "<u4").astype(np.int64)
        total = np.cumsum(steps)
        at = total - np.repeat(total[starts] - steps[starts], lengths)
        summed = lambda x: np.add.reduceat(x[at], starts)
        score = summed(price)
        bits = -score * math.log2(10) / np.maximum(rows["size"].to_numpy(), 1)
        columns = [rows["doc_id"], rows["held_out"], rows["n"], pa.array(summed(known.astype(np.int64))), pa.array(np.full(len(lengths), n)), pa.array(summed(base)), pa.array(score), pa.array(bits)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    return run


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte of every row.

    held_out: a column; the texts for which it's true are never learnt from.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    blocks = common.store(in_blocks(docs, held_out), "blocks")
    size = blocks.filter("kind = 1").agg(F.sum("n").alias("pairs"), F.count("*").alias("blocks")).first()
    bits = max(0, math.ceil(math.log2(max(1, (size["pairs"] or 0) / SHARD_PAIRS))))
    salts = -(-max(1, size["blocks"]) // FAN_IN)
    split = blocks.filter("kind = 1").select("block", "data").mapInArrow(_split(bits, salts), "shard long, salt long, block long, data binary")
    parts = common.store(split.groupBy("shard", "salt").applyInArrow(_merge, MERGED), "parts")
    tables = parts
    if salts > 1:  # words of very many blocks are merged in two steps
        again = parts.select("shard", F.lit(0).cast("long").alias("salt"), F.col("salt").alias("block"), "data")
        tables = common.store(again.groupBy("shard").applyInArrow(_merge, MERGED), "tables")
    held = tables.select("words", F.posexplode(F.arrays_zip("totals", "once")).alias("context", "x")).groupBy("context")
    rows = held.agg(F.sum("x.totals").alias("n"), F.sum("x.once").alias("once"), F.sum("words").alias("words")).orderBy("context").collect()  # a row per context
    totals, once = (np.array([r[c] for r in rows] or [0] * FINE, dtype=np.int64) for c in ("n", "once"))
    n, v = int(totals.sum()), rows[0]["words"] if rows else 0
    flags = flag_prices(totals, once)
    tables = _with_prefixes(tables, bits)
    mixer = _learnt(tables)
    spelt = speller(blocks)

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                price, seen = prices(row["data"], np.array(row["above"]).reshape(-1, FINE), mixer, flags)
                if salts == 1:
                    many, place = unpack(row["data"])[1], np.frombuffer(row["places"], "<u4").astype(np.int64)
                    found = list(_answers(row, price, seen, many, place))
                else:
                    found = [(-1, price.astype("<f4").tobytes() + seen.astype("<i8").tobytes())]
                yield pa.RecordBatch.from_pydict({"shard": [row["shard"]] * len(found), "block": [b for b, _ in found], "data": pa.array([d for _, d in found], pa.binary())})

    answer = "shard long, block long, data binary"
    answers = tables.select("shard", "data", "blocks", "sizes", "places", "above").mapInArrow(priced, answer)
    if salts > 1:
        whole = tables.select("shard", F.col("data").alias("whole")).join(answers.select("shard", F.col("data").alias("prices")), "shard")
        whole = common.store(whole, "prices")
        answers = parts.select("shard", "data", "blocks", "sizes", "places").join(whole, "shard").mapInArrow(_looked_up, answer)
    texts = blocks.filter("kind in (0, 2)")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(spelt, n, v), out)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of a part of a shard from the prices of the whole one."""
    for batch in batches:
        for row in batch.to_pylist():
            hashes, many, context, _ = unpack(row["whole"])
            price = np.frombuffer(row["prices"], "<f4", len(context))
            seen = np.frombuffer(row["prices"], "<i8", len(hashes), 4 * len(context))
            own, own_many, own_context, _ = unpack(row["data"])
            word = np.searchsorted(hashes, own)
            at = np.searchsorted(np.repeat(np.arange(len(many)), many) * FINE + context, np.repeat(word, own_many) * FINE + own_context)
            found = list(_answers(row, price[at], seen[word], own_many, np.frombuffer(row["places"], "<u4").astype(np.int64)))
            yield pa.RecordBatch.from_pydict({"shard": [row["shard"]] * len(found), "block": [b for b, _ in found], "data": pa.array([d for _, d in found], pa.binary())})


def _with_prefixes(tables: DataFrame, bits: int) -> DataFrame:
    """Adds `above`: totals per context of all prefixes of the shard's number, shortest first."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("step")
    node = lambda: F.shiftrightunsigned(F.col("shard"), 0) if bits == 0 else F.floor(F.col("shard") / F.pow(F.lit(2.0), F.lit(bits) - F.col("step"))).cast("long")
    each = tables.select("shard", F.posexplode("totals").alias("context", "n")).select("shard", "context", "n", steps)
    sums = each.groupBy("step", node().alias("node"), "context").agg(F.sum("n").alias("n"))
    path = tables.select("shard", steps).select("shard", "step", node().alias("node")).join(sums, ["step", "node"])
    above = path.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("step", "context", "n"))).alias("found"))
    above = above.select("shard", F.transform("found", lambda x: x["n"]).alias("above"))
    small = (bits + 1) * FINE << bits <= 1_000_000  # numbers in it
    return tables.join(F.broadcast(above) if small else above, "shard")


def _learnt(tables: DataFrame) -> Mixer:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers = learn_bits(row["data"], np.array(row["above"]).reshape(-1, FINE)).numbers()
                yield pa.RecordBatch.from_pydict({"place": np.arange(len(numbers)), "value": numbers})

    return _added_up(tables.select("data", "above").mapInArrow(run, "place long, value double"))


def _added_up(numbers: DataFrame) -> Mixer:
    """The mixer of all shards from place, value of the numbers of each."""
    summed = np.zeros(len(Mixer().numbers()))
    for r in numbers.groupBy("place").agg(F.sum("value").alias("value")).collect():
        summed[r["place"]] = r["value"]
    return Mixer.of(summed)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """The scores; rows whose crc32(doc_id) leaves the remainder 2 by seven are never learnt from."""
    return score(docs, F.coalesce(common.crc_remainder("doc_id", 7) == 2, F.lit(False)))
