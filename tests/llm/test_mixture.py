import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import common, mixture


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), " "]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def english(draw, n):
    return " ".join(draw.choice(["the", "of", "and", "the", *(f"en{k}" for k in range(60))]) for _ in range(n))


def french(draw, n):
    return " ".join(draw.choice(["le", "de", "la", "de", *(f"fr{k}" for k in range(60))]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(1)
    texts = [(english if i % 2 else french)(draw, draw.randrange(5, 120)) for i in range(300)]
    return [*texts, None, "", "ODD words Ünique" + str(draw.random()), "x" * 70_000, texts[0]]


def check_base(rows, ids, texts):
    """Everything but the model's own score, against plain counting."""
    counts = Counter(w for i, t in zip(ids, texts, strict=True) if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    wanted = []
    for i, text in zip(ids, texts, strict=True):
        own = tokens(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        wanted.append((str(i), held(i), len(own), sum(w in counts for w in own), n, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(wanted)


def test_counts_and_base_equal_brute_force(make, corpus):
    rows = mixture.held_out_scores(make(corpus)).collect()
    check_base(rows, range(len(corpus)), corpus)
    by_id = {r.doc_id: r for r in rows}
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert by_id[0].score == by_id[304].score or held(0) != held(304)
    out = [r for r in rows if r.held_out and r.doc_id < 300]
    # the short words tell the language, so held-out texts are likelier than by their words' shares alone
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_blocks_shards_and_two_steps_change_no_count(make, corpus, monkeypatch):
    whole = {r.doc_id: r for r in mixture.held_out_scores(make(corpus)).collect()}
    monkeypatch.setattr(mixture, "SHARD_PAIRS", 300)
    monkeypatch.setattr(mixture, "FAN_IN", 1)
    many = mixture.held_out_scores(make(corpus).repartition(4)).collect()
    check_base(many, range(len(corpus)), corpus)
    for r in many:
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=0.15)


def test_chances_of_all_known_words_add_up(corpus):
    """Over the shards of a table the known words of each context share what its flag leaves them."""
    draw = random.Random(2)
    hashes = np.sort(np.array([draw.getrandbits(64) for _ in range(400)], dtype=np.uint64))
    times = np.array([[draw.choice([0, 0, 0, 1, 2, 9]) for _ in range(mixture.FINE)] for _ in hashes])
    seen = times.sum(axis=1)
    assert (seen > 0).all()
    totals, once = times.sum(axis=0), times[seen == 1].sum(axis=0)
    flags = mixture.flag_prices(totals, once)
    assert np.allclose((10**flags).sum(axis=0), 1)
    bits, total, learnt = 2, np.zeros(mixture.FINE), []
    shard = (hashes >> np.uint64(62)).astype(int)
    for s in range(4):
        mine = times[shard == s]
        above = np.array([totals, times[shard // 2 == s // 2].sum(axis=0), mine.sum(axis=0)])
        data = mixture.pack(hashes[shard == s], np.full(len(mine), mixture.FINE), np.tile(np.arange(mixture.FINE), len(mine)), mine.ravel())
        learnt.append((data, above))
    mixer = mixture.Mixer.of(sum(mixture.learn_bits(d, a).numbers() for d, a in learnt))
    for data, above in learnt:
        price, _ = mixture.prices(data, above, mixer, flags)
        total += (10 ** price.reshape(-1, mixture.FINE)).sum(axis=0)
    assert bits == 2 and np.allclose(total, 10 ** flags[0])


def test_a_bit_and_its_opposite_add_up():
    draw = np.random.default_rng(3)
    yes, no = draw.integers(0, 50, (1000, 3)).astype(float), draw.integers(0, 50, (1000, 3)).astype(float)
    mixer = mixture.Mixer()
    x, gate = mixture.Mixer.inputs(yes, no), mixture.Mixer.gate(yes, no)
    assert np.array_equal(gate, mixture.Mixer.gate(no, yes))
    before = (draw.random(1000) * 9).round()
    first = (10 ** mixer.log_chance(x, gate) + 10 ** mixer.log_chance(mixture.Mixer.inputs(no, yes), gate))
    mixer.learn(x, gate, before)
    second = (10 ** mixer.log_chance(x, gate) + 10 ** mixer.log_chance(mixture.Mixer.inputs(no, yes), gate))
    assert np.allclose(first, 1) and np.allclose(second, 1)


def test_bytes_after_a_beginning_add_up():
    words = [b"then", b"than", b"this", "tä".encode(), b""]
    _, context, stream = mixture.byte_events(words)
    counts = np.bincount(mixture.byte_slots(context, stream), minlength=sum(mixture.BYTE_CONTEXTS) * 256)
    speller = mixture.Speller(counts)
    speller.learn(words)
    # all beginnings of two bytes, by the chances of their words without what ends them
    one = speller.log_chance([bytes([b]) for b in range(256) if b != 32])
    ends = speller.log_chance([b""])
    first = {b: 0.0 for b in range(256) if b != 32}
    for word, yes, no in speller._bits([bytes([b]) for b in first], 0):
        chance = speller.mixer.log_chance(mixture.Mixer.inputs(yes, no), mixture.Mixer.gate(yes, no))
        begin = np.flatnonzero(np.diff(word, prepend=-1))  # the first byte of each word
        for b, c in zip(first, chance[begin], strict=True):
            first[b] += c
    assert sum(10**c for c in first.values()) + 10 ** ends[0] == pytest.approx(1)
    assert all(whole < first[b] for whole, b in zip(one, first, strict=True))


def test_all_rare_words_fit_the_weights_of_spelling(make, monkeypatch):
    """A task of more than 500 rare words, and shards of fewer words than there are: none is left out, none comes twice."""
    common.prepare((docs := make([" ".join(f"rare{i}" for i in range(1_200)), "rare1 again again"]).coalesce(1)).sparkSession)
    blocks = mixture.in_blocks(docs, F.lit(False)).cache()
    wanted = sorted([*(f"rare{i}" for i in range(1_200) if i != 1)])
    assert sorted(bytes(r["data"]).decode() for r in blocks.filter("kind = 4").collect()) == wanted
    bits = 8 * sum(len(w) + 1 for w in wanted)
    monkeypatch.setattr(mixture, "SPELL_WORDS", 100)
    for spread in (blocks, blocks.unionByName(blocks.filter("kind = 4"))):
        assert mixture.speller(spread)().mixer.seen.sum() == pytest.approx(bits)
    monkeypatch.undo()
    alone = mixture.speller(blocks)().mixer
    assert alone.seen.sum() == pytest.approx(bits)


def test_context_is_the_leading_short_word():
    texts = ["a long b word b a a end", "", "none of"]
    offsets, codes, words = common.split_words(pa.array(texts))
    listed = words.to_pylist()
    spread = np.arange(10, 10 + len(listed), dtype=np.uint64)
    got = mixture.contexts(codes, offsets, np.array([len(w) <= 3 for w in listed]), spread).tolist()
    value = {w: 1 + (10 + i) % 63 for i, w in enumerate(listed)}
    wanted, ends = [], []
    for text in texts:
        counts, leader = Counter(), None
        for w in [*text.split(), None]:
            (ends if w is None else wanted).append(0 if leader is None else value[leader])
            if w is not None and len(w) <= 3:
                counts[w] += 1
                if leader is None or counts[w] > best:
                    leader, best = w, counts[w]
    assert got == wanted + ends


def test_word_before_is_a_context():
    texts = ["b a b c", "", "a", " c b"]
    offsets, codes, words = common.split_words(pa.array(texts))
    listed = words.to_pylist()
    spread = np.arange(3, 3 + len(listed), dtype=np.uint64) << np.uint64(32)
    got = mixture.words_before(codes, offsets, spread).tolist()
    value = {w: 1 + (3 + i) % 15 for i, w in enumerate(listed)}
    wanted = [0 if i == 0 else value[t.split()[i - 1]] for t in texts for i in range(len(t.split()))]
    assert got == wanted + [value[t.split()[-1]] if t else 0 for t in texts]
    assert mixture.words_before(np.empty(0, np.int64), np.zeros(3, np.int64), spread).tolist() == [0, 0]
    # long words are no leaders: what precedes them alone tells the pairs of the last word apart
    block = mixture.Block(pa.array(["longer after", "others after"]), np.array([False, False]))
    assert len({(p // mixture.FINE, p % mixture.FINE) for p in block.pairs.tolist()}) == 5


def test_a_word_may_stand_in_all_contexts():
    many, context = np.array([mixture.FINE, 1]), np.append(np.arange(mixture.FINE), 0)
    hashes, times = np.array([1, 2], dtype=np.uint64), np.arange(mixture.FINE + 1)
    assert [x.tolist() for x in mixture.unpack(mixture.pack(hashes, many, context, times))] == [hashes.tolist(), many.tolist(), context.tolist(), times.tolist()]


def test_shared_bits():
    draw = random.Random(4)
    hashes = sorted({draw.getrandbits(64) >> draw.choice([0, 0, 30, 60]) for _ in range(500)} | {2**64 - 1, 2**64 - 2, 0, 1})
    got = mixture.shared_bits(np.array(hashes, dtype=np.uint64)).tolist()
    assert got == [64 - (a ^ b).bit_length() for a, b in zip(hashes, hashes[1:])]


def test_odd_input(odd, odd_texts, none, make):
    ids = [r.doc_id for r in odd.select("doc_id").collect()]
    rows = mixture.held_out_scores(odd).collect()
    check_base(rows, ids, [r.text for r in odd.select("text").collect()])
    assert mixture.held_out_scores(none).collect() == []
    alone = mixture.score(make(["one text", None]), F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens) for r in alone] == [(0, 0), (0, 0)] and all(r.base_score == 0 and r.score < 0 for r in alone)
