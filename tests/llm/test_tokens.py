import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidencelake.llm import encode, packing, varbyte

from .conftest import prose


@pytest.mark.parametrize("name", [encode.WORD_FILE, encode.BYTE_FILE])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBéßñİ'’ .,!\n\t\x1c\x1e ́日1“<|s>", max_size=40), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(name, texts):
    own = encode.encoder(encode.tokenizer_file(name))
    bounds, ids = own.encode(pa.array([*texts, None], pa.string()))
    whole = Tokenizer.from_file(encode.tokenizer_file(name))
    for i, text in enumerate([*texts, ""]):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [encode.WORD_FILE, encode.BYTE_FILE])
def test_added_tokens_in_a_text_are_those_of_the_untouched_tokenizer(name):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|startoftext|> y<|endoftext|>", "<|ENDOFTEXT|> z", "<|endoftext", "plain text", "<|endoftext|> é日"]
    bounds, ids = encode.encoder(encode.tokenizer_file(name)).encode(pa.array(texts))
    whole = Tokenizer.from_file(encode.tokenizer_file(name))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(ids[bounds[1] : bounds[2]]) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_control_and_data_bytes_round_trip(ranks):
    control, data = varbyte.pack(np.array(ranks, dtype=np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert varbyte.unpack(control, data, len(ranks)).tolist() == ranks


def expected_ids(name, text, end):
    own = Tokenizer.from_file(encode.tokenizer_file(name))
    return np.array(own.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_files_hold_all_documents_in_order(spark, odd, odd_texts, none, tmp_path):
    found = varbyte.export(odd, f"file://{tmp_path}/a", file_tokens=500).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    sizes = {}
    for i, text in texts:
        sizes.setdefault(i, []).append(expected_ids(encode.WORD_FILE, text, 1))
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(x), zlib.crc32(x.tobytes())) for x in sizes[r["doc_id"]]]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0)) and len(order) == len(texts)
    assert varbyte.export(none, f"file://{tmp_path}/b").count() == 0


def test_frequent_ids_have_low_ranks(spark, make, tmp_path):
    tokens = varbyte.tokenize(make(["the the the cat", "the dog"]), encode.tokenizer_file(encode.WORD_FILE), 1)
    ranked = varbyte.ranks(tokens)
    assert ranked[0] == expected_ids(encode.WORD_FILE, "the", 1)[0] and ranked[1] == 1 and len(ranked) == 4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_configurations_hold_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, dtype=np.int64), minlength=65)
    held = np.zeros(65, dtype=int)
    for sizes, times, repeat in packing.plan(counts, 64):
        assert (sizes * times).sum() <= 64
        held[sizes] += times * repeat
    assert held.tolist() == counts.tolist()


def test_few_sequences_are_used():
    counts = np.bincount(np.random.default_rng(1).integers(1, 1025, 20_000), minlength=1025)
    used = sum(repeat for *_, repeat in packing.plan(counts))
    assert used <= 1.01 * (counts * np.arange(1025)).sum() / 1024


def test_the_program_covers_its_demand():
    counts = np.zeros(101, dtype=np.int64)
    counts[[30, 40, 70]] = [400, 100, 200]
    covered = np.zeros(101)
    for lengths, times, amount in packing.fractional(counts, 100):
        covered[lengths] += times * amount
    assert (covered >= 0.98 * counts).all()
    assert sum(r for *_, r in packing.plan(counts, 100)) <= 307


def test_pieces_are_placed_without_gaps(odd, none):
    found = packing.pack(odd).toPandas()
    for _, rows in found.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist() and rows.length.sum() <= 1024
    for r in odd.filter("doc_id in (0, 3, 5, 7)").collect():
        ids = expected_ids(encode.BYTE_FILE, r["text"], 2)
        own = found[found.doc_id == r["doc_id"]].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[1:] == 1024).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert len(found[found.doc_id.isna()]) == 2
    assert packing.pack(none).count() == 0
    assert prose(1, 2)
