import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import common, importance, middle

MIXED = "aZ09 .\n\té日\U0001f600-<P>"


def mixed(seed, size):
    draw = random.Random(seed)
    return "".join(draw.choice(MIXED) for _ in range(size))


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.mark.parametrize("most", [1, 3])
def test_prefix_crcs_equal_those_of_the_strings(most):
    texts = [mixed(s, 5 * s) for s in range(80)] + [None, "", " ", "x" * 5000, "x" * 5000, "é", "日本 x"]
    row, bucket, counts = importance.features(pa.array(texts), most, 10_000)
    wanted = Counter()
    for i, text in enumerate(texts):
        held = words(text)
        assert counts[i] == len(held)
        for n in range(1, most + 1):
            wanted.update((i, zlib.crc32(" ".join(held[j : j + n]).encode()) % 10_000) for j in range(len(held) - n + 1))
    assert Counter(zip(row.tolist(), bucket.tolist(), strict=True)) == wanted


def brute_resample(rows, target, percent=10, least=20, size=10_000):
    bucket = lambda w: zlib.crc32(w.encode()) % size
    s = Counter(bucket(w) for _, t in rows for w in words(t))
    t = Counter(bucket(w) for x in target for w in words(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + size) / ((s[b] + 1) * (t_all + size)))) for b in range(size)}
    out, drawn = [], []
    for i, text in rows:
        held = words(text)
        weight = sum(gain[bucket(w)] for w in held) // len(held) if held else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(held), weight, score))
        if len(held) >= least:
            drawn.append((-score, i is None, i or 0))
    return sorted(out, key=str), sorted(drawn)[: percent * len(drawn) // 100]


def test_resampling_equals_brute_force(make):
    draw = random.Random(5)
    texts = [" ".join(f"w{draw.randrange(60 if i % 3 else 20)}" for _ in range(draw.randrange(5, 60))) for i in range(400)] + [None, "", "é" * 3000]
    ids = [*range(400), None, 401, 402]
    target = [" ".join(f"w{i % 20}" for i in range(300)), None, ""]
    got = importance.resample(make(texts, ids=ids), make(target)).collect()
    rows, drawn = brute_resample(list(zip(ids, texts, strict=True)), target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == rows
    ranked = sorted((r["rank"], -r.score, r.doc_id) for r in got if r["rank"])
    assert [x[1:] for x in ranked] == [(s, i) for s, _, i in drawn] and [x[0] for x in ranked] == list(range(1, len(drawn) + 1))
    favoured = [r for r in got if r["rank"]]
    assert sum(r.doc_id % 3 == 0 for r in favoured) > len(favoured) / 2


def test_repeated_rows_and_one_hot_id_are_ranked_one_by_one(make):
    text = " ".join(f"w{i}" for i in range(30))
    got = importance.resample(make([text] * 500, ids=[None] * 200 + [7] * 300), make(["w1 w2"])).collect()
    assert len(got) == 500
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51))


def test_resampling_of_odd_input(odd, none, make):
    got = importance.resample(odd, make([])).collect()
    assert len(got) == odd.count() and all(r.n_features > 0 or r["rank"] is None for r in got)
    assert importance.resample(none, odd).collect() == []
    more = importance.weigh(odd, make(["word"]), words=2, buckets=64).collect()
    assert len(more) == odd.count() and {r.doc_id: r.n_features for r in more}[3] == 1


def test_exception_index_turns_places_into_each_other():
    texts = [mixed(s, s) for s in range(60)] + [None, "", "plain", "日" * 50, "\U0001f600"]
    data, offsets = common.utf8_buffer(pa.array(texts).slice(0))
    index = middle.ExceptionIndex(data, offsets)
    assert index.lengths().tolist() == [len(t or "") for t in texts]
    assert len(index.at) == sum(ord(c) > 127 for t in texts for c in t or "")  # nothing is kept for ASCII
    for i, text in enumerate(t or "" for t in texts):
        coded = text.encode()
        places = index.cut(np.full(len(text) + 1, i), np.arange(len(text) + 1)) - offsets[i]
        assert places.tolist() == [len(text[:p].encode()) for p in range(len(text) + 1)]
        points = index.points(offsets[i] + np.arange(len(coded) + 1)) - index.starts[i]
        assert points.tolist() == [len(coded[:k].decode(errors="ignore")) for k in range(len(coded) + 1)]


def test_buffer_of_a_slice():
    data, offsets = common.utf8_buffer(pa.array(["ab", None, "é", "xyz"]).slice(1, 2))
    assert bytes(data) == "é".encode() and offsets.tolist() == [0, 0, 2]


def brute_middle(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(text), form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_middle_equals_brute_force_and_goes_back(make):
    texts = [mixed(s, s).replace("<P>", "<" * (s % 2)) for s in range(250)] + ["a<P>b", "<M>", "<S", "<<S>", "M>", "x" * 40]
    df = make(texts)
    rows = middle.transform(df)
    got = {r.doc_id: tuple(r)[1:6] for r in rows.collect()}
    assert got == {i: brute_middle(i, t) for i, t in enumerate(texts)}
    assert {r[1] for r in got.values()} == {"plain", "psm", "spm"}
    back = rows.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == dict(enumerate(texts))


def test_middle_of_odd_input(odd, odd_texts, none):
    got = middle.digests(odd).collect()
    assert len(got) == len(odd_texts)
    assert Counter(r.restored_sha256 for r in got) == Counter(hashlib.sha256((t or "").encode()).hexdigest() for t in odd_texts)
    assert middle.digests(none).collect() == []
