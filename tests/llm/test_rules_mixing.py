import collections
import math
import re

import duckdb
import numpy as np
import pytest

from evidencelake.llm import divergence, mixing

from .conftest import prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    places = collections.defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    again = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def distance(p, q):
    p, q = np.array(p, float), np.array(q, float)
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return math.sqrt(max(0.0, part(p) / 2 + part(q) / 2))


def test_base_counts_equal_brute_force(make, odd, none):
    texts = ["a b c a b c a b c", "x\ny\nx\n\n \nx", "# & <b> |*|", prose(1, 200) + " " + prose(1, 200), "é É 1,2 - ok", *(prose(i, 300, 8) for i in range(4))]
    for docs in (make(texts), odd):
        found = sorted((r["doc_id"] or -1, *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in divergence.judge(docs).collect())
        assert found == sorted((r["doc_id"] or -1, *base_counts(r["text"])) for r in docs.collect())
    assert divergence.judge(none).count() == 0


def test_distances_equal_brute_force(make):
    common = "the of and to in a is that for it".split()
    draw = np.random.default_rng(5)
    texts = [" ".join(draw.choice([*common, *(f"word{i}" for i in range(200))], 150, p=[0.04] * 10 + [0.003] * 200)) for _ in range(30)]
    texts += [" ".join(f"W{i}##" for i in draw.integers(0, 10**6, 150)), "short one"]
    found = {r["doc_id"]: r for r in divergence.judge(make(texts)).collect()}
    totals = collections.Counter(w for t in texts for w in t.split())
    many = sum(totals.values())
    top = [(w, n / many) for w, n in sorted(totals.items(), key=lambda x: (-x[1], x[0])) if n >= many * divergence.LEAST_SHARE][: divergence.COMMON_WORDS]

    def classes(text):
        counts = [sum(c.islower() for c in text), sum(c.isupper() for c in text), sum(c.isdigit() for c in text), sum(c.isspace() for c in text), sum(c in ".,;:!?'\"()-" for c in text)]
        return np.array([*counts, len(text) - sum(counts)])

    whole = sum(classes(t) for t in texts)
    for i, text in enumerate(texts):
        own = collections.Counter(text.split())
        n = len(text.split())
        shares = [own[w] / n for w, _ in top]
        assert found[i]["class_distance"] == pytest.approx(distance(classes(text) / len(text), whole / whole.sum()), abs=2e-6)
        assert found[i]["word_distance"] == pytest.approx(distance([*shares, 1 - sum(shares)], [*(q for _, q in top), 1 - sum(q for _, q in top)]), abs=2e-6)
    assert all(found[i]["kept"] for i in range(30)) and not found[30]["kept"] and not found[30]["base_failed"] and found[31]["base_failed"]


def test_mixing_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    wanted = db.execute(mixing.ORACLE).df()
    found = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet")).toPandas()[list(wanted.columns)]
    rows = lambda df: sorted(map(tuple, df.values.tolist()), key=str)
    assert rows(found) == rows(wanted)


def skewed(make):
    sizes = {"big": 400, "mid": 80, "small": 20}
    texts, sources = [], []
    for source, many in sizes.items():
        texts += [prose(sum(map(ord, source)) + 1000 * i, 50) for i in range(many)]
        sources += [source] * many
    return make(texts, sources=sources)


def test_weights_meet_the_repetition_limit(make):
    docs = skewed(make)
    drawn = mixing.mix(docs, repetition=2.0).toPandas()
    assert drawn.doc_id.nunique() == docs.count()
    copies = drawn.groupby("source").size() / drawn.groupby("source").doc_id.nunique()
    assert copies["big"] == 1.0 and 1.9 <= copies["small"] <= 2.0
    assert not drawn.duplicated(["doc_id", "copy"]).any()


def test_weights_meet_a_target_entropy(make):
    rows = mixing.tokens_of(skewed(make))
    planned, _ = mixing.plan(rows, repetition=None, entropy=1.0)
    weights = [r["weight"] for r in planned.collect()]
    assert sum(weights) == pytest.approx(1) and -sum(w * math.log(w) for w in weights) == pytest.approx(1.0, abs=1e-4)


def test_a_budget_is_kept_in_every_slot(make, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 1000)
    drawn = mixing.mix(skewed(make), repetition=4.0, budget=12_000).toPandas()
    spent = drawn.groupby("source").n_tokens.sum()
    planned, _ = mixing.plan(mixing.tokens_of(skewed(make)), repetition=4.0, budget=12_000)
    for r in planned.collect():
        assert 0 <= spent[r["source"][1:]] - r["due"] < 50
        by_slot = drawn[drawn.source == r["source"][1:]].groupby("slot").n_tokens.sum()
        assert (abs(by_slot - r["due"] / 12) <= 100).all()


def test_mixed_rows_and_odd_rows(make, odd, none):
    docs = skewed(make)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(docs).count()
    found = mixing.mixed_rows(odd)
    assert found.columns == odd.columns and {r["doc_id"] for r in found.collect()} == {r["doc_id"] for r in odd.collect()}
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
