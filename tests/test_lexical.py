import math
import random

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import text
from evidencelake.operators import confidence, lexical

WORDS = ["regra", "prazo", "dias", "código", "px-101", "norma", "glosa", "API", "versão", "item"]


def corpus():
    rng = random.Random(7)
    rows = [(i, f"d{i % 3}", " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(40)]
    return rows + [(90, "d1", ""), (91, "d2", "?!")]


QUERIES = [(1, "prazo da regra px-101"), (2, "API API glosa"), (3, "nada aqui"), (4, "versao"), (5, "")]


def tokenize(value):
    import re

    return re.findall(text.RETRIEVAL_TOKEN, "".join(map(text.folded_character, value)))


def brute(rows, query, k, k1=1.5, b=0.75):
    bags = {i: tokenize(t) for i, _, t in rows}
    average = sum(map(len, bags.values())) / len(bags)
    scored = []
    for i, bag in bags.items():
        total = 0.0
        for term in set(tokenize(query)):
            tf = bag.count(term)
            if tf:
                df = sum(term in other for other in bags.values())
                idf = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
                total += idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(bag) / average))
        if total > 0:
            scored.append((-round(total, 9), i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_search_equals_brute_force(spark, limit):
    rows = corpus()
    chunks = spark.createDataFrame(rows, "chunk_id bigint, document_id string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, query_text string")
    pairs = lexical.score(chunks, queries, max_query_terms=limit).pairs
    got = {}
    for r in lexical.top_k(pairs, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for query_id, question in QUERIES:
        want = brute(rows, question, 5)
        assert [i for i, _ in got.get(query_id, [])] == [i for i, _ in want]
        for (_, a), (_, b) in zip(got.get(query_id, []), want):
            assert a == pytest.approx(b, abs=1e-8)


def test_scopes_have_their_own_statistics(spark):
    rows = corpus()
    left, right = rows[:20], rows[20:]
    scoped = [("a", *r) for r in left] + [("b", *r) for r in right] + [("unused", *r) for r in rows]
    chunks = spark.createDataFrame(scoped, "corpus string, chunk_id bigint, document_id string, text string")
    asked = [("a", 1, QUERIES[0][1]), ("b", 2, QUERIES[0][1])]
    queries = spark.createDataFrame(asked, "corpus string, query_id bigint, query_text string")
    found = lexical.search(chunks, queries, k=4, scope_col="corpus").orderBy("query_id", "rank").collect()
    for query_id, part in ((1, left), (2, right)):
        want = [i for i, _ in brute(part, QUERIES[0][1], 4)]
        assert [r.chunk_id for r in found if r.query_id == query_id] == want


@pytest.mark.parametrize("common_df", [0, 3, 12])
def test_many_queries_share_their_common_terms(spark, common_df):
    rows = corpus()
    chunks = spark.createDataFrame(rows, "chunk_id bigint, document_id string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, query_text string")
    for k in (1, 3):
        found = lexical.search(chunks, queries, k=k, max_query_terms=1, common_df=common_df)
        whole = lexical.search(chunks, queries, k=k).select(*found.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_a_common_term_is_not_joined_once_a_query(spark):
    rows = [(i, "shared " + ("tail " * (i % 4)) + f"own-{i}") for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string")
    queries = spark.createDataFrame([(i, f"shared own-{i}") for i in range(300)], "query_id bigint, query_text string")
    weighed = lexical._weigh(chunks, queries, lexical.Bm25(), None, None, "text", 1)
    pairs = lexical._contenders(weighed, lexical.Bm25(), 2, 50)
    assert pairs.count() <= 300 * 3  # all pairs are 90,000
    best = {r.query_id: r.chunk_id for r in lexical.top_k(pairs, 1).collect()}
    assert best == {i: i for i in range(300)}


def test_lengths_of_all_chunks_are_no_term_of_one_task(spark):
    chunks = spark.createDataFrame([(i, "a b" if i % 2 else "c d e") for i in range(40)] + [(99, "")], "chunk_id bigint, text string")
    queries = spark.createDataFrame([(1, "a c"), (2, "e x")], "query_id bigint, query_text string")
    few, many = (lexical._weigh(chunks, queries, lexical.Bm25(), None, None, "text", most) for most in (100, 1))
    assert few.small and not many.small
    assert many.counts.where(F.col("term").startswith("\0")).count() == 0
    facts = lambda weighed: sorted((r.term, r.df, round(r.average, 9), round(r.idf, 9), r.rare) for r in weighed.frequency.collect())
    assert facts(many) == facts(few) and len(facts(many)) == 3


def test_pairs_are_scored_where_their_chunk_is(spark):
    chunks = spark.createDataFrame(corpus(), "chunk_id bigint, document_id string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, query_text string")
    pairs = lexical.score(chunks, queries).pairs
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("chunk_id" in line for line in dealt)
    assert not any("query_id" in line and "chunk_id" in line for line in dealt)
    assert not any("term" in line and "chunk_id" in line for line in dealt)


def test_min_score_and_arguments(spark):
    chunks = spark.createDataFrame(corpus(), "chunk_id bigint, document_id string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, query_text string")
    everything = lexical.search(chunks, queries, k=50).collect()
    high = lexical.search(chunks, queries, k=50, min_score=2.0).collect()
    assert {(r.query_id, r.chunk_id) for r in high} == {(r.query_id, r.chunk_id) for r in everything if r.score >= 2.0}
    with pytest.raises(ValueError):
        lexical.search(chunks, queries, k=0)
    with pytest.raises(ValueError):
        lexical.Bm25(k1=0)


def test_signals_and_gate(spark):
    rows = corpus()
    chunks = spark.createDataFrame(rows, "chunk_id bigint, document_id string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, query_text string")
    scored = lexical.score(chunks, queries)
    ranked = confidence.attach(
        lexical.top_k(scored.pairs, 3), chunks, proven_small=True, columns=["document_id"]
    )
    signals = {r.query_id: r for r in confidence.signals(ranked, scored.query_facts).collect()}
    assert set(signals) == {1, 2, 3, 4, 5}
    assert signals[3].result_count == 0 and signals[3].top_score == 0.0
    best = brute(rows, QUERIES[0][1], 3)
    top_text = next(t for i, _, t in rows if i == best[0][0])
    asked = set(tokenize(QUERIES[0][1]))
    assert signals[1].query_coverage == pytest.approx(len(asked & set(tokenize(top_text))) / len(asked), abs=1e-6)
    assert signals[1].normalized_margin == pytest.approx((best[0][1] - best[1][1]) / best[0][1], abs=1e-6)
    decisions = confidence.gate(confidence.signals(ranked, scored.query_facts), best[0][1] - 1e-6)
    states = {r.query_id: r.status for r in decisions.collect()}
    assert states[1] == "ready" and states[3] == "insufficient_evidence"
    released = {r.query_id for r in confidence.gated_evidence(ranked, decisions).collect()}
    assert released == {q for q, s in states.items() if s == "ready"}


def test_policy_payload_is_checked():
    payload = {
        "schema_version": 1, "status": "frozen",
        "policy": {"signal": "top_score", "operator": "greater_than_or_equal", "threshold": 3},
    }
    assert confidence.policy_threshold(payload) == 3.0
    for broken in ({"status": "candidate"}, {"schema_version": 2}, {"policy": {**payload["policy"], "threshold": True}}):
        with pytest.raises(ValueError):
            confidence.policy_threshold({**payload, **broken})


def test_term_statistics(spark):
    rows = corpus()
    chunks = spark.createDataFrame(rows, "chunk_id bigint, document_id string, text string")
    got = {r.term: (r.occurrences, r.chunk_frequency) for r in lexical.term_statistics(chunks).collect()}
    bags = [tokenize(t) for _, _, t in rows]
    assert got == {
        w: (sum(b.count(w) for b in bags), sum(w in b for b in bags)) for w in {w for b in bags for w in b}
    }
