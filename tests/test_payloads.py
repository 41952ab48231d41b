import datetime as dt

import pytest

from evidencelake.sources import payloads


def problems(spark, texts, fields):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, payload string")
    return [r.problem for r in payloads.read(rows, "payload", fields).orderBy("k").collect()]


def test_analysis_answers(spark):
    good = '{"intent": "comparison", "requires_external_data": true, "requires_decomposition": false}'
    texts = [
        good, None, "{", "[1]", "null", good[:-1] + ', "more": 1}', '{"intent": "comparison"}',
        good.replace("true", '"true"'), good.replace("true", "null"), good.replace('"comparison"', "3"), good.replace("comparison", "other"),
        '{"intent": "general", "intent": "general", "requires_external_data": true, "requires_decomposition": false}',
    ]
    assert problems(spark, texts, payloads.ANALYSIS) == [
        None, "malformed", "malformed", "not_an_object", "not_an_object", "unexpected:more", "missing:requires_decomposition,requires_external_data",
        "wrong_type:requires_external_data", "wrong_type:requires_external_data", "wrong_type:intent", "invalid_value:intent", "malformed",
    ]


def test_lists_pairs_and_optional_fields(spark):
    policy = '{{"name": "p", "version": {}, "allowed_relations": {}}}'
    texts = [policy.format(1, '["a", "b"]'), policy.format(1, "[]"), policy.format(1, '["a", 1]'), policy.format(1, '["a", null]'), policy.format("1.5", "[]"), policy.format(1, '"a"')]
    wrong = "wrong_type:allowed_relations"
    assert problems(spark, texts, payloads.RELATION_POLICY) == [None, None, wrong, wrong, "wrong_type:version", wrong]
    entity = ['{"entity_id": "e", "entity_type": "t"}', '{"entity_id": "e", "entity_type": "t", "aliases": null}', '{"entity_id": "e", "entity_type": "t", "aliases": {}}']
    assert problems(spark, entity, payloads.ENTITY) == [None, None, "wrong_type:aliases"]


def test_rules_become_rows(spark):
    rule = '{{"rule_id": "{}", "version": 1, "subject": "s", "action": "a", "decision": "allow", "effective_from": "{}", "priority": 0, {}"source_document_id": "d"}}'
    texts = [
        rule.format("x", "2024-01-31", '"conditions": {"k": "v"}, '), rule.format("twice", "2024-01-01", ""), rule.format("twice", "2024-02-01", ""),
        rule.format("late", "2024-02-30", ""), rule.format("odd", "2024-1-1", ""), rule.format("until", "2024-01-01", '"effective_until": "soon", '),
        rule.format("number", "2024-01-01", '"conditions": {"k": 1}, '), rule.format("open", "2024-01-01", '"effective_until": null, '),
    ]
    rows = payloads.rules(spark.createDataFrame(list(enumerate(texts)), "k int, payload string"), "payload").orderBy("k").collect()
    assert [r.problem for r in rows] == [
        None, "repeated_rule_version", "repeated_rule_version", "invalid_value:effective_from", "invalid_value:effective_from",
        "invalid_value:effective_until", "wrong_type:conditions", None,
    ]
    assert (rows[0].conditions, rows[0].effective_from, rows[7].conditions) == ({"k": "v"}, dt.date(2024, 1, 31), {})
    assert rows[3].rule_id is None and rows[7].effective_until is None


def test_a_dataset_of_two_corpora(spark):
    chunk = '{{"chunk_id": "{}", "document_id": "{}", "text": "t"}}'
    chunks = [("comparison", chunk.format("a", "d1")), ("2024-01-01", chunk.format("b", "d2")), ("2024-01-01", chunk.format("c", "d3")),
              ("2024-02-01", chunk.format("c", "d4")), ("later", chunk.format("e", "d5")), (None, chunk.format("f", "d6"))]
    case = '{{"id": "{}", "query": "q", "status": "ready", "document_ids": [{}]}}'
    cases = [(case.format("1", '"d1", "d2"'),), (case.format("2", '"d4"'),), (case.format("3", ""),), (case.format("4", '"d1"'),), (case.format("4", '"d1"'),)]
    held, asked = payloads.execution_dataset(spark.createDataFrame(chunks, "corpus string, payload string"), spark.createDataFrame(cases, "payload string"))
    assert {(r.payload, r.corpus): r.problem for r in held.collect()} == {
        chunks[0][::-1]: None, chunks[1][::-1]: None, chunks[2][::-1]: "repeated_chunk_id", chunks[3][::-1]: "repeated_chunk_id",
        chunks[4][::-1]: "unknown_corpus", chunks[5][::-1]: "unknown_corpus",
    }
    assert sorted((r.payload, r.problem or "") for r in asked.collect()) == sorted(
        [(cases[0][0], ""), (cases[1][0], "unknown_document"), (cases[2][0], ""), (cases[3][0], "repeated_case_id"), (cases[4][0], "repeated_case_id")]
    )


def test_an_unknown_kind_of_field_is_refused():
    with pytest.raises(ValueError):
        payloads.Field("float")
