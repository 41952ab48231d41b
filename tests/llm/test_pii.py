import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from evidencelake.llm import pii


def brute(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
        if 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0:
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return spans


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()é%", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_cards_and_bounds():
    text = "pay 4539 1488 0343 6467 or 4539148803436468; 10.0.0.256 10.0.0.255 é a@b.c@d.e +1 (555) 010-9999"
    assert pii.base_spans(text) == brute(text)
    assert {k for k, *_ in pii.base_spans(text)} == set(pii.KINDS)


def test_contexts_reveal_identifiers(make):
    texts = [f"some words {i} then my contact is user{i}@mail.example.org and more words follow" for i in range(12)]
    texts += [f"again my contact is AB-{1000 + i}-XY and nothing else" for i in range(3)]
    texts += ["the year 20231231 was long and 20240101 came", None, ""]
    found = {r["doc_id"]: r for r in pii.find(make(texts)).collect()}
    for i in range(12, 15):
        kind, start, end = found[i]["spans"].split(":")
        assert kind == pii.CONTEXT and texts[i][int(start) : int(end)] == f"AB-{1000 + i - 12}-XY" and found[i]["n_context"] == 1
    assert all(found[i]["n_context"] == 0 for i in (*range(12), 15, 16, 17)) and found[16]["spans"] == ""
    clean = pii.redact(make(texts))
    assert clean.columns == make([]).columns
    rows = {r["doc_id"]: r for r in clean.collect()}
    assert rows[0]["text"] == "some words 0 then my contact is <EMAIL> and more words follow" and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[12]["text"] == "again my contact is <CONTEXT> and nothing else" and rows[16]["text"] is None and rows[15]["text"] == texts[15]


def brute_score(edges):
    """Plain rounds over {(pattern, instance): (seed, n)}."""
    trust = {}
    for (_, i), (seed, _) in edges.items():
        trust[i] = max(trust.get(i, 0.0), float(seed))
    before = -1
    while True:
        patterns = {}
        for p in {p for p, _ in edges}:
            rows = [(trust[i], n) for (q, i), (_, n) in edges.items() if q == p]
            if sum(t >= pii.CONFIDENT for t, _ in rows) >= pii.SUPPORT:
                patterns[p] = sum(t * n for t, n in rows) / (sum(n for _, n in rows) + 1)
        grown = {}
        for i, old in trust.items():
            left = math.prod(1 - min(patterns[p], 0.999) for p, j in edges if j == i and p in patterns)
            grown[i] = max(old, 1 - left) if 1 - left >= pii.CONFIDENT else old
        trust = grown
        now = sum(t >= pii.CONFIDENT for t in trust.values())
        if now == before:
            return {p for p, c in patterns.items() if c >= pii.CONFIDENT}, {i for i, t in trust.items() if t >= pii.CONFIDENT}
        before = now


def test_scoring_equals_plain_rounds(spark):
    draw = random.Random(7)
    edges = {(draw.randrange(30), draw.randrange(120)): None for _ in range(500)}
    seeds = set(draw.sample(range(120), 35))
    edges = {(p, i): (i in seeds and draw.random() < 0.9, draw.randrange(1, 4)) for p, i in edges}
    rows = spark.createDataFrame([(p, i, s, n) for (p, i), (s, n) in edges.items()], "pattern bigint, instance bigint, seed boolean, n bigint")
    patterns, instances = pii.score(rows)
    got = {r.pattern for r in patterns.collect()}, {r.instance for r in instances.collect()}
    assert got == brute_score(edges) and got[0] and len(got[1]) > len({i for (_, i), (s, _) in edges.items() if s})


def test_what_a_context_revealed_opens_another_one(make):
    """Second generation: badges beside e-mails are trusted, so the other place they stand in reveals further ones."""
    texts = [f"some words {i} then my contact is user{i}@mail.example.org and more" for i in range(12)]
    texts += [f"again my contact is AB-{1000 + i}-XY and nothing else" for i in range(4)]
    texts += [f"at the gate badge number AB-{1000 + i}-XY was read" for i in range(4) for _ in range(2)]
    texts += ["at the gate badge number CD-7777-ZZ was read"]
    texts += [f"the total sum of {100000 + i} grew" for i in range(40)]
    found = {r["doc_id"]: r for r in pii.find(make(texts)).collect()}
    shown = {i: [texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for x in r["spans"].split(",") if x.startswith(pii.CONTEXT)] for i, r in found.items()}
    assert shown[24] == ["CD-7777-ZZ"] and shown[16] == ["AB-1000-XY"]
    assert all(not shown[i] for i in [*range(12), *range(25, 65)])
    assert found[24]["n_spans"] == 1 and found[0]["n_spans"] == 1 and found[30]["n_spans"] == 0


def test_keys_are_reported_in_trusted_contexts_only(make):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f'set token = "{key(i)}" here' for i in range(6)] + [f"word{i} commit {key(100)} landed" for i in range(6)] + ["0" * 40 + " digits", "deadbeef" * 5]
    found = {r["doc_id"]: r["n_context"] for r in pii.find(make(texts)).collect()}
    assert [found[i] for i in range(6)] == [1] * 6 and all(found[i] == 0 for i in range(6, 14))


def test_odd_rows(odd, odd_texts, none):
    found = pii.find(odd).collect()
    assert len(found) == len(odd_texts) and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in found)
    assert pii.redact(odd).count() == len(odd_texts)
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0
