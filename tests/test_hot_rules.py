"""One scope, one key, one hub: joins of rules that a plain pair of loops cannot take."""

import datetime as dt
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import sizing
from evidencelake.operators import catalog, rules

FIELDS = "rule_id string, version int, subject string, action string, decision string, priority int, conditions map<string,string>, effective_from date, effective_until date"


def table(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def brute_overlaps(rows):
    found = set()
    for a, b in itertools.combinations(rows, 2):
        if a[2:4] + a[5:6] != b[2:4] + b[5:6]:
            continue
        end = lambda r: r[8] or dt.date.max
        if max(a[7], b[7]) > min(end(a), end(b)) or any(a[6][k] != b[6][k] for k in a[6].keys() & b[6].keys()):
            continue
        names = sorted((f"{a[0]}@{a[1]}", f"{b[0]}@{b[1]}"))
        found.add(("redundant_overlap" if a[4] == b[4] else "conflicting_overlap", *names))
    return found


@pytest.mark.parametrize("part_rows", [sizing.PART_ROWS, 3])
def test_overlaps_equal_all_pairs(spark, part_rows):
    draw = random.Random(8)
    rows = []
    for i in range(160):
        start = dt.date(2024, 1, 1) + dt.timedelta(days=draw.randrange(200))
        conditions = {k: draw.choice("xyz") for k in "abc" if draw.random() < 0.5}
        until = None if draw.random() < 0.2 else start + dt.timedelta(days=draw.randrange(120))
        rows.append((f"r{i}", 1, draw.choice(["s", "hot", "hot"]), "act", draw.choice(["allow", "deny"]), draw.randrange(2), conditions, start, until))
    got = rules.overlaps(table(spark, rows), part_rows=part_rows).collect()
    assert len(got) == len(set(got))
    assert {(r.code, r.first_version, r.second_version) for r in got} == brute_overlaps(rows)


@pytest.mark.parametrize("few_rules", [1, 3, 100])
def test_small_scopes_paired_rule_by_rule_equal_all_pairs(spark, few_rules):
    draw = random.Random(9)
    rows = []
    for i in range(200):
        start = dt.date(2024, 1, 1) + dt.timedelta(days=draw.randrange(300))
        conditions = {k: draw.choice("xy") for k in "ab" if draw.random() < 0.5}
        until = None if draw.random() < 0.3 else start + dt.timedelta(days=draw.randrange(200))
        rows.append((f"r{i}", 1, f"s{draw.randrange(60)}", "act", draw.choice(["allow", "deny"]), 0, conditions, start, until))
    got = rules.overlaps(table(spark, rows), few_rules=few_rules).collect()
    assert len(got) == len(set(got))
    assert {(r.code, r.first_version, r.second_version) for r in got} == brute_overlaps(rows)


def test_small_scopes_are_not_repeated_for_every_month(spark):
    """Two rules a scope, valid for ten thousand years: 240,000 rows a scope if they were cut into months and slots."""
    days = [F.expr("date '0001-01-01'"), F.expr("date '9999-12-01'")]
    pairs = spark.range(5_000).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).select(
        F.concat(F.lit("r"), "id", F.lit("-"), "v").alias("rule_id"), F.lit(1).alias("version"), F.concat(F.lit("s"), "id").alias("subject"),
        F.lit("a").alias("action"), F.lit("allow").alias("decision"), F.lit(0).alias("priority"), F.expr("cast(map() as map<string,string>)").alias("conditions"),
        F.when(F.col("v") == 0, days[0]).otherwise(days[1]).alias("effective_from"), F.lit(None).cast("date").alias("effective_until"),
    )
    began = time.monotonic()
    assert rules.overlaps(pairs).count() == 5_000
    assert time.monotonic() - began < 60


def test_a_scope_of_a_hundred_thousand_rules(spark):
    """All valid at once; the condition that tells them apart is the index, so no pair is formed for nothing."""
    many = spark.range(100_000).select(
        F.concat(F.lit("r"), "id").alias("rule_id"), F.lit(1).alias("version"), F.lit("s").alias("subject"), F.lit("a").alias("action"), F.lit("allow").alias("decision"),
        F.lit(0).alias("priority"), F.create_map(F.lit("client"), (F.col("id") / 2).cast("int").cast("string")).alias("conditions"),
        F.lit(dt.date(2024, 1, 1)).alias("effective_from"), F.lit(dt.date(2024, 3, 1)).alias("effective_until"),
    )
    plain = table(spark, [("any", 1, "s", "a", "deny", 0, {"tier": "x"}, dt.date(2024, 2, 1), None)])
    counts = {r.code: r["count"] for r in rules.overlaps(many.unionByName(plain)).groupBy("code").count().collect()}
    assert counts == {"redundant_overlap": 50_000, "conflicting_overlap": 100_000}


@pytest.mark.parametrize("part_rows", [sizing.PART_ROWS, 10])
def test_one_hot_subject_is_resolved_like_any_other(spark, part_rows):
    given = table(spark, [("low", 1, "s", "a", "deny", 0, {}, dt.date(2024, 1, 1), None), ("high", 1, "s", "a", "allow", 1, {"k": "7"}, dt.date(2024, 1, 1), None)])
    asked = spark.range(500).select(
        F.when(F.col("id") < 490, "s").otherwise("other").alias("subject"), F.lit("a").alias("action"), F.lit(dt.date(2024, 5, 1)).alias("reference_date"),
        F.col("id").alias("n"), F.create_map(F.lit("k"), (F.col("id") % 10).cast("string")).alias("attributes"),
    )
    got = rules.resolve(given, asked, ["subject", "action", "reference_date", "n"], part_rows=part_rows).collect()
    assert len(got) == 500
    assert {(r.decision, r.status) for r in got if r.subject == "s" and r.n % 10 == 7} == {("allow", "applied")}
    assert {(r.decision, r.status) for r in got if r.subject == "s" and r.n % 10 != 7} == {("deny", "applied")}
    assert {r.status for r in got if r.subject == "other"} == {"no_match"}


def resolved(spark, rows, queries, **how):
    key = ["subject", "action", "reference_date", "a"]
    asked = spark.createDataFrame(queries, "subject string, action string, reference_date date, a string")
    attributes = F.when(F.col("a").isNotNull(), F.create_map(F.lit("a"), F.col("a"))).otherwise(F.create_map().cast("map<string,string>"))
    got = rules.resolve(table(spark, rows), asked, key, attributes=attributes, **how).collect()
    each = rules.resolve(table(spark, rows), asked.distinct().withColumn("attributes", attributes), key, **how).collect()
    assert sorted(map(str, got)) == sorted(map(str, each))
    assert len(got) == len(set(queries))
    return {tuple(r[:4]): (r.status, r.decision, r.matched_rule_versions) for r in got}


def brute_resolution(rows, query):
    hits = [r for r in rows if r[2:4] == query[:2] and query[2] and r[7] <= query[2] <= (r[8] or dt.date.max) and all({"a": query[3]}.get(k) == v for k, v in r[6].items())]
    top = sorted(r for r in hits if r[5] == max(h[5] for h in hits))
    decisions = {r[4] for r in top}
    return ("applied" if len(decisions) == 1 else "review") if top else "no_match", decisions.pop() if len(decisions) == 1 else None, [f"{r[0]}@{r[1]}" for r in top]


@pytest.mark.parametrize("how", [{}, {"small_rules": 0}, {"small_rules": 0, "part_rows": 3}, {"few_rules": 12}, {"few_rules": 12, "small_rules": 0, "part_rows": 5}, {"few_rules": 0}])
def test_all_ways_of_resolution_equal_brute_force(spark, how):
    """Repeated and null questions, a hot subject, sets of few and of many rules, rules that come twice."""
    draw, day = random.Random(10), dt.date(2024, 1, 1)
    rows = []
    for i in range(70):
        start = day + dt.timedelta(days=draw.randrange(200))
        until = None if draw.random() < 0.3 else start + dt.timedelta(days=draw.randrange(120))
        rows.append((f"r{i:02}", i % 3, draw.choice(["s", "t", "hot", "hot", "hot"]), draw.choice("ab"), draw.choice(["allow", "deny"]), draw.randrange(2), {"a": draw.choice("xy")} if draw.random() < 0.5 else {}, start, until))
    rows += rows[:9]
    queries = [(draw.choice(["hot", "hot", "s", "t", "none", None]), draw.choice(["a", "b", None]), draw.choice([None, *[day + dt.timedelta(days=draw.randrange(300))] * 9]), draw.choice(["x", "y", None])) for _ in range(300)]
    got = resolved(spark, rows, queries + queries[:50], **how)
    assert got == {q: brute_resolution(rows, q) for q in queries}


def test_rules_are_not_repeated_for_every_month_of_the_questions(spark):
    """Two rules a subject, valid for ten thousand years: 240,000 rows a subject if they were cut into months."""
    given = spark.range(5_000).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).select(
        F.concat(F.lit("r"), "id", F.lit("-"), "v").alias("rule_id"), F.lit(1).alias("version"), F.concat(F.lit("s"), "id").alias("subject"),
        F.lit("a").alias("action"), F.lit("allow").alias("decision"), F.lit(0).alias("priority"), F.expr("cast(map() as map<string,string>)").alias("conditions"),
        F.expr("date '0001-01-01'").alias("effective_from"), F.lit(None).cast("date").alias("effective_until"),
    )
    asked = spark.range(10_000).select(
        F.concat(F.lit("s"), F.col("id") % 5_000).alias("subject"), F.lit("a").alias("action"), F.expr("date '9999-12-01'").alias("reference_date"), "id",
        F.expr("cast(map() as map<string,string>)").alias("attributes"),
    )
    began = time.monotonic()
    got = rules.resolve(given, asked, ["subject", "action", "reference_date", "id"], small_rules=0)
    assert got.where((F.col("status") == "applied") & (F.size("matched_rule_versions") == 2)).count() == 10_000
    assert time.monotonic() - began < 60


def test_hot_parts_are_those_of_an_exact_count(spark):
    rows = spark.range(1_000).select(F.when(F.col("id") < 300, "hot").when(F.col("id") < 500, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    assert {(r.k, r._parts) for r in sizing.hot_parts(rows, ["k"], 90).collect()} == {("hot", 4), (None, 3)}
    assert sizing.hot_parts(rows, ["k"], 300) is None


def test_only_hot_keys_are_dealt(spark):
    asked = spark.range(100).select(F.when(F.col("id") < 95, "hot").otherwise("cold").alias("k"), "id")
    offered = spark.createDataFrame([("hot", 1), ("cold", 2), ("unasked", 3)], "k string, v int")
    left, right = sizing.deal_hot_keys(asked, offered, ["k"], ["id"], part_rows=20)
    assert {(r.k, r.part) for r in right.collect()} == {("cold", 0), ("unasked", 0), *(("hot", p) for p in range(5))}
    assert left.count() == 100 and {r.part for r in left.where("k = 'hot'").collect()} == set(range(5))
    assert left.join(right, ["k", "part"]).count() == 100


def brute_cycles(links):
    alive = {a for a, _ in links}
    while True:
        kept = {a for a, b in links if a in alive and b in alive}
        if kept == alive:
            return alive
        alive = kept


@pytest.mark.parametrize("seed", range(6))
def test_cycles_equal_peeling(spark, seed):
    draw = random.Random(seed)
    links = {(f"d{draw.randrange(40)}", f"d{draw.randrange(40)}") for _ in range([10, 25, 35, 45, 60, 90][seed])}
    links |= {(f"c{i}", f"c{i + 1}") for i in range(30)} | {("c30", "d1")} | ({("x", "x")} if seed % 2 else set())
    frame = spark.createDataFrame(sorted(links), "document_id string, target string")
    got = [r.document_id for r in catalog.on_or_before_cycle(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_cycles(links)


def test_a_long_chain_is_jumped_over(spark):
    """A round a link would take thousands of rounds."""
    chain = spark.range(5_000).select(F.col("id").cast("string").alias("document_id"), (F.col("id") + 1).cast("string").alias("target"))
    turned = chain.unionByName(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("c", "5")], "document_id string, target string"))
    assert {r.document_id for r in catalog.on_or_before_cycle(turned).collect()} == {"a", "b", "c"}


def test_no_links_at_all(spark):
    assert catalog.on_or_before_cycle(spark.createDataFrame([], "document_id string, target string")).collect() == []
