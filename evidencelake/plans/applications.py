"""Whole applications over the given tables: sealed requests, logged responses, verified outcomes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import answers, application, context, evidence
from evidencelake.plans import answering
from evidencelake.plans.registry import query
from evidencelake.session import ensure_checkpoint_dir

ATTEMPTS = ("quote", "echo", "partial", "refusal", "prose", "none")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """The gateway's requests of all decomposed questions, kept as a small stored table (one row a question)."""
    ensure_checkpoint_dir(spark)
    rows = context.prepare(answering.contexts(spark, folder))
    return rows.select("query_id", "query", "request_status", "items", "groups", "input_text").checkpoint()


def responses(prepared: DataFrame) -> DataFrame:
    """A log of six clients for each prepared request.

    One quotes the first sentence of each group's first passage, one repeats the question as its claim, one quotes for
    the first group only, one refuses, one writes prose that is no JSON, one gives no answer.
    """
    text_of = lambda wanted: F.element_at(F.filter("items", lambda i: i["item_id"] == wanted), 1)["text"]
    support = lambda g: F.struct(g["step_id"].alias("step_id"), F.slice(g["evidence_ids"], 1, 1).alias("evidence_ids"))
    sentence = lambda g: F.concat(F.trim(F.split_part(text_of(g["evidence_ids"][0]), F.lit("."), F.lit(1))), F.lit("."))
    quoted = F.transform("groups", lambda g: F.struct(sentence(g).alias("text"), F.array(support(g)).alias("supports")))
    echoed = F.array(F.struct(F.col("query").alias("text"), F.transform("groups", support).alias("supports")))
    body = lambda status, claims: F.to_json(F.struct(F.lit(status).alias("status"), claims.alias("claims")))
    given = {
        "quote": body("answered", quoted), "echo": body("answered", echoed), "partial": body("answered", F.slice(quoted, 1, 1)),
        "refusal": body("insufficient_evidence", F.slice(quoted, 1, 0)), "prose": text_of(F.element_at("groups", 1)["evidence_ids"][0]),
        "none": F.lit(None).cast("string"),
    }
    listed = F.array(*(F.struct(F.lit(name).alias("attempt"), given[name].alias("response")) for name in ATTEMPTS))
    return prepared.where(F.col("request_status") == "prepared").select("query_id", F.inline(listed))


def outcome_rows(spark: SparkSession, folder: str) -> DataFrame:
    asked = requests(spark, folder)
    return application.outcomes(asked, responses(asked))


C = answering._content_sql
OUTCOME_SQL = f"""{answering.CONTEXT_SQL},
g AS (SELECT s.query_id, s.step_id, s.position, min_by(k.text, k.i) AS text FROM steps s JOIN kept k ON k.query_id = s.query_id AND list_contains(k.step_ids, s.step_id)
  WHERE s.query_id IN (SELECT query_id FROM compiled WHERE status = 'ready') GROUP BY ALL),
gs AS (SELECT *, trim(split_part(text, '.', 1)) || '.' AS sentence FROM g),
gq AS (SELECT query_id, count(*) AS n, bool_or(len({C('sentence')}) = 0) AS empty, bool_or(len({C('sentence')}) = 0) FILTER (position = 0) AS first_empty, flatten(list({C('text')})) AS tokens FROM gs GROUP BY query_id),
sus AS (SELECT query_id, bool_or(len({answering.SAFETY_SQL.replace('strip_accents(t)', 'strip_accents(text)')}) > 0) AS bad FROM kept GROUP BY query_id),
tries AS (SELECT c.query_id, t.attempt FROM compiled c LEFT JOIN (SELECT unnest({list(ATTEMPTS)}) AS attempt) t ON c.status = 'ready'),
decided AS (SELECT query_id, attempt, gq.query_id IS NOT NULL AS prepared,
    CASE attempt WHEN 'prose' THEN 'unsupported_status' WHEN 'partial' THEN CASE WHEN n > 1 THEN 'uncited_group' END END AS problem,
    CASE attempt WHEN 'refusal' THEN 'release' ELSE CASE WHEN bad THEN 'review' WHEN CASE attempt WHEN 'quote' THEN empty WHEN 'partial' THEN first_empty
      ELSE CASE WHEN len({C('query')}) > 0 THEN len(list_intersect({C('query')}, tokens)) / len({C('query')}) ELSE 0.0 END < {answers.MIN_COVERAGE} END THEN 'reject' ELSE 'release' END END AS decision
  FROM tries JOIN asks USING (query_id) LEFT JOIN gq USING (query_id) LEFT JOIN sus USING (query_id)),
results AS (SELECT query_id, coalesce(attempt, '') AS attempt, CASE WHEN prepared THEN 'prepared' ELSE 'blocked' END AS request_status,
    CASE WHEN NOT prepared THEN 'blocked' WHEN attempt = 'none' THEN 'failed' WHEN problem IS NOT NULL OR decision = 'reject' THEN 'rejected' WHEN decision = 'review' THEN 'held' ELSE 'validated' END AS synthesis_status,
    CASE WHEN NOT prepared THEN 'request_not_prepared' WHEN attempt = 'none' THEN 'client_failed' WHEN problem IS NOT NULL THEN 'response_rejected'
      WHEN decision = 'reject' THEN 'verification_claim_support_failed' WHEN decision = 'review' THEN 'verification_untrusted_content' ELSE '' END AS synthesis_failure FROM decided)"""


@query("application_outcomes", f"WITH RECURSIVE {OUTCOME_SQL} SELECT * FROM results")
def application_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of every question: blocked before any client, failed, rejected, held or validated."""
    return outcome_rows(spark, folder).select(
        "query_id", F.coalesce("attempt", F.lit("")).alias("attempt"), "request_status", "synthesis_status",
        F.coalesce("synthesis_failure", F.lit("")).alias("synthesis_failure"),
    )


@query(
    "application_rollup",
    f"""WITH RECURSIVE {OUTCOME_SQL} SELECT attempt, count(*) AS attempt_count, count(*) FILTER (request_status = 'prepared') AS prepared_count, count(*) FILTER (request_status = 'prepared') AS invoked_count,
      count(*) FILTER (synthesis_status = 'validated') AS validated_count, 1.0::DOUBLE AS invocation_safety, 1.0::DOUBLE AS release_safety FROM results GROUP BY attempt""",
)
def application_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Prepared, invoked and released counts of each client, with the two safety rates of the outcomes themselves."""
    rows = outcome_rows(spark, folder).withColumn("answer_present", F.col("answer").isNotNull())
    return answers.application_summary(rows.withColumn("attempt", F.coalesce("attempt", F.lit(""))), ["attempt"])


_SCHEMAS = {name: json.dumps(answers.response_schema(bounded=b), sort_keys=True, separators=(",", ":")) for name, b in application.SCHEMA_POLICIES.items()}
_QUOTED = lambda value: "'" + value.replace("'", "''") + "'"


@query(
    "request_policies",
    f"""WITH RECURSIVE {answering.CONTEXT_SQL}, i AS (SELECT * FROM (VALUES {', '.join(f'({_QUOTED(n)}, {_QUOTED(context.DECOMPOSED_INSTRUCTION + t)})' for n, t in application.INSTRUCTION_POLICIES.items())}) v(instruction_policy, instruction)),
    s AS (SELECT * FROM (VALUES {', '.join(f'({_QUOTED(n)}, {_QUOTED(t)})' for n, t in _SCHEMAS.items())}) v(schema_policy, response_schema)),
    e AS (SELECT st.query_id, st.position, '{{"evidence": [' || string_agg('{{"document_id": ' || to_json(k.source) || ', "evidence_id": "' || k.chunk_id || '", "page": null, "section": ' || to_json(k.lang) || ', "text": ' || to_json(k.text) || '}}', ', ' ORDER BY k.i)
        || '], "reference_date": ' || CASE WHEN corpus = 'comparison' THEN 'null' ELSE to_json(corpus) END || ', "scope": ' || CASE WHEN corpus = 'comparison' THEN to_json(q) ELSE 'null' END || ', "step_id": ' || to_json(st.step_id) || '}}' AS body
      FROM steps st JOIN kept k ON k.query_id = st.query_id AND list_contains(k.step_ids, st.step_id) GROUP BY st.query_id, st.position, corpus, q, st.step_id),
    b AS (SELECT c.query_id, '{{"evidence_groups": [' || string_agg(body, ', ' ORDER BY position) || '], "question": ' || to_json(c.query) || '}}' AS input FROM e JOIN compiled c USING (query_id) WHERE c.status = 'ready' GROUP BY c.query_id, c.query)
    SELECT query_id, instruction_policy, schema_policy, sha256(instruction || chr(0) || response_schema || chr(0) || input) AS request_sha256 FROM b, i, s""",
)
def request_policies(spark: SparkSession, folder: str) -> DataFrame:
    """Every prepared request under every pair of policies."""
    pair = F.struct
    pairs = F.array(*(pair(F.lit(i).alias("instruction_policy"), F.lit(s).alias("schema_policy")) for i in application.INSTRUCTION_POLICIES for s in application.SCHEMA_POLICIES))
    asked = requests(spark, folder).where("request_status = 'prepared'").select("query_id", "input_text", F.inline(pairs))
    rows = application.with_policies(asked, context.DECOMPOSED_INSTRUCTION)
    return rows.select("query_id", "instruction_policy", "schema_policy", application.request_digest().alias("request_sha256"))


MUTATIONS = ("same", "citations_reversed", "last_citation_lost", "groups_swapped", "gate_opened")


@query(
    "bundle_preservation",
    f"""WITH {answering.EXECUTION_SQL}, c AS (SELECT s.query_id, s.step_id, s.position, count(f.chunk_id) AS n FROM steps s LEFT JOIN found f USING (query_id, step_id) GROUP BY ALL),
    cited AS (SELECT s.query_id, s.step_id, s.position, list({{'c': f.chunk_id, 'r': f.rank}} ORDER BY f.rank) FILTER (f.chunk_id IS NOT NULL) AS cites FROM steps s LEFT JOIN found f USING (query_id, step_id) GROUP BY ALL),
    two AS (SELECT query_id, st.status = 'ready' AS open, count(x.position) AS groups, count(*) FILTER (x.position IS NOT NULL AND coalesce(len(cites), 0) > 1) AS many, count(*) FILTER (x.position IS NOT NULL AND coalesce(len(cites), 0) > 0) AS any_cited,
        count(DISTINCT coalesce(cites, [])) FILTER (x.position IS NOT NULL) AS kinds FROM status st LEFT JOIN cited x USING (query_id) GROUP BY query_id, st.status),
    m AS (SELECT unnest({list(MUTATIONS)}) AS mutation),
    o AS (SELECT mutation, open, groups, CASE mutation WHEN 'groups_swapped' THEN groups % 2 ELSE groups END AS contexts,
        CASE mutation WHEN 'citations_reversed' THEN groups - many WHEN 'last_citation_lost' THEN groups - any_cited WHEN 'groups_swapped' THEN CASE WHEN kinds <= 1 THEN groups ELSE 0 END ELSE groups END AS citations,
        CASE mutation WHEN 'gate_opened' THEN open ELSE true END AS gate FROM two, m)
    SELECT mutation, count(*) AS case_count, sum(groups)::BIGINT AS group_count, round(avg((contexts = groups AND citations = groups AND gate)::INT), 6) AS exact_match,
      round(sum(contexts) / sum(groups), 6) AS context_preservation_accuracy, round(sum(citations) / sum(groups), 6) AS citation_preservation_accuracy, round(avg(gate::INT), 6) AS generation_gate_accuracy
    FROM o GROUP BY mutation""",
)
def bundle_preservation(spark: SparkSession, folder: str) -> DataFrame:
    """Bundles of all decomposed questions against themselves and against four ways of spoiling them."""
    ensure_checkpoint_dir(spark)
    bundles = answering.evidence_bundles(spark, folder)
    seen = evidence.observable(bundles).checkpoint()  # one row a question
    groups = F.col("groups")
    cites = lambda change: F.transform(groups, lambda g: g.withField("citations", change(g["citations"])))
    changed = {
        "same": groups, "citations_reversed": cites(F.reverse), "gate_opened": groups, "groups_swapped": F.reverse(groups),
        "last_citation_lost": cites(lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))),
    }
    listed = F.array(
        *(F.struct(F.lit(name).alias("mutation"), (F.lit(True) if name == "gate_opened" else F.col("can_generate")).alias("can_generate"), changed[name].alias("groups")) for name in MUTATIONS)
    )
    spoilt = seen.select("query_id", F.inline(listed))
    return evidence.preservation(seen, spoilt, ["mutation"])
