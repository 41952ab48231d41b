"""Strict reading of payloads written from the given tables, flaws included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.plans import inputs
from evidencelake.plans.registry import query
from evidencelake.sources import payloads


def _problem_sql(fields: dict[str, payloads.Field], text: str) -> str:
    """The verdict on a payload by DuckDB's own JSON functions."""
    kinds = {
        "string": "json_type(p, '$.{0}') = 'VARCHAR'", "integer": "json_type(p, '$.{0}') IN ('BIGINT', 'UBIGINT')", "boolean": "json_type(p, '$.{0}') = 'BOOLEAN'",
        "date": "json_type(p, '$.{0}') = 'VARCHAR'", "strings": "json_type(p, '$.{0}') = 'ARRAY' AND len(list_filter(json_extract(p, '$.{0}[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0",
        "pairs": "json_type(p, '$.{0}') = 'OBJECT' AND len(list_filter(json_extract(p, '$.{0}.*'), lambda x: json_type(x) <> 'VARCHAR')) = 0",
    }
    names, needed = list(fields), [n for n, f in fields.items() if f.required]
    cases = []
    for n, f in fields.items():
        absent = "" if f.required else f"coalesce(json_type(p, '$.{n}'), 'NULL') <> 'NULL' AND "
        cases.append(f"WHEN {absent}NOT coalesce({kinds[f.kind].format(n)}, false) THEN 'wrong_type:{n}'")
    for n, f in fields.items():
        value = f"json_extract_string(p, '$.{n}')"
        if f.kind == "date":
            cases.append(f"WHEN {value} IS NOT NULL AND NOT (regexp_full_match({value}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast({value} AS DATE) IS NOT NULL) THEN 'invalid_value:{n}'")
        elif f.values:
            cases.append(f"WHEN {value} NOT IN ({', '.join(repr(v) for v in f.values)}) THEN 'invalid_value:{n}'")
    keys = lambda test: f"list_sort(list_filter({test}))"
    odd, lacking = keys(f"json_keys(p), lambda x: NOT list_contains({names}, x)"), keys(f"{needed}, lambda x: NOT list_contains(json_keys(p), x)")
    return f"""(SELECT CASE WHEN p IS NULL THEN 'malformed' WHEN json_type(p) <> 'OBJECT' THEN 'not_an_object' WHEN len({odd}) > 0 THEN 'unexpected:' || array_to_string({odd}, ',')
      WHEN len({lacking}) > 0 THEN 'missing:' || array_to_string({lacking}, ',') {' '.join(cases)} END FROM (SELECT try_cast({text} AS JSON) AS p))"""


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


ANSWERS_SQL = """answers AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN body[1:20] WHEN o_orderpriority = '5-LOW' THEN '[' || body || ']' ELSE body END AS payload FROM (
  SELECT *, '{"intent":' || CASE o_orderstatus WHEN 'F' THEN '"comparison"' WHEN 'O' THEN '"' || o_orderpriority || '"' ELSE o_custkey::VARCHAR END || ',"requires_external_data":' || CASE WHEN o_orderpriority = '2-HIGH' THEN '"true"' ELSE 'true' END
    || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE ',"requires_decomposition":false' END || CASE WHEN o_orderpriority = '3-MEDIUM' THEN ',"note":null' ELSE '' END || '}' AS body FROM orders))"""


def analysis_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One answer of an analysis model for each order, most of them flawed by its priority or status."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    intent = F.when(status == "F", '"comparison"').when(status == "O", _text('"', priority, '"')).otherwise(F.col("o_custkey").cast("string"))
    body = _text(
        '{"intent":', intent, ',"requires_external_data":', F.when(priority == "2-HIGH", '"true"').otherwise("true"),
        F.when(priority == "4-NOT SPECIFIED", "").otherwise(',"requires_decomposition":false'), F.when(priority == "3-MEDIUM", ',"note":null').otherwise(""), "}",
    )
    low = priority == "5-LOW"
    payload = F.when(low & (status == "P"), F.substring(body, 1, 20)).when(low, _text("[", body, "]")).otherwise(body)
    return inputs.table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), payload.alias("payload"))


@query(
    "analysis_payload_check",
    f"""WITH {ANSWERS_SQL}, j AS (SELECT k, try_cast(payload AS JSON) AS payload, {_problem_sql(payloads.ANALYSIS, 'payload')} AS problem FROM answers)
    SELECT k, coalesce(problem, '') AS problem, CASE WHEN problem IS NULL THEN json_extract_string(payload, '$.intent') ELSE '' END AS intent, problem IS NULL AND json_extract_string(payload, '$.requires_external_data') = 'true' AS external FROM j""",
)
def analysis_payload_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = payloads.read(analysis_answers(spark, folder), "payload", payloads.ANALYSIS)
    return rows.select(
        "k", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("intent", F.lit("")).alias("intent"),
        F.coalesce("requires_external_data", F.lit(False)).alias("external"),
    )


RULES_SQL = """given AS (SELECT p_partkey AS k, 0 AS copy, '{"rule_id":"r-' || p_partkey || '","version":' || CASE WHEN p_size < 5 THEN '"1"' ELSE '1' END || ',"subject":"' || p_brand || '","action":"' || p_type || '","decision":"'
    || CASE WHEN p_type = 'PROMO' THEN 'maybe' ELSE 'allow' END || '","effective_from":"2024-01-' || lpad(p_size::VARCHAR, 2, '0') || '"' || CASE WHEN p_size % 2 = 0 THEN ',"effective_until":null' ELSE '' END
    || CASE WHEN p_size % 3 = 0 THEN ',"conditions":{"size":' || p_size || '}' WHEN p_size % 3 = 1 THEN ',"conditions":{"size":"' || p_size || '"}' ELSE '' END || ',"priority":' || (p_size % 4)
    || CASE WHEN p_brand = 'Brand#1' THEN '' ELSE ',"source_document_id":"d"' END || '}' AS payload, p_size FROM part),
rows AS (SELECT k, copy, payload FROM given UNION ALL SELECT k, 1, payload FROM given WHERE p_size % 5 = 0)"""


def rule_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """A rule payload for each part; sizes and types flaw it, every fifth size is given twice."""
    size, number = F.col("p_size"), F.col("p_size").cast("string")
    payload = _text(
        '{"rule_id":"r-', F.col("p_partkey"), '","version":', F.when(size < 5, '"1"').otherwise("1"), ',"subject":"', F.col("p_brand"), '","action":"', F.col("p_type"),
        '","decision":"', F.when(F.col("p_type") == "PROMO", "maybe").otherwise("allow"), '","effective_from":"2024-01-', F.lpad(number, 2, "0"), '"',
        F.when(size % 2 == 0, ',"effective_until":null').otherwise(""),
        F.when(size % 3 == 0, _text(',"conditions":{"size":', number, "}")).when(size % 3 == 1, _text(',"conditions":{"size":"', number, '"}')).otherwise(""),
        ',"priority":', size % 4, F.when(F.col("p_brand") == "Brand#1", "").otherwise(',"source_document_id":"d"'), "}",
    )
    given = inputs.table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.lit(0).alias("copy"), payload.alias("payload"), "p_size")
    return given.drop("p_size").unionByName(given.where(size % 5 == 0).withColumn("copy", F.lit(1)).drop("p_size"))


@query(
    "rule_payload_rows",
    f"""WITH {RULES_SQL}, j AS (SELECT *, {_problem_sql(payloads.RULE, 'payload')} AS first_problem FROM rows),
    n AS (SELECT k FROM j WHERE first_problem IS NULL GROUP BY k HAVING count(*) > 1)
    SELECT k, copy, coalesce(first_problem, CASE WHEN k IN (SELECT k FROM n) THEN 'repeated_rule_version' END, '') AS problem,
      CASE WHEN first_problem IS NULL THEN json_extract_string(payload, '$.effective_from') ELSE '' END AS effective_from FROM j""",
)
def rule_payload_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = payloads.rules(rule_payloads(spark, folder), "payload")
    return rows.select(
        "k", "copy", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce(F.col("effective_from").cast("string"), F.lit("")).alias("effective_from")
    )


@query(
    "execution_dataset_rows",
    """WITH c AS (SELECT doc_id AS id, 'document' AS kind, source FROM documents UNION ALL SELECT page_id, 'page', url FROM pages),
    n AS (SELECT id FROM c GROUP BY id HAVING count(*) > 1),
    ok AS (SELECT DISTINCT source FROM c WHERE id NOT IN (SELECT id FROM n)),
    b AS (SELECT item_id, coalesce((SELECT min(source) FROM documents WHERE doc_id = item_id), 'nowhere') AS wanted FROM benchmark)
    SELECT kind, id, CASE WHEN id IN (SELECT id FROM n) THEN 'repeated_chunk_id' ELSE '' END AS problem FROM c
    UNION ALL SELECT 'case', item_id, CASE WHEN wanted IN (SELECT source FROM ok) THEN '' ELSE 'unknown_document' END FROM b""",
)
def execution_dataset_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and pages as two corpora whose ids collide; each question expects the source of the document of its number."""
    chunk = lambda key, document, text: F.to_json(F.struct(F.col(key).cast("string").alias("chunk_id"), F.col(document).alias("document_id"), F.col(text).alias("text")))
    documents = inputs.table(spark, folder, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("number"), F.lit("comparison").alias("corpus"), chunk("doc_id", "source", "text").alias("payload")
    )
    pages = inputs.table(spark, folder, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("number"), F.lit("2024-01-01").alias("corpus"), chunk("page_id", "url", "html").alias("payload")
    )
    sources = inputs.table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "source")
    asked = inputs.table(spark, folder, "benchmark").join(sources, "item_id", "left")
    case = F.struct(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.lit("ready").alias("status"), F.array(F.coalesce("source", F.lit("nowhere"))).alias("document_ids")
    )
    chunks, cases = payloads.execution_dataset(documents.unionByName(pages), asked.select(F.lit("case").alias("kind"), F.col("item_id").alias("number"), F.to_json(case).alias("payload")))
    shown = lambda df: df.select("kind", F.col("number").alias("id"), F.coalesce("problem", F.lit("")).alias("problem"))
    return shown(chunks).unionByName(shown(cases))
