"""Query understanding over questions written from every order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.operators import metrics, understanding
from evidencelake.plans import inputs
from evidencelake.plans.registry import query

QUESTIONS_SQL = f"""
asks AS (SELECT o_orderkey, CASE o_orderkey % 12
  WHEN 0 THEN 'Compare ' || seg || ' com ' || prio || '.' WHEN 1 THEN 'Qual é a diferença entre ' || seg || ' e ' || prio || '?'
  WHEN 2 THEN seg || ' VERSUS ' || prio WHEN 3 THEN 'Qual regra vale em ' || iso || ' e em ' || br || '?'
  WHEN 4 THEN 'Consulte a API do portal e obtenha o preço de hoje do pedido ' || o_orderkey
  WHEN 5 THEN 'Auditar cobrança do procedimento ' || lpad(o_orderkey::VARCHAR, 8, '0') || ' em ' || br
  WHEN 6 THEN 'Manual do documento do pedido ' || o_orderkey WHEN 7 THEN 'Pedido ' || o_orderkey || ' de ' || seg
  WHEN 8 THEN 'Cotação  ATUAL do item ' || o_orderkey WHEN 9 THEN 'Compare os pedidos de ' || seg
  WHEN 10 THEN 'Relacione a norma ' || seg || ' e também a regra ' || prio || ' em ' || iso
  ELSE 'Os   documentos alfa e beta,  separadamente: ' || seg || ' em 30/02/2024' END AS query
  FROM (SELECT o_orderkey, c_mktsegment AS seg, o_orderpriority AS prio, strftime(o_orderdate, '%Y-%m-%d') AS iso,
    strftime(o_orderdate::DATE + 365, '%d/%m/%Y') AS br FROM orders JOIN customer ON c_custkey = o_custkey)),
folded AS (SELECT *, {inputs.FOLD_SQL.format('normalized')} AS f,
    regexp_extract_all(normalized, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})') AS mentions
  FROM (SELECT *, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS normalized FROM asks)),
flags AS (SELECT *, contains(f, 'cotacao atual') OR contains(f, 'dados em tempo real') OR contains(f, 'preco atual') OR (
    regexp_matches(f, 'acesse|buscar|busque|consulte|consultar|informado|obtenha')
    AND regexp_matches(f, 'api|base externa|fonte externa|portal|servico externo|sistema externo')
    AND regexp_matches(f, 'agora|atual|hoje|mais recente|tempo real')) AS external,
  regexp_matches(f, 'compare|comparar|comparacao|diferenca entre|mudancas|versus') AS comparison,
  list_transform(mentions, lambda m: CASE WHEN contains(m, '/') THEN try_strptime(m, '%d/%m/%Y')::DATE ELSE try_strptime(m, '%Y-%m-%d')::DATE END) AS dates FROM folded),
analyzed AS (SELECT *, CASE WHEN normalized = '' THEN 'blank_query' WHEN list_count(dates) < len(dates) THEN 'invalid_date' ELSE 'analyzed' END AS status,
  CASE WHEN external THEN 'external_lookup' WHEN comparison THEN 'comparison'
    WHEN regexp_matches(f, 'auditar|auditoria|cobranca|cobertura|glosa|procedimento') THEN 'audit_case'
    WHEN regexp_matches(f, 'diretriz|documento|manual|norma|regra') THEN 'document_lookup' ELSE 'general' END AS intent,
  regexp_extract(normalized, '(^|[^0-9])([0-9]{{8}})($|[^0-9])', 2) AS procedure,
  len(dates) > 1 OR comparison OR regexp_matches(f, 'cruze|e tambem|em ambos|mais de um documento|relacione') AS decomposition,
  CASE WHEN external THEN 'requires_external_data' WHEN comparison OR len(dates) > 1 THEN 'requires_decomposition' ELSE 'direct_retrieval' END AS route FROM flags)"""


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per order in twelve phrasings."""
    joined = inputs.table(spark, folder, "orders").join(
        inputs.table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey")
    )
    key, seg, prio = F.col("o_orderkey").cast("string"), F.col("c_mktsegment"), F.col("o_orderpriority")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    br = F.date_format(F.date_add(F.to_date("o_orderdate"), 365), "dd/MM/yyyy")
    phrases = [
        ("Compare ", seg, " com ", prio, "."),
        ("Qual é a diferença entre ", seg, " e ", prio, "?"),
        (seg, " VERSUS ", prio),
        ("Qual regra vale em ", iso, " e em ", br, "?"),
        ("Consulte a API do portal e obtenha o preço de hoje do pedido ", key),
        ("Auditar cobrança do procedimento ", F.lpad(key, 8, "0"), " em ", br),
        ("Manual do documento do pedido ", key),
        ("Pedido ", key, " de ", seg),
        ("Cotação  ATUAL do item ", key),
        ("Compare os pedidos de ", seg),
        ("Relacione a norma ", seg, " e também a regra ", prio, " em ", iso),
        ("Os   documentos alfa e beta,  separadamente: ", seg, " em 30/02/2024"),
    ]
    chosen = None
    for number, parts in enumerate(phrases):
        phrase = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        hit = F.col("o_orderkey") % 12 == number
        chosen = F.when(hit, phrase) if chosen is None else chosen.when(hit, phrase)
    return joined.select("o_orderkey", chosen.alias("query"))


@query(
    "query_analysis",
    f"""WITH {QUESTIONS_SQL} SELECT o_orderkey, normalized, status, intent, procedure, CASE WHEN len(dates) = 1 THEN coalesce(dates[1]::VARCHAR, '') ELSE '' END AS reference_date,
    external AS requires_external_data, decomposition AS requires_decomposition, route FROM analyzed""",
)
def query_analysis(spark: SparkSession, folder: str) -> DataFrame:
    rows = understanding.analyze(questions(spark, folder))
    return rows.select(
        "o_orderkey",
        "normalized",
        "status",
        "intent",
        F.coalesce("procedure", F.lit("")).alias("procedure"),
        F.coalesce(F.col("reference_date").cast("string"), F.lit("")).alias("reference_date"),
        "requires_external_data",
        "requires_decomposition",
        "route",
    )


@query(
    "query_route",
    f"""WITH {QUESTIONS_SQL} SELECT route, CASE WHEN external THEN 'requires_external_data' WHEN decomposition OR o_orderkey % 5 = 0 THEN 'requires_decomposition'
      ELSE 'direct_retrieval' END AS conservative, count(*) AS queries FROM analyzed GROUP BY ALL""",
)
def query_route(spark: SparkSession, folder: str) -> DataFrame:
    """Explicit route next to the conservative one with a simulated advisor."""
    rows = understanding.analyze(questions(spark, folder))
    advised = F.col("o_orderkey") % 5 == 0
    conservative = understanding.conservative_route(
        F.col("requires_external_data"), F.col("requires_decomposition"), advised
    )
    return rows.groupBy("route", conservative.alias("conservative")).agg(
        F.count(F.lit(1)).cast("bigint").alias("queries")
    )


@query(
    "query_dates",
    f"""WITH {QUESTIONS_SQL} SELECT o_orderkey, unnest(range(1, len(mentions) + 1)) AS position, coalesce(unnest(dates)::VARCHAR, 'invalid') AS mentioned FROM analyzed""",
)
def query_dates(spark: SparkSession, folder: str) -> DataFrame:
    found = questions(spark, folder).select("o_orderkey", F.posexplode(understanding.dates(F.col("query"))).alias("p", "d"))
    return found.select(
        "o_orderkey",
        (F.col("p") + 1).cast("bigint").alias("position"),
        F.coalesce(F.col("d").cast("string"), F.lit("invalid")).alias("mentioned"),
    )


STRUCTURE_SQL = """(regexp_matches(f, '\\b(?:ambos|ambas|nos dois|nas duas|em cada (?:documento|fonte|manual|norma|regra|versao)|de cada (?:documento|fonte|manual|norma|regra|versao))\\b')
  OR regexp_matches(f, '\\b(?:documento|fonte|manual|norma|regra|versao)\\b.{0,50}\\b(?:e|com|entre)\\b.{0,50}\\b(?:documento|fonte|manual|norma|regra|versao)\\b')
  OR regexp_matches(f, '\\b(?:documentos|fontes|manuais|normas|regras|versoes)\\b.{0,50}\\b(?:alfa e beta|beta e alfa|primeiro e segundo|segunda e primeira)\\b')
  OR regexp_matches(f, '\\b(?:separadamente|respectivamente)\\b'))"""


@query(
    "structural_decomposition_confusion",
    f"""WITH {QUESTIONS_SQL}, o AS (SELECT {STRUCTURE_SQL} AS a, decomposition AS e FROM analyzed),
    c AS (SELECT count(*) FILTER (a AND e) AS true_positive, count(*) FILTER (a AND NOT e) AS false_positive,
      count(*) FILTER (NOT a AND NOT e) AS true_negative, count(*) FILTER (NOT a AND e) AS false_negative FROM o)
    SELECT *, round((true_positive + true_negative) / (true_positive + true_negative + false_positive + false_negative), 6) AS accuracy,
      round(true_positive / (true_positive + false_positive), 6) AS precision, round(true_positive / (true_positive + false_negative), 6) AS recall,
      round(false_positive / (false_positive + true_negative), 6) AS false_positive_rate FROM c""",
)
def structural_decomposition_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """The structure heuristic judged by the analyzer's flag."""
    rows = understanding.analyze(questions(spark, folder))
    return metrics.confusion(
        rows, understanding.structural_decomposition(F.col("query")), F.col("requires_decomposition")
    )


PLAN_SQL = f"""{QUESTIONS_SQL},
routed AS (SELECT *, trim(regexp_replace(normalized, '[.!?]+$', '')) AS cand FROM analyzed WHERE status = 'analyzed' AND route = 'requires_decomposition'),
scoped AS (SELECT *, CASE
    WHEN regexp_matches(cand, '(?i)^(?:compare|comparar)\\s+(.+?)\\s+com\\s+(.+?)$') THEN [regexp_extract(cand, '(?i)^(?:compare|comparar)\\s+(.+?)\\s+com\\s+(.+?)$', 1), regexp_extract(cand, '(?i)^(?:compare|comparar)\\s+(.+?)\\s+com\\s+(.+?)$', 2)]
    WHEN regexp_matches(cand, '(?i)^(?:qual\\s+(?:é|e)\\s+a\\s+)?diferen[çc]a\\s+entre\\s+(.+?)\\s+e\\s+(.+?)$') THEN [regexp_extract(cand, '(?i)^(?:qual\\s+(?:é|e)\\s+a\\s+)?diferen[çc]a\\s+entre\\s+(.+?)\\s+e\\s+(.+?)$', 1), regexp_extract(cand, '(?i)^(?:qual\\s+(?:é|e)\\s+a\\s+)?diferen[çc]a\\s+entre\\s+(.+?)\\s+e\\s+(.+?)$', 2)]
    WHEN regexp_matches(cand, '(?i)^(.+?)\\s+versus\\s+(.+?)$') THEN [regexp_extract(cand, '(?i)^(.+?)\\s+versus\\s+(.+?)$', 1), regexp_extract(cand, '(?i)^(.+?)\\s+versus\\s+(.+?)$', 2)] END AS scopes FROM routed),
steps AS (SELECT o_orderkey, 'ready' AS plan_status, 'temporal_snapshots' AS strategy, unnest(range(1, len(dates) + 1)) AS position, 'temporal-' || unnest(range(1, len(dates) + 1)) AS step_id,
    normalized AS query, unnest(dates)::VARCHAR AS reference_date, '' AS scope FROM scoped WHERE len(dates) > 1
  UNION ALL SELECT o_orderkey, 'ready', 'comparison_scopes', unnest([1, 2]), 'comparison-' || unnest([1, 2]), trim(unnest(scopes), ' ,;:'), '', trim(unnest(scopes), ' ,;:')
    FROM scoped WHERE len(dates) <= 1 AND scopes IS NOT NULL
  UNION ALL SELECT o_orderkey, 'needs_clarification', '', 0, '', '', '', '' FROM scoped WHERE len(dates) <= 1 AND scopes IS NULL)"""


@query("query_plan_steps", f"WITH {PLAN_SQL} SELECT * FROM steps")
def query_plan_steps(spark: SparkSession, folder: str) -> DataFrame:
    """One row per step; a plan that needs clarification is one empty row."""
    planned = understanding.plan(understanding.analyze(questions(spark, folder)))
    ready = understanding.plan_steps(planned, "o_orderkey").withColumn("position", F.col("position") + 1)
    unclear = planned.where(F.col("plan_status") == "needs_clarification").select(
        "o_orderkey", "plan_status", "strategy", F.lit(0).alias("position")
    )
    rows = ready.unionByName(unclear, allowMissingColumns=True)
    return rows.select(
        "o_orderkey",
        "plan_status",
        F.coalesce("strategy", F.lit("")).alias("strategy"),
        F.col("position").cast("bigint").alias("position"),
        F.coalesce("step_id", F.lit("")).alias("step_id"),
        F.coalesce("query", F.lit("")).alias("query"),
        F.coalesce(F.col("reference_date").cast("string"), F.lit("")).alias("reference_date"),
        F.coalesce("scope", F.lit("")).alias("scope"),
    )


FIELDS = ("intent", "reference_date", "procedure", "requires_external_data", "requires_decomposition")


@query(
    "query_field_accuracy",
    f"""WITH {QUESTIONS_SQL}, want AS (SELECT o_orderkey, external, decomposition,
      CASE o_orderkey % 3 WHEN 0 THEN 'comparison' WHEN 1 THEN intent ELSE 'general' END = intent AS m_intent,
      (CASE WHEN o_orderkey % 7 = 0 OR len(dates) <> 1 THEN NULL ELSE dates[1] END) IS NOT DISTINCT FROM (CASE WHEN len(dates) = 1 THEN dates[1] END) AS m_date,
      o_orderkey % 24 <> 5 OR procedure = '' AS m_procedure, external = (o_orderkey % 12 IN (4, 8)) AS m_external, decomposition = (o_orderkey % 12 < 4) AS m_decomposition FROM analyzed)
    SELECT count(*) AS case_count, round(avg(m_intent::INT), 6) AS intent, round(avg(m_date::INT), 6) AS reference_date, round(avg(m_procedure::INT), 6) AS procedure,
      round(avg(m_external::INT), 6) AS requires_external_data, round(avg(m_decomposition::INT), 6) AS requires_decomposition,
      round(avg((m_intent AND m_date AND m_procedure AND m_external AND m_decomposition)::INT), 6) AS exact_match FROM want""",
)
def query_field_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of five analysis fields against derived labels."""
    rows = understanding.analyze(questions(spark, folder))
    key = F.col("o_orderkey")
    wanted = {
        "intent": F.when(key % 3 == 0, "comparison").when(key % 3 == 1, F.col("intent")).otherwise("general"),
        "reference_date": F.when(key % 7 != 0, F.col("reference_date")),
        "procedure": F.when(key % 24 != 5, F.col("procedure")),
        "requires_external_data": (key % 12).isin(4, 8),
        "requires_decomposition": key % 12 < 4,
    }
    matches = rows.select(*[F.col(f).eqNullSafe(wanted[f]).alias(f) for f in FIELDS])
    everything = F.lit(True)
    for field in FIELDS:
        everything = everything & F.col(field)
    return matches.agg(
        F.count(F.lit(1)).cast("bigint").alias("case_count"),
        *[F.round(metrics.share(F.col(f)), 6).alias(f) for f in FIELDS],
        F.round(metrics.share(everything), 6).alias("exact_match"),
    )
