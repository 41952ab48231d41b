"""Structured rules derived from parts, asked by every line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing
from evidencelake.operators import metrics, rules
from evidencelake.plans import inputs
from evidencelake.plans.registry import query
from evidencelake.session import ensure_checkpoint_dir


def rule_table(spark: SparkSession, folder: str) -> DataFrame:
    """Three rules per part; the brand names the rule set."""
    parts = inputs.table(spark, folder, "part").select(
        "*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"), F.col("p_partkey").alias("k")
    )
    start = F.expr("date '1995-01-01' + CAST((k * 37) % 1500 + v * 40 AS INT)")
    return parts.select(
        "k",
        "v",
        F.col("p_brand").alias("catalog"),
        F.substring("p_brand", 7, 2).cast("int").alias("brand"),
        F.concat_ws("-", F.lit("r"), F.col("k").cast("string"), F.col("v").cast("string")).alias("rule_id"),
        ((F.col("k") + F.col("v")) % 3 + 1).cast("int").alias("version"),
        F.concat(F.lit("part-"), F.col("k").cast("string")).alias("subject"),
        F.when(F.col("v") == 0, "A").when((F.col("p_size") + F.col("v")) % 2 == 0, "A").otherwise("R").alias("action"),
        F.when((F.col("k") * 7 + F.col("v") * 3) % 5 < 3, "allow").otherwise("deny").alias("decision"),
        ((F.col("p_size") + F.col("v")) % 2).cast("int").alias("priority"),
        F.when(F.col("v") == 0, F.create_map().cast("map<string,string>"))
        .when(F.col("v") == 1, F.create_map(F.lit("status"), F.lit("O")))
        .otherwise(F.create_map(F.lit("status"), F.lit("F"), F.lit("tier"), F.col("p_type")))
        .alias("conditions"),
        start.alias("effective_from"),
        F.when(F.col("k") % 4 != 0, F.date_add(start, (F.lit(400) + F.col("p_size") * 10).cast("int"))).alias("effective_until"),
    )


RULES_SQL = """
rules AS (SELECT p_partkey AS k, v, p_brand AS catalog, substr(p_brand, 7, 2)::INT AS brand,
  'r-' || p_partkey || '-' || v AS rule_id, ((p_partkey + v) % 3 + 1)::INT AS version, 'part-' || p_partkey AS subject,
  CASE WHEN v = 0 THEN 'A' WHEN (p_size + v) % 2 = 0 THEN 'A' ELSE 'R' END AS action,
  CASE WHEN (p_partkey * 7 + v * 3) % 5 < 3 THEN 'allow' ELSE 'deny' END AS decision, ((p_size + v) % 2)::INT AS priority,
  CASE WHEN v = 1 THEN 'O' WHEN v = 2 THEN 'F' END AS need_status, CASE WHEN v = 2 THEN p_type END AS need_tier,
  date '1995-01-01' + CAST((p_partkey * 37) % 1500 + v * 40 AS INT) AS effective_from,
  CASE WHEN p_partkey % 4 <> 0 THEN date '1995-01-01' + CAST((p_partkey * 37) % 1500 + v * 40 AS INT) + CAST(400 + p_size * 10 AS INT) END AS effective_until
  FROM part, (SELECT unnest([0, 1, 2]) AS v))"""

TIERS = ("MEDIUM", "ECONOMY", "PROMO", "STANDARD", "SMALL", "LARGE")
QUERY_KEY = ["subject", "action", "reference_date", "status_attribute", "tier_attribute"]


def rule_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of all line items; equal ones are one question."""
    lines = inputs.table(spark, folder, "lineitem")
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return lines.select(
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("subject"),
        F.col("l_returnflag").alias("action"),
        F.to_date("l_shipdate").alias("reference_date"),
        F.col("l_linestatus").alias("status_attribute"),
        tier.alias("tier_attribute"),
    )


RESOLVED_SQL = f"""{RULES_SQL},
asked AS (SELECT DISTINCT 'part-' || l_partkey AS subject, l_returnflag AS action, l_shipdate::DATE AS reference_date,
  l_linestatus AS status_attribute, (['{"', '".join(TIERS)}'])[l_linenumber % 6 + 1] AS tier_attribute FROM lineitem),
matched AS (SELECT a.*, r.rule_id, r.version, r.decision, r.priority, max(r.priority) OVER (PARTITION BY a.subject, a.action,
    a.reference_date, a.status_attribute, a.tier_attribute) AS top
  FROM asked a LEFT JOIN rules r ON r.subject = a.subject AND r.action = a.action AND a.reference_date >= r.effective_from
    AND (r.effective_until IS NULL OR a.reference_date <= r.effective_until)
    AND (need_status IS NULL OR need_status = status_attribute) AND (need_tier IS NULL OR need_tier = tier_attribute)),
resolved AS (SELECT subject, action, reference_date, status_attribute, tier_attribute,
    CASE WHEN count(rule_id) = 0 THEN 'no_match' WHEN count(DISTINCT decision) > 1 THEN 'review' ELSE 'applied' END AS status,
    CASE WHEN count(rule_id) = 0 THEN 'no_applicable_rule' WHEN count(DISTINCT decision) > 1 THEN 'conflicting_rules' ELSE 'active_rule' END AS code,
    CASE WHEN count(DISTINCT decision) = 1 THEN min(decision) ELSE '' END AS decision,
    coalesce(string_agg(rule_id || '@' || version, ',' ORDER BY rule_id, version), '') AS matched
  FROM matched WHERE top IS NULL OR priority = top GROUP BY ALL)"""


def resolved_queries(spark: SparkSession, folder: str) -> DataFrame:
    attributes = F.create_map(F.lit("status"), F.col("status_attribute"), F.lit("tier"), F.col("tier_attribute"))
    return rules.resolve(rule_table(spark, folder), rule_queries(spark, folder), QUERY_KEY, attributes=attributes)


@query(
    "rule_resolution",
    f"""WITH {RESOLVED_SQL} SELECT subject, action, reference_date::VARCHAR AS reference_date, status_attribute, tier_attribute,
    status, code, decision, matched FROM resolved""",
)
def rule_resolution(spark: SparkSession, folder: str) -> DataFrame:
    return resolved_queries(spark, folder).select(
        "subject",
        "action",
        F.col("reference_date").cast("string").alias("reference_date"),
        "status_attribute",
        "tier_attribute",
        "status",
        "code",
        F.coalesce("decision", F.lit("")).alias("decision"),
        F.array_join("matched_rule_versions", ",").alias("matched"),
    )


@query(
    "rule_exact_match",
    f"""WITH {RESOLVED_SQL}, o AS (SELECT action AS category, status = (CASE WHEN action = 'N' THEN 'no_match' ELSE 'applied' END) AS correct FROM resolved)
    SELECT coalesce(category, 'all') AS name, count(*) AS case_count, sum(correct::INT)::BIGINT AS correct_count,
      round(avg(correct::INT), 6) AS exact_match FROM o GROUP BY ROLLUP (category)""",
)
def rule_exact_match(spark: SparkSession, folder: str) -> DataFrame:
    """Resolution against an expectation per action: overall and by category."""
    rows = resolved_queries(spark, folder).withColumnRenamed("action", "category")
    expected = F.when(F.col("category") == "N", "no_match").otherwise("applied")
    return metrics.exact_match(rows, F.col("status") == expected)


OVERLAPS_SQL = f"""{RULES_SQL},
findings AS (SELECT a.catalog, CASE WHEN a.decision = b.decision THEN 'redundant_overlap' ELSE 'conflicting_overlap' END AS code,
    least(a.rule_id || '@' || a.version, b.rule_id || '@' || b.version) AS first_version,
    greatest(a.rule_id || '@' || a.version, b.rule_id || '@' || b.version) AS second_version
  FROM rules a JOIN rules b ON a.catalog = b.catalog AND a.subject = b.subject AND a.action = b.action AND a.priority = b.priority
    AND a.rule_id < b.rule_id AND greatest(a.effective_from, b.effective_from)
      <= least(coalesce(a.effective_until, date '9999-12-31'), coalesce(b.effective_until, date '9999-12-31'))
    AND (a.need_status IS NULL OR b.need_status IS NULL OR a.need_status = b.need_status)
    AND (a.need_tier IS NULL OR b.need_tier IS NULL OR a.need_tier = b.need_tier))"""


@query("rule_overlap_audit", f"WITH {OVERLAPS_SQL} SELECT * FROM findings")
def rule_overlap_audit(spark: SparkSession, folder: str) -> DataFrame:
    return rules.overlaps(rule_table(spark, folder), ["catalog"])


@query(
    "rule_finding_counts",
    f"WITH {OVERLAPS_SQL} SELECT catalog, code, count(*) AS findings FROM findings GROUP BY ALL",
)
def rule_finding_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.overlaps(rule_table(spark, folder), ["catalog"])
    return found.groupBy("catalog", "code").agg(F.count(F.lit(1)).cast("bigint").alias("findings"))


SETS_SQL = f"""{OVERLAPS_SQL},
sets AS (SELECT DISTINCT catalog || '/' || (k % 40) AS rule_set FROM rules),
found AS (SELECT split_part(first_version, '-', 2)::BIGINT % 40 AS slot, * FROM findings),
inset AS (SELECT catalog || '/' || slot AS rule_set, code, first_version, second_version, split_part(first_version, '-', 2)::BIGINT AS k FROM found),
reviewed AS (SELECT rule_set, first_version, second_version FROM inset WHERE code = 'redundant_overlap' AND k % 3 <> 0
  UNION ALL SELECT rule_set, first_version, second_version FROM inset WHERE code = 'conflicting_overlap' AND k % 9 = 0),
admitted AS (SELECT s.rule_set, CASE WHEN stale > 0 THEN 'error' WHEN conflicts > 0 THEN 'rejected' WHEN pending > 0 THEN 'review' ELSE 'admitted' END AS status,
    CASE WHEN stale > 0 THEN 'invalid_review' WHEN conflicts > 0 THEN 'conflicting_overlap' WHEN pending > 0 THEN 'redundancy_review_required' ELSE 'clean_catalog' END AS code,
    CASE WHEN stale > 0 THEN 0 WHEN conflicts > 0 THEN conflicts ELSE pending END AS finding_count
  FROM (SELECT s.rule_set,
      (SELECT count(*) FROM inset i WHERE i.rule_set = s.rule_set AND code = 'conflicting_overlap') AS conflicts,
      (SELECT count(*) FROM inset i WHERE i.rule_set = s.rule_set AND code = 'redundant_overlap' AND (i.first_version, i.second_version)
        NOT IN (SELECT (r.first_version, r.second_version) FROM reviewed r)) AS pending,
      (SELECT count(*) FROM reviewed r WHERE r.rule_set = s.rule_set AND (r.first_version, r.second_version)
        NOT IN (SELECT (i.first_version, i.second_version) FROM inset i WHERE i.code = 'redundant_overlap')) AS stale
    FROM sets s) s)"""


def rule_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Forty rule sets per brand."""
    return rule_table(spark, folder).withColumn(
        "rule_set", F.concat_ws("/", "catalog", (F.col("k") % 40).cast("string"))
    )


@query("rule_admission", f"WITH {SETS_SQL} SELECT rule_set, status, code, finding_count::BIGINT AS finding_count FROM admitted")
def rule_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews cover most redundancies; some point at conflicts and are stale."""
    sets = rule_sets(spark, folder)
    ensure_checkpoint_dir(spark)
    found = rules.overlaps(sets, ["rule_set"]).checkpoint()  # read by findings and reviews
    k = F.split_part("first_version", F.lit("-"), F.lit(2)).cast("bigint")
    reviewed = found.where(
        ((F.col("code") == "redundant_overlap") & (k % 3 != 0))
        | ((F.col("code") == "conflicting_overlap") & (k % 9 == 0))
    )
    return rules.admit(sets, found, reviewed, "rule_set")


PUBLICATION_SQL = f"""{RULES_SQL},
current AS (SELECT *, catalog || '/' || (k % 40) AS rule_set FROM rules WHERE v = 0 OR brand % 6 = 5),
previous AS (
  SELECT rule_set, rule_id, CASE WHEN brand % 5 = 2 AND k % 2 = 0 THEN version + 5 WHEN brand % 5 = 3 THEN 0 ELSE version END AS version,
    subject, action, CASE WHEN brand % 5 = 1 AND k % 3 = 0 THEN 'other' ELSE decision END AS decision, priority, need_status, need_tier,
    effective_from, effective_until FROM current
  UNION ALL SELECT rule_set, 'gone-' || k, 1, subject, action, decision, priority, need_status, need_tier, effective_from, effective_until
    FROM current WHERE v = 0 AND brand % 5 = 4),
highest AS (SELECT rule_set, rule_id, max(version) AS highest FROM previous GROUP BY ALL),
diff AS (SELECT coalesce(c.rule_set, p.rule_set) AS rule_set, coalesce(c.rule_id, p.rule_id) AS rule_id, coalesce(c.version, p.version) AS version,
    c.rule_id IS NOT NULL AS now, p.rule_id IS NOT NULL AS before, c.decision IS DISTINCT FROM p.decision AS changed
  FROM current c FULL JOIN previous p ON c.rule_set = p.rule_set AND c.rule_id = p.rule_id AND c.version = p.version),
kinds AS (SELECT d.*, highest, CASE WHEN NOT now AND d.rule_id NOT IN (SELECT rule_id FROM current) THEN 'removal' WHEN NOT now THEN NULL
    WHEN before AND changed THEN 'rewrite' WHEN NOT before AND d.version <= highest THEN 'non_monotonic'
    WHEN NOT before AND highest IS NOT NULL THEN 'replacement' END AS kind
  FROM diff d LEFT JOIN highest h ON h.rule_set = d.rule_set AND h.rule_id = d.rule_id),
pending AS (SELECT rule_set, kind, rule_id || '@' || version AS rule_version,
    CASE WHEN kind = 'replacement' THEN rule_id || '@' || highest ELSE '' END AS previous_version FROM kinds
  WHERE kind IS NOT NULL AND NOT (kind IN ('replacement', 'removal') AND split_part(rule_id, '-', 2)::BIGINT % 40 < 20))"""


def publication_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current rules, the previous publication and the blocking changes."""
    sets = rule_sets(spark, folder)
    current = sets.where((F.col("v") == 0) | (F.col("brand") % 6 == 5))
    change = F.col("brand") % 5
    kept = current.withColumn(
        "decision", F.when((change == 1) & (F.col("k") % 3 == 0), "other").otherwise(F.col("decision"))
    ).withColumn(
        "version",
        F.when((change == 2) & (F.col("k") % 2 == 0), F.col("version") + 5)
        .when(change == 3, F.lit(0))
        .otherwise(F.col("version")),
    )
    gone = current.where((F.col("v") == 0) & (change == 4)).withColumn(
        "rule_id", F.concat(F.lit("gone-"), F.col("k").cast("string"))
    ).withColumn("version", F.lit(1))
    previous = kept.unionByName(gone)
    found = rules.changes(current, previous, "rule_set")
    number = F.split_part("rule_version", F.lit("-"), F.lit(2))
    reviewed = found.where(F.split_part(number, F.lit("@"), F.lit(1)).cast("bigint") % 40 < 20)
    pending = rules.pending_changes(
        found,
        reviewed.where(F.col("kind") == "replacement"),
        reviewed.where(F.col("kind") == "removal"),
        "rule_set",
    )
    return current, previous, pending


@query("rule_publication_diff", f"WITH {PUBLICATION_SQL} SELECT rule_set, kind, rule_version, previous_version FROM pending")
def rule_publication_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Changes since the previous publication that still block a release."""
    pending = publication_inputs(spark, folder)[2]
    return pending.select("rule_set", "kind", "rule_version", "previous_version")


DIGEST_SQL = """sha256(concat_ws(chr(0), rule_id, version, subject, action, decision, priority,
  concat_ws(',', 'status=' || need_status, 'tier=' || need_tier), effective_from, coalesce(effective_until::VARCHAR, 'null')))"""


@query(
    "rule_publication_status",
    f"""WITH {PUBLICATION_SQL},
    digests AS (SELECT rule_set, {DIGEST_SQL} AS h FROM current),
    ids AS ({hashing.set_digests_sql('digests', 'rule_set', 'h', 'publication_id')}),
    clash AS (SELECT a.rule_set, bool_or(a.decision <> b.decision) AS conflict FROM current a JOIN current b ON a.rule_set = b.rule_set
      AND a.subject = b.subject AND a.action = b.action AND a.priority = b.priority AND a.rule_id < b.rule_id
      AND greatest(a.effective_from, b.effective_from) <= least(coalesce(a.effective_until, date '9999-12-31'), coalesce(b.effective_until, date '9999-12-31'))
      AND (a.need_status IS NULL OR b.need_status IS NULL OR a.need_status = b.need_status)
      AND (a.need_tier IS NULL OR b.need_tier IS NULL OR a.need_tier = b.need_tier) GROUP BY a.rule_set),
    n AS (SELECT rule_set, count(*) FILTER (kind = 'rewrite') AS rw, count(*) FILTER (kind = 'non_monotonic') AS nm,
      count(*) FILTER (kind = 'replacement') AS rp, count(*) FILTER (kind = 'removal') AS rm FROM pending GROUP BY rule_set),
    o AS (SELECT i.rule_set, publication_id, conflict, coalesce(rw, 0) AS rw, coalesce(nm, 0) AS nm, coalesce(rp, 0) AS rp, coalesce(rm, 0) AS rm,
      CASE WHEN conflict IS NOT NULL THEN 'catalog_not_admitted' WHEN rw > 0 THEN 'version_rewrite_forbidden' WHEN nm > 0 THEN 'non_monotonic_version'
        WHEN rp > 0 THEN 'replacement_review_required' WHEN rm > 0 THEN 'removal_review_required' ELSE 'published' END AS code
      FROM ids i LEFT JOIN clash USING (rule_set) LEFT JOIN n USING (rule_set))
    SELECT rule_set, code, CASE WHEN code = 'published' THEN 'published' WHEN code = 'catalog_not_admitted' AND NOT conflict THEN 'review'
        WHEN code LIKE '%_review_required' THEN 'review' ELSE 'blocked' END AS status,
      CASE code WHEN 'version_rewrite_forbidden' THEN rw WHEN 'non_monotonic_version' THEN nm WHEN 'replacement_review_required' THEN rp
        WHEN 'removal_review_required' THEN rm ELSE 0 END AS affected_count,
      CASE WHEN code = 'published' THEN publication_id ELSE '' END AS publication_id FROM o""",
)
def rule_publication_status(spark: SparkSession, folder: str) -> DataFrame:
    current, _, pending = publication_inputs(spark, folder)
    ensure_checkpoint_dir(spark)
    found = rules.overlaps(current, ["rule_set"]).checkpoint()
    admissions = rules.admit(current, found, found.limit(0), "rule_set")
    return rules.publish(admissions, current, pending, "rule_set").na.fill("", ["publication_id"])


@query(
    "rule_invariants",
    f"""WITH {PUBLICATION_SQL} SELECT code, count(*) AS rules FROM (
      SELECT 'invalid_version' AS code FROM previous WHERE version < 1 UNION ALL SELECT 'unknown_decision' FROM previous WHERE decision = 'other'
      UNION ALL SELECT 'invalid_period' FROM previous WHERE effective_until < effective_from
      UNION ALL SELECT 'duplicate_version' FROM previous GROUP BY rule_set, rule_id, version HAVING count(*) > 1) GROUP BY code""",
)
def rule_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Contract breaks of the stored previous publication, counted by code."""
    previous = publication_inputs(spark, folder)[1]
    broken = rules.invariant_violations(previous, ["rule_set"])
    return broken.groupBy("code").agg(F.count(F.lit(1)).cast("bigint").alias("rules"))
