"""Policy calibration over labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing
from evidencelake.operators import calibration, confidence, metrics
from evidencelake.plans import inputs, measurement, retrieval
from evidencelake.plans.registry import query

MIN_ACCEPTANCE = 0.8
FOLD_SEED = "evidence-folds-v1"
SPLIT_SEED = "evidence-split-v1"

RATES_SQL = """round(avg(CASE WHEN answerable THEN ok END), 9) AS answerable_acceptance,
  round(1 - avg(CASE WHEN NOT answerable THEN ok END), 9) AS unanswerable_abstention,
  round((avg(CASE WHEN answerable THEN ok END) + 1 - avg(CASE WHEN NOT answerable THEN ok END)) / 2, 9) AS balanced_accuracy"""

SWEEP_SQL = f"""sweep AS (
  SELECT t.threshold, {RATES_SQL.replace('ok', '(top_score >= t.threshold)::INT')}
  FROM (SELECT DISTINCT top_score AS threshold FROM doc_signals) t, doc_signals GROUP BY t.threshold)"""


@query("threshold_sweep", f"WITH {measurement.SIGNALS_SQL}, {SWEEP_SQL} SELECT * FROM sweep")
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.threshold_sweep(measurement.document_signals(spark, folder), "top_score")


@query(
    "policy_argmax",
    f"""WITH {measurement.SIGNALS_SQL}, {SWEEP_SQL}, ok AS (SELECT * FROM sweep WHERE answerable_acceptance >= {MIN_ACCEPTANCE})
    SELECT *, (SELECT count(*) FROM ok) AS feasible_count FROM ok
    ORDER BY unanswerable_abstention DESC, balanced_accuracy DESC, threshold LIMIT 1""",
)
def policy_argmax(spark: SparkSession, folder: str) -> DataFrame:
    sweep = calibration.threshold_sweep(measurement.document_signals(spark, folder), "top_score")
    return calibration.best_threshold(sweep, MIN_ACCEPTANCE)


def _condition_sql(signal: str, value: str) -> str:
    return f"""'{{"operator": "greater_than_or_equal", "signal": "' || {signal} || '", "threshold": ' || {value} || '}}'"""


def _grid_sql(source: str) -> str:
    """Every candidate against every case, the brute-force statement."""
    names = measurement.SIGNAL_NAMES
    levels = " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS signal, {i} AS pos, {n} AS value FROM {source} WHERE {n} IS NOT NULL"
                                for i, n in enumerate(names))
    value = "CASE {0}.signal " + " ".join(f"WHEN '{n}' THEN {n}" for n in names) + " END"
    ok1 = f"coalesce(({value.format('l')} >= l.value)::INT, 0)"
    ok2 = f"coalesce(({value.format('a')} >= a.value AND {value.format('b')} >= b.value)::INT, 0)"
    return f"""levels AS ({levels}),
candidates AS (
  SELECT 1 AS condition_count, '[' || {_condition_sql('l.signal', 'l.value')} || ']' AS conditions, {RATES_SQL.replace('ok', ok1)}
  FROM levels l, {source} GROUP BY l.signal, l.value
  UNION ALL
  SELECT 2, '[' || {_condition_sql('a.signal', 'a.value')} || ', ' || {_condition_sql('b.signal', 'b.value')} || ']',
    {RATES_SQL.replace('ok', ok2)}
  FROM levels a JOIN levels b ON a.pos < b.pos, {source} GROUP BY a.signal, a.value, b.signal, b.value)"""


@query(
    "two_signal_grid",
    f"WITH {measurement.SIGNALS_SQL}, {_grid_sql('doc_signals')} SELECT condition_count, conditions, answerable_acceptance, unanswerable_abstention, balanced_accuracy FROM candidates",
)
def two_signal_grid(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.grid(measurement.document_signals(spark, folder))


@query(
    "multisignal_policy",
    f"""WITH {measurement.SIGNALS_SQL}, {_grid_sql('doc_signals')}
    SELECT conditions, condition_count, answerable_acceptance, unanswerable_abstention, balanced_accuracy FROM candidates
    WHERE answerable_acceptance >= {MIN_ACCEPTANCE}
    ORDER BY unanswerable_abstention DESC, balanced_accuracy DESC, condition_count, conditions DESC LIMIT 1""",
)
def multisignal_policy(spark: SparkSession, folder: str) -> DataFrame:
    cases = measurement.document_signals(spark, folder)
    return calibration.best_conjunction(calibration.grid(cases, min_acceptance=MIN_ACCEPTANCE), MIN_ACCEPTANCE)


FOLDS_SQL = f"""folded AS (SELECT *, (row_number() OVER (PARTITION BY answerable
  ORDER BY sha256('{FOLD_SEED}' || chr(0) || doc_id)) - 1) % 5 AS fold FROM doc_signals)"""


@query("kfold_assignment", f"WITH {measurement.SIGNALS_SQL}, {FOLDS_SQL} SELECT doc_id, answerable, fold FROM folded")
def kfold_assignment(spark: SparkSession, folder: str) -> DataFrame:
    folded = calibration.folds(measurement.document_signals(spark, folder), "doc_id", 5, FOLD_SEED)
    return folded.select("doc_id", "answerable", "fold")


def _cross_sql() -> str:
    """Every candidate against every training case of every fold, then the best ones on the cases held out."""
    names = measurement.SIGNAL_NAMES
    levels = " UNION ALL ".join(
        f"SELECT DISTINCT hold, '{n}' AS signal, {i} AS pos, {n} AS value FROM train WHERE {n} IS NOT NULL" for i, n in enumerate(names)
    )
    value = "CASE {0} " + " ".join(f"WHEN '{n}' THEN {n}" for n in names) + " END"
    met = lambda signal, bound: f"coalesce(({value.format(signal)} >= {bound})::INT, 0)"
    both = f"({met('a.signal', 'a.value')} * {met('b.signal', 'b.value')})"
    return f"""train AS (SELECT h.fold AS hold, c.* FROM folded c, (SELECT DISTINCT fold FROM folded) h WHERE c.fold <> h.fold),
levels AS ({levels}),
candidates AS (
  SELECT l.hold, 1 AS n, '[' || {_condition_sql('l.signal', 'l.value')} || ']' AS conditions, l.signal AS s1, l.value AS v1,
    NULL AS s2, NULL AS v2, {RATES_SQL.replace('ok', met('l.signal', 'l.value'))}
  FROM levels l JOIN train t ON t.hold = l.hold GROUP BY l.hold, l.signal, l.value
  UNION ALL
  SELECT a.hold, 2, '[' || {_condition_sql('a.signal', 'a.value')} || ', ' || {_condition_sql('b.signal', 'b.value')} || ']',
    a.signal, a.value, b.signal, b.value, {RATES_SQL.replace('ok', both)}
  FROM levels a JOIN levels b ON a.hold = b.hold AND a.pos < b.pos JOIN train t ON t.hold = a.hold
  GROUP BY a.hold, a.signal, a.value, b.signal, b.value),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hold ORDER BY unanswerable_abstention DESC, balanced_accuracy DESC, n, conditions DESC) AS r
  FROM candidates WHERE answerable_acceptance >= {MIN_ACCEPTANCE}) WHERE r = 1),
predicted AS (SELECT f.fold, f.answerable, {met('s1', 'v1')} * CASE WHEN s2 IS NULL THEN 1 ELSE {met('s2', 'v2')} END AS ok
  FROM folded f JOIN chosen c ON c.hold = f.fold)
SELECT fold, count(*) AS case_count, {RATES_SQL} FROM predicted GROUP BY fold
UNION ALL SELECT -1, count(*), {RATES_SQL} FROM predicted"""


@query("cross_validated_policy", f"WITH {measurement.SIGNALS_SQL}, {FOLDS_SQL}, {_cross_sql()}")
def cross_validated_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Micro-pooled metrics of five held-out folds, one row per fold and overall."""
    predicted = calibration.cross_validate(
        measurement.document_signals(spark, folder), "doc_id", fold_count=5, seed=FOLD_SEED, min_acceptance=MIN_ACCEPTANCE
    )
    per_fold = calibration.prediction_metrics(predicted, ["fold"])
    overall = calibration.prediction_metrics(predicted).withColumn("fold", F.lit(-1).cast("bigint"))
    return per_fold.unionByName(overall)


SPLIT_SQL = f"""cases0 AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'answerable' WHEN toxic = 1 THEN 'insufficient_evidence'
    ELSE 'candidate_unanswerable' END AS answerability, toxic = 1 AND quality = 1 AS forced FROM labels),
cases1 AS (SELECT *, CASE WHEN answerability = 'answerable' THEN 'answerable' ELSE 'unanswerable' END AS stratum FROM cases0),
free AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{SPLIT_SEED}' || chr(0) || doc_id)) AS r,
  count(*) OVER (PARTITION BY stratum) AS n FROM cases1 WHERE NOT forced),
assigned AS (SELECT doc_id, answerability, CASE WHEN r <= CASE WHEN n = 1 THEN 1
    ELSE least(n - 1, greatest(1, floor(n * 0.6 + 0.5))) END THEN 'calibration' ELSE 'evaluation' END AS partition FROM free
  UNION ALL SELECT doc_id, answerability, 'calibration' FROM cases1 WHERE forced)"""


def review_cases(spark: SparkSession, folder: str) -> DataFrame:
    labels = inputs.table(spark, folder, "labels")
    return labels.select(
        "doc_id",
        F.when(F.col("quality") == 1, "answerable")
        .when(F.col("toxic") == 1, "insufficient_evidence")
        .otherwise("candidate_unanswerable")
        .alias("answerability"),
        ((F.col("toxic") == 1) & (F.col("quality") == 1)).alias("earlier"),
    )


def case_split(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.split(
        review_cases(spark, folder), "doc_id", "answerability", fraction=0.6, seed=SPLIT_SEED, forced=F.col("earlier")
    )


@query("hash_stratified_split", f"WITH {SPLIT_SQL} SELECT doc_id, answerability, partition FROM assigned")
def hash_stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return case_split(spark, folder).select("doc_id", "answerability", "partition")


@query(
    "split_drift_check",
    f"""WITH {SPLIT_SQL}, drifted AS (SELECT doc_id FROM documents WHERE lang <> 'es'),
    ids AS (SELECT doc_id, count(*) AS copies, count(DISTINCT partition) AS parts FROM assigned GROUP BY doc_id)
    SELECT reason, count(*) AS cases FROM (
      SELECT CASE WHEN i.doc_id IS NULL THEN 'omitted' WHEN d.doc_id IS NULL THEN 'unknown' WHEN parts > 1 THEN 'overlap'
        WHEN copies > 1 THEN 'repeated' END AS reason
      FROM ids i FULL JOIN drifted d ON i.doc_id = d.doc_id) WHERE reason IS NOT NULL GROUP BY reason""",
)
def split_drift_check(spark: SparkSession, folder: str) -> DataFrame:
    """The split of the labels against a source that has moved on since."""
    drifted = inputs.table(spark, folder, "documents").where(F.col("lang") != "es").select("doc_id")
    found = calibration.split_violations(case_split(spark, folder), drifted, "doc_id")
    return found.groupBy("reason").agg(F.count(F.lit(1)).cast("bigint").alias("cases"))


@query(
    "split_fingerprint",
    f"""WITH {SPLIT_SQL}, h AS (SELECT sha256(doc_id || chr(0) || answerability) AS h FROM cases0)
    SELECT rows AS case_count, fingerprint FROM ({hashing.set_digests_sql('h', '', 'h', 'fingerprint')})""",
)
def split_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint that detects any change of an id or label."""
    return calibration.label_fingerprint(review_cases(spark, folder), "doc_id", "answerability")


@query(
    "heldout_summary",
    f"""WITH {inputs.bm25_sql()}, {inputs.SIGNALS_SQL}, {inputs.RELEVANCE_SQL},
    c AS (SELECT s.query_id, s.query_id IN (SELECT query_id FROM rel) AS answerable,
      result_count > 0 AND top_score >= {retrieval.THRESHOLD} AS accepted,
      EXISTS (SELECT 1 FROM top t JOIN rel r ON r.query_id = t.query_id AND r.chunk_id = t.chunk_id WHERE t.query_id = s.query_id) AS hit
      FROM signals s)
    SELECT count(*) AS case_count, count(*) FILTER (answerable) AS answerable_count, count(*) FILTER (NOT answerable) AS unanswerable_count,
      round(avg(CASE WHEN answerable THEN accepted::INT END), 6) AS answerable_acceptance,
      round(avg(CASE WHEN NOT answerable THEN (NOT accepted)::INT END), 6) AS unanswerable_abstention,
      round((avg(CASE WHEN answerable THEN accepted::INT END) + avg(CASE WHEN NOT answerable THEN (NOT accepted)::INT END)) / 2, 6) AS balanced_accuracy,
      round(avg(CASE WHEN answerable THEN hit::INT END), 6) AS retrieval_hit_rate,
      round(avg(CASE WHEN answerable AND accepted THEN hit::INT END), 6) AS accepted_answerable_hit_rate,
      round(avg(CASE WHEN answerable THEN (accepted AND hit)::INT END), 6) AS answerable_accepted_and_hit_rate,
      round(1 - avg(CASE WHEN NOT answerable THEN (NOT accepted)::INT END), 6) AS unsafe_acceptance_rate FROM c""",
)
def heldout_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Frozen threshold on the questions: acceptance, abstention and hits."""
    asked = inputs.questions(spark, folder)
    ranked, facts = retrieval.ranked_with_documents(spark, folder)
    rows = metrics.outcomes(ranked, inputs.relevance(spark, folder), asked)
    decided = confidence.gate(confidence.signals(ranked, facts), retrieval.THRESHOLD)
    cases = rows.join(decided.select("query_id", "status"), "query_id").select(
        "answerable",
        (F.col("status") == "ready").alias("accepted"),
        F.coalesce("hit", F.lit(False)).alias("hit"),
    )
    return calibration.heldout_summary(cases)
