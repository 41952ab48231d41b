"""Abstention policies: threshold sweep, signal grid, folds and splits.

Candidates are never evaluated against every case.  Cases are merged to distinct
signal values first and candidate metrics are read from running totals.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import hashing, stats

#: Parts in which the levels of one signal pair meet.
GRID_SALTS = 16
SIGNALS = ("top_score", "normalized_margin", "query_coverage", "rare_query_coverage")


def _flags() -> dict[str, Column]:
    return {"pos": F.when(F.col("answerable"), 1).otherwise(0), "neg": F.when(F.col("answerable"), 0).otherwise(1)}


def _rates() -> list[Column]:
    acceptance = F.col("accepted_pos") / F.col("pos_total")
    abstention = 1 - F.col("accepted_neg") / F.col("neg_total")
    return [
        F.round(acceptance, 9).alias("answerable_acceptance"),
        F.round(abstention, 9).alias("unanswerable_abstention"),
        F.round((acceptance + abstention) / 2, 9).alias("balanced_accuracy"),
    ]


def threshold_sweep(cases: DataFrame, signal: str, by: list[str] | None = None) -> DataFrame:
    """Metrics of accepting ``signal >= threshold`` for every distinct value."""
    by = by or []
    hist = stats.histogram(cases, signal, _flags(), by)
    runs = stats.cumulate(hist, signal, ["pos", "neg"], by)
    return (
        runs.withColumn("accepted_pos", F.col("pos_total") - F.col("pos_through") + F.col("pos"))
        .withColumn("accepted_neg", F.col("neg_total") - F.col("neg_through") + F.col("neg"))
        .select(*by, F.col(signal).alias("threshold"), *_rates())
    )


def best_threshold(sweep: DataFrame, min_acceptance: float, by: list[str] | None = None) -> DataFrame:
    """Feasible threshold with most abstention, then balance, then the lowest."""
    if not 0 < min_acceptance <= 1:
        raise ValueError("min_acceptance is a share: above 0, at most 1")
    by = by or []
    key = F.struct("unanswerable_abstention", "balanced_accuracy", (-F.col("threshold")).alias("low"))
    row = F.struct("threshold", "answerable_acceptance", "unanswerable_abstention", "balanced_accuracy")
    picked = sweep.where(F.col("answerable_acceptance") >= min_acceptance).groupBy(*by).agg(
        F.max_by(row, key).alias("best"), F.count(F.lit(1)).cast("bigint").alias("feasible_count")
    )
    return picked.select(*by, "best.*", "feasible_count").where(F.col("threshold").isNotNull())


def _condition_json(signal: Column, threshold: Column) -> Column:
    """One condition as sorted-key JSON text, the last tie-breaker of a grid."""
    return F.concat(
        F.lit('{"operator": "greater_than_or_equal", "signal": "'),
        signal,
        F.lit('", "threshold": '),
        threshold.cast("string"),
        F.lit("}"),
    )


def _accepted_by_level(cases: DataFrame, signals: tuple[str, ...], by: list[str]) -> DataFrame:
    """Accepted cases of both classes for every signal value as a threshold."""
    long = cases.unpivot([*by, "answerable"], list(signals), "signal", "value")
    totals = cases.groupBy(*by).agg(*[F.sum(c).alias(f"{n}_all") for n, c in _flags().items()])
    hist = stats.histogram(long, "value", _flags(), [*by, "signal"])
    runs = stats.cumulate(hist, "value", ["pos", "neg"], [*by, "signal"])
    # a missing signal never satisfies a condition but stays in the totals
    accepted = runs.withColumn(
        "accepted_pos", F.col("pos_total") - F.col("pos_through") + F.col("pos")
    ).withColumn("accepted_neg", F.col("neg_total") - F.col("neg_through") + F.col("neg"))
    return _with_totals(accepted.drop("pos_total", "neg_total"), totals, by)


def _single_candidates(cases: DataFrame, signals: tuple[str, ...], by: list[str]) -> DataFrame:
    return _accepted_by_level(cases, signals, by).select(
        *by,
        F.lit(1).alias("condition_count"),
        F.concat(F.lit("["), _condition_json(F.col("signal"), F.col("value")), F.lit("]")).alias("conditions"),
        *_rates(),
    )


def _with_totals(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    renamed = totals.withColumnRenamed("pos_all", "pos_total").withColumnRenamed("neg_all", "neg_total")
    if by:
        return rows.join(renamed, by)
    return rows.select(
        "*",
        renamed.select("pos_total").scalar().alias("pos_total"),
        renamed.select("neg_total").scalar().alias("neg_total"),
    )


def _pair_candidates(
    cases: DataFrame, signals: tuple[str, ...], by: list[str], min_acceptance: float | None = None
) -> DataFrame:
    """Dominance counts of the two-signal grid by running sums along both axes.

    Cases collapse to distinct value pairs.  The grid of a pair is the product
    of its levels by definition; levels that alone accept too few positives, and
    so can be in no feasible pair, are left out where ``min_acceptance`` is given.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("first"), F.lit(b).alias("second"),
                F.col(a).alias("left"), F.col(b).alias("right"),
            )
            for a, b in combinations(signals, 2)
        ]
    )
    cells = (
        cases.select(*by, "answerable", F.inline(pairs))
        .groupBy(*by, "first", "second", "left", "right")
        .agg(*[F.sum(c).alias(n) for n, c in _flags().items()])
    )
    key = [*by, "first", "second"]
    if min_acceptance is not None:
        cells = _lowered(cells, cases, signals, by, min_acceptance)
    salts = F.explode(F.sequence(F.lit(0), F.lit(GRID_SALTS - 1)))
    rights = cells.where(F.col("right").isNotNull()).select(*key, "right").distinct().withColumn("salt", salts)
    lefts = cells.where(F.col("left").isNotNull()).select(*key, "left").distinct()
    lefts = lefts.withColumn("salt", F.pmod(F.xxhash64("left"), F.lit(GRID_SALTS)).cast("int"))
    grid = lefts.join(rights, [*key, "salt"]).select(*key, "left", "right", F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    held = cells.where(F.col("left").isNotNull() & F.col("right").isNotNull())
    dense = grid.unionByName(held.select(*grid.columns)).groupBy(*key, "left", "right").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    along_right = Window.partitionBy(*key, "left").orderBy(F.desc("right")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    along_left = Window.partitionBy(*key, "right").orderBy(F.desc("left")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    swept = dense.select(
        *key, "left", "right",
        F.sum("pos").over(along_right).alias("pos"), F.sum("neg").over(along_right).alias("neg"),
    ).select(
        *key, "left", "right",
        F.sum("pos").over(along_left).alias("accepted_pos"), F.sum("neg").over(along_left).alias("accepted_neg"),
    )
    totals = cases.groupBy(*by).agg(*[F.sum(c).alias(f"{n}_all") for n, c in _flags().items()])
    return _with_totals(swept, totals, by).select(
        *by,
        F.lit(2).alias("condition_count"),
        F.concat(
            F.lit("["), _condition_json(F.col("first"), F.col("left")), F.lit(", "),
            _condition_json(F.col("second"), F.col("right")), F.lit("]"),
        ).alias("conditions"),
        *_rates(),
    )


def _lowered(
    cells: DataFrame, cases: DataFrame, signals: tuple[str, ...], by: list[str], min_acceptance: float
) -> DataFrame:
    """Cells with values above the highest feasible threshold of their signal lowered to it.

    A pair accepts no more positives than either of its conditions, so a
    threshold that is infeasible alone is in no feasible pair; what lies above
    the highest feasible one is accepted by every threshold that is left.
    """
    accepted = _accepted_by_level(cases, signals, by).where(
        F.round(F.col("accepted_pos") / F.col("pos_total"), 9) >= min_acceptance
    )
    highest = accepted.groupBy(*by, "signal").agg(F.max("value").alias("highest"))
    for side, value in (("first", "left"), ("second", "right")):
        bound = highest.withColumnRenamed("signal", side)
        cells = cells.join(bound, [*by, side]).withColumn(value, F.when(F.col(value).isNotNull(), F.least(value, "highest"))).drop("highest")
    return cells.groupBy(*by, "first", "second", "left", "right").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def grid(
    cases: DataFrame,
    signals: tuple[str, ...] = SIGNALS,
    by: list[str] | None = None,
    *,
    min_acceptance: float | None = None,
) -> DataFrame:
    """All one- and two-condition candidates with their metrics; with ``min_acceptance`` at least all that reach it."""
    by = by or []
    return _single_candidates(cases, signals, by).unionByName(_pair_candidates(cases, signals, by, min_acceptance))


def best_conjunction(candidates: DataFrame, min_acceptance: float, by: list[str] | None = None) -> DataFrame:
    """Safest feasible candidate; ties: balance, fewer conditions, JSON text."""
    by = by or []
    key = F.struct(
        "unanswerable_abstention", "balanced_accuracy", (-F.col("condition_count")).alias("few"), "conditions"
    )
    row = F.struct(
        "conditions", "condition_count", "answerable_acceptance", "unanswerable_abstention", "balanced_accuracy"
    )
    return (
        candidates.where(F.col("answerable_acceptance") >= min_acceptance)
        .groupBy(*by)
        .agg(F.max_by(row, key).alias("best"))
        .select(*by, "best.*")
    )


def accepts(conditions: Column, case_signals: dict[str, Column]) -> Column:
    """Whether a case meets every condition of a policy given as JSON text."""
    parsed = F.from_json(conditions, "array<struct<signal:string,operator:string,threshold:double>>")
    values = F.create_map(*[x for name, value in case_signals.items() for x in (F.lit(name), value)])
    return F.forall(
        parsed,
        lambda c: F.coalesce(
            (c["operator"] == "greater_than_or_equal") & (F.try_element_at(values, c["signal"]) >= c["threshold"]),
            F.lit(False),
        ),
    )


def folds(cases: DataFrame, id_col: str, fold_count: int, seed: str) -> DataFrame:
    """Stratified folds: digest rank inside the class modulo the fold count."""
    if fold_count < 2:
        raise ValueError(f"fold_count is {fold_count}; folds need a rest to train on")
    ranked = stats.hash_rank(cases, id_col, "answerable", seed)
    return ranked.withColumn("fold", (F.col("position") % fold_count).cast("bigint")).drop(
        "position", "stratum_size"
    )


def training_sets(folded: DataFrame, fold_count: int) -> DataFrame:
    """Each case once for every fold it trains (all but its own)."""
    others = F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.lit(fold_count - 1).cast("bigint")), lambda f: f != F.col("fold")
    )
    return folded.withColumn("training_fold", F.explode(others))


def cross_validate(
    cases: DataFrame,
    id_col: str,
    *,
    fold_count: int,
    seed: str,
    min_acceptance: float,
    signals: tuple[str, ...] = SIGNALS,
) -> DataFrame:
    """Predictions of every case by the policy trained without its fold."""
    folded = folds(cases, id_col, fold_count, seed)
    policies = best_conjunction(
        grid(training_sets(folded, fold_count).drop("fold"), signals, ["training_fold"], min_acceptance=min_acceptance),
        min_acceptance,
        ["training_fold"],
    ).select(F.col("training_fold").alias("fold"), "conditions", "condition_count")
    # one policy row per fold
    return folded.join(F.broadcast(policies), "fold").withColumn(
        "accepted", accepts(F.col("conditions"), {s: F.col(s) for s in signals})
    )


def prediction_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Acceptance, abstention and their mean from (answerable, accepted)."""
    counted = predictions.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).cast("bigint").alias("case_count"),
        F.count_if("answerable").alias("pos_total"),
        F.count_if(~F.col("answerable")).alias("neg_total"),
        F.count_if(F.col("answerable") & F.col("accepted")).alias("accepted_pos"),
        F.count_if(~F.col("answerable") & F.col("accepted")).alias("accepted_neg"),
    )
    return counted.select(*(by or []), "case_count", *_rates())


def split(
    cases: DataFrame,
    id_col: str,
    label: str,
    *,
    fraction: float,
    seed: str,
    forced: Column | None = None,
) -> DataFrame:
    """Hash-ranked split per answerability stratum; forced ids are calibration."""
    if not 0 < fraction < 1:
        raise ValueError("fraction is a share strictly between 0 and 1")
    if not seed.strip():
        raise ValueError("give the split a seed")
    stratum = F.when(F.col(label) == "answerable", "answerable").otherwise("unanswerable")
    marked = cases.withColumn("stratum", stratum).withColumn(
        "forced", F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    )
    free = stats.hash_rank(marked.where(~F.col("forced")), id_col, "stratum", seed)
    size = F.col("stratum_size")
    quota = F.when(size == 1, F.lit(1)).otherwise(
        F.least(size - 1, F.greatest(F.lit(1), F.floor(size * fraction + 0.5)))
    )
    assigned = free.withColumn(
        "partition", F.when(F.col("position") < quota, "calibration").otherwise("evaluation")
    ).drop("position", "stratum_size")
    return assigned.unionByName(marked.where("forced").withColumn("partition", F.lit("calibration")))


def split_violations(assignment: DataFrame, cases: DataFrame, id_col: str) -> DataFrame:
    """Overlap, repeats, omissions and unknown ids of a stored split."""
    per_id = assignment.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("partition").alias("partitions")
    )
    known = cases.select(id_col).distinct().withColumn("known", F.lit(True))
    joined = per_id.join(known, id_col, "full")
    reason = (
        F.when(F.col("rows").isNull(), "omitted")
        .when(F.col("known").isNull(), "unknown")
        .when(F.col("partitions") > 1, "overlap")
        .when(F.col("rows") > 1, "repeated")
    )
    return joined.select(id_col, reason.alias("reason")).where(F.col("reason").isNotNull())


def label_fingerprint(cases: DataFrame, id_col: str, label: str) -> DataFrame:
    """Fingerprint of all (id, label) pairs that reveals any drift."""
    pair = F.sha2(F.encode(hashing.nul_join(F.col(id_col).cast("string"), F.col(label)), "utf-8"), 256)
    return hashing.set_digests(cases.select(pair.alias("h")), [], "h", "fingerprint").withColumnRenamed("rows", "case_count")


def heldout_summary(cases: DataFrame) -> DataFrame:
    """Report of a frozen policy: (answerable, accepted, hit) per case."""
    a, ok, hit = F.col("answerable"), F.col("accepted"), F.col("hit")
    counted = cases.agg(
        F.count(F.lit(1)).cast("bigint").alias("case_count"),
        F.count_if(a).cast("bigint").alias("answerable_count"),
        F.count_if(~a).cast("bigint").alias("unanswerable_count"),
        F.count_if(a & ok).alias("taken"),
        F.count_if(a & hit).alias("hits"),
        F.count_if(a & ok & hit).alias("taken_hits"),
        F.count_if(~a & ~ok).alias("refused"),
    )
    n, u = F.col("answerable_count"), F.col("unanswerable_count")
    abstention = F.col("refused") / u
    return counted.select(
        "case_count",
        "answerable_count",
        "unanswerable_count",
        F.round(F.col("taken") / n, 6).alias("answerable_acceptance"),
        F.round(abstention, 6).alias("unanswerable_abstention"),
        F.round((F.col("taken") / n + abstention) / 2, 6).alias("balanced_accuracy"),
        F.round(F.col("hits") / n, 6).alias("retrieval_hit_rate"),
        F.round(F.when(F.col("taken") > 0, F.col("taken_hits") / F.col("taken")), 6).alias("accepted_answerable_hit_rate"),
        F.round(F.col("taken_hits") / n, 6).alias("answerable_accepted_and_hit_rate"),
        F.round(1 - abstention, 6).alias("unsafe_acceptance_rate"),
    )
