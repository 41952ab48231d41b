"""Snapshots by validity period and audits of dated references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import sizing, validity

MAX_DATES = 20_000


def snapshots(entries: DataFrame, dates: DataFrame, *, id_col: str = "document_id") -> DataFrame:
    """Entries effective on each reference date: (reference_date, id).

    Each period is cut into the months it covers, which turns the range join
    into an equi join on the month with an exact residual.  Open periods end
    with the last reference date.
    """
    last = dates.agg(F.max("reference_date").alias("d")).select("d").scalar()
    stop = F.least(validity.end_or_open(F.col("effective_until")), last)
    months = F.sequence(validity.month_of(F.col("effective_from")), validity.month_of(stop))
    covered = (
        entries.where(F.col("effective_from").isNotNull())
        .where(F.col("effective_from") <= stop)
        .select(id_col, "effective_from", "effective_until", F.explode(months).alias("month"))
    )
    wanted = dates.select("reference_date").distinct().withColumn(
        "month", validity.month_of(F.col("reference_date"))
    )
    small = sizing.fits(wanted, MAX_DATES)
    return (
        covered.join(sizing.hint(wanted, small), "month")
        .where(
            validity.effective_on(F.col("reference_date"), F.col("effective_from"), F.col("effective_until"))
        )
        .select("reference_date", id_col)
    )


def reference_conflicts(references: DataFrame, entries: DataFrame) -> DataFrame:
    """References to documents that are unknown or not valid on their date.

    ``references``: case_id, document_id, reference_date.
    """
    known = entries.select("document_id", "effective_from", "effective_until", F.lit(True).alias("known"))
    joined = references.join(known, "document_id", "left")
    day = F.col("reference_date")
    reason = (
        F.when(F.col("known").isNull(), "unknown_document")
        .when(F.col("effective_from").isNull() | (day < F.col("effective_from")), "not_yet_effective")
        .when(F.col("effective_until").isNotNull() & (day > F.col("effective_until")), "expired")
    )
    return joined.select("case_id", "document_id", "reference_date", reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def finalize_cases(cases: DataFrame, references: DataFrame, default_date: Column) -> DataFrame:
    """Approved cases with their snapshot date and number of relevant documents.

    ``cases``: case_id, category, answerable, reference_date.  An answerable
    case without a relevant document fails.
    """
    counts = references.groupBy("case_id").agg(F.count_distinct("document_id").alias("n"))
    joined = cases.join(counts, "case_id", "left")
    relevant = F.when(~F.col("answerable"), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)))
    checked = F.when(
        F.col("answerable") & (relevant == 0), F.raise_error(F.lit("a case marked answerable names no document"))
    ).otherwise(relevant)
    return joined.select(
        F.coalesce("reference_date", default_date).alias("snapshot_date"),
        "case_id",
        "category",
        checked.cast("bigint").alias("relevant_documents"),
    )
