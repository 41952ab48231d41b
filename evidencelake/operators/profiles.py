"""Content-free size profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import stats


def length_profile(rows: DataFrame, length: str, by: str, fractions: dict[str, float], limit: int | None = None) -> DataFrame:
    """count, total, min, mean, nearest-rank percentiles and max, overall and by group.

    Everything is read from the histogram of (group, length); the overall row
    comes from the same histogram, not from a second pass over the rows.
    """
    hist = rows.select(F.col(by).alias("group"), F.col(length).cast("double").alias("size")).groupBy(
        "group", "size"
    ).agg(F.count(F.lit(1)).alias("n"))
    both = hist.select(
        F.explode(F.array(F.col("group"), F.lit("all"))).alias("name"), "size", "n"
    ).groupBy("name", "size").agg(F.sum("n").alias("n"))
    runs = stats.cumulate(both, "size", ["n"], ["name"])
    extra = []
    if limit is not None:
        over = F.sum(F.when(F.col("size") > limit, F.col("n")).otherwise(0))
        extra = [
            over.cast("bigint").alias("truncated_count"),
            F.round(over / F.sum("n"), 6).alias("truncated_rate"),
        ]
    return runs.groupBy("name").agg(
        F.sum("n").cast("bigint").alias("count"),
        F.sum(F.col("size") * F.col("n")).cast("bigint").alias("total"),
        F.min("size").cast("bigint").alias("min"),
        F.round(F.sum(F.col("size") * F.col("n")) / F.sum("n"), 2).alias("mean"),
        *[stats.nearest_rank("size", f).cast("bigint").alias(n) for n, f in fractions.items()],
        F.max("size").cast("bigint").alias("max"),
        *extra,
    )


def extraction_status(suffix: Column, elements: Column, pages: Column, used_ocr: Column, failed: Column) -> Column:
    """Outcome of profiling one file; ``failed`` is NULL, error or ocr_error."""
    return (
        F.when(failed.isNotNull(), failed)
        .when((elements > 0) & used_ocr, "ocr_extracted")
        .when(elements > 0, "extracted")
        .when((suffix == ".pdf") & (pages > 0), "needs_ocr")
        .when(suffix == ".pdf", "empty_document")
        .otherwise("empty")
    )
