"""Exact order statistics without a single-task sort.

Values are first merged to distinct ones, so a value shared by a third of all
rows is a single row.  Distinct values are spread over order-preserving buckets
computed from the value itself; windows run per bucket and the bucket totals
supply the offsets.  Buckets only balance the work, they never change a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOLUTION = 256


def _bucket(value: Column) -> Column:
    """Monotone bucket: a fixed number of steps per factor of e.

    At most some ten thousand buckets cover the whole double range that scores
    and lengths use.
    """
    steps = F.floor(F.log1p(F.abs(value)) * RESOLUTION).cast("int")
    return F.when(value < 0, -steps).otherwise(steps)


def histogram(df: DataFrame, value: str, weights: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Sum ``weights`` per group and distinct value."""
    return df.where(F.col(value).isNotNull()).groupBy(*(by or []), value).agg(
        *[F.sum(weight).alias(name) for name, weight in weights.items()]
    )


def cumulate(hist: DataFrame, value: str, names: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``<name>_through`` (running sum up to the value) and ``<name>_total``."""
    by = by or []
    spread = hist.withColumn("bucket", _bucket(F.col(value)))
    within = Window.partitionBy(*by, "bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = spread.select(
        *hist.columns, "bucket", *[F.sum(n).over(within).alias(f"{n}_local") for n in names]
    )
    totals = spread.groupBy(*by, "bucket").agg(*[F.sum(n).alias(f"{n}_sum") for n in names])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "bucket",
        *[F.coalesce(F.sum(f"{n}_sum").over(before), F.lit(0)).alias(f"{n}_offset") for n in names],
        *[F.sum(f"{n}_sum").over(group).alias(f"{n}_total") for n in names],
    )
    return local.join(offsets, [*by, "bucket"]).select(
        *hist.columns,
        *[(F.col(f"{n}_local") + F.col(f"{n}_offset")).alias(f"{n}_through") for n in names],
        *[f"{n}_total" for n in names],
    )


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, min, median, mean and max per group; NULL values do not count."""
    hist = histogram(df, value, {"n": F.lit(1)}, by)
    runs = cumulate(hist, value, ["n"], by)
    low = F.col("n_through") * 2 >= F.col("n_total")
    high = F.col("n_through") >= F.floor(F.col("n_total") / 2) + 1
    return runs.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("count"),
        F.min(value).alias("min"),
        ((F.min(F.when(low, F.col(value))) + F.min(F.when(high, F.col(value)))) / 2).alias("median"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"),
        F.max(value).alias("max"),
    )


def nearest_rank(value: str, fraction: float) -> Column:
    """Aggregate: the value at rank ``ceil(n * fraction)`` of a cumulated histogram."""
    reached = F.col("n_through") >= F.greatest(F.lit(1), F.ceil(F.round(F.col("n_total") * fraction, 6)))
    return F.min(F.when(reached, F.col(value)))


def superiority(df: DataFrame, value: str, positive: Column, by: list[str]) -> DataFrame:
    """Share of (positive, negative) pairs the positive wins, ties counting half.

    Rank-sum form: no pair is ever formed.
    """
    hist = histogram(
        df, value, {"pos": F.when(positive, 1).otherwise(0), "neg": F.when(positive, 0).otherwise(1)}, by
    )
    runs = cumulate(hist, value, ["pos", "neg"], by)
    below = F.col("neg_through") - F.col("neg")
    return runs.groupBy(*by).agg(
        (
            F.sum(F.col("pos") * (below + F.col("neg") * 0.5)) / (F.max("pos_total") * F.max("neg_total"))
        ).alias("rate"),
        F.max("pos_total").cast("bigint").alias("positives"),
        F.max("neg_total").cast("bigint").alias("negatives"),
    )


def hash_rank(df: DataFrame, id_col: str, stratum: str, seed: str, *, digits: int = 3) -> DataFrame:
    """Zero-based rank of each id by seeded SHA-256 inside its stratum.

    The leading hex digits of the digest are a uniform, order-preserving bucket,
    so a stratum of any size is ranked by many tasks.
    """
    digest = F.sha2(F.encode(F.concat(F.lit(seed + "\0"), F.col(id_col).cast("string")), "utf-8"), 256)
    keyed = df.withColumn("digest", digest).withColumn("prefix", F.left("digest", F.lit(digits)))
    inside = Window.partitionBy(stratum, "prefix").orderBy("digest")
    ranked = keyed.withColumn("local", F.row_number().over(inside) - 1)
    counts = keyed.groupBy(stratum, "prefix").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(stratum)
    before = whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        stratum,
        "prefix",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(whole).alias("stratum_size"),
    )
    return (
        ranked.join(offsets, [stratum, "prefix"])
        .withColumn("position", F.col("local") + F.col("offset"))
        .drop("local", "offset", "prefix", "digest")
    )
