"""Size-checked broadcasts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ROWS = 500_000
#: Written out as JSON; a broadcast is held in memory by every executor.
DEFAULT_BYTES = 128 * 1024 * 1024


def fits(df: DataFrame, max_rows: int = DEFAULT_ROWS, max_bytes: int = DEFAULT_BYTES) -> bool:
    """Prove that ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes, whatever the width of its rows."""
    width = F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    row = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return row.n <= max_rows and row["size"] <= max_bytes


def hint(df: DataFrame, proven: bool) -> DataFrame:
    """Broadcast only what a check has proven small; otherwise leave it to AQE."""
    return F.broadcast(df) if proven else df


#: Rows of one key that a task takes; keys with more are dealt to as many parts as they need.
PART_ROWS = 50_000


def deal_hot_keys(asked: DataFrame, offered: DataFrame, keys: list[str], spread: list[str], *, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Add ``part`` to both sides of a join on ``keys``.

    Keys are counted.  Rows asked under a key of more than ``part_rows`` are dealt to parts by the columns of
    ``spread``, and what is offered under it is repeated for each part; all other keys stay in part 0, once.  There
    are at most ``count / part_rows`` hot keys.
    """
    hot = asked.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > part_rows)
    hot = hot.select(*keys, F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = asked.join(hot, keys, "left").withColumn("part", F.pmod(F.xxhash64(*spread), parts).cast("int"))
    repeated = offered.join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_parts"), repeated.drop("_parts")


#: Hash buckets that rows are counted by before any key is: so many numbers a task at most.
BUCKETS = 65_536


def hot_parts(asked: DataFrame, keys: list[str], part_rows: int = PART_ROWS) -> DataFrame | None:
    """keys, _parts: into how many parts each key of more than ``part_rows`` rows is dealt; None where there is no such key.

    Rows are counted by hash buckets where they are read, and only keys of buckets that are as full are counted
    themselves, so where no key is hot next to nothing is moved.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    filled = asked.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows)
    full = filled.select("_bucket").collect()  # no more than there are buckets
    if not full:
        return None
    held = asked.sparkSession.createDataFrame(full, "_bucket long")
    inside = asked.select(*keys, bucket.alias("_bucket")).join(F.broadcast(held), "_bucket", "left_semi")
    counted = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows)
    hot = counted.select(*keys, F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))
    return None if hot.isEmpty() else hint(hot, fits(hot))


#: Bits of a sieve, and those in one row of it: a sieve is 1 MB whatever it was made of.
SIEVE_BITS, ROW_BITS = 1 << 23, 1 << 15


def _place(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))


@dataclass(frozen=True)
class Sieve:
    """Rows of bits, one for the hash of every value it was made of."""

    rows: DataFrame
    empty: bool


def sieves(rows: DataFrame, *columns: str) -> list[Sieve]:
    """The sieve of each column, all made in one pass where the rows are read; see ``sifted``."""
    each = [F.struct(F.lit(i).alias("which"), _place(F.col(c)).alias("place")) for i, c in enumerate(columns)]
    known = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), x) for c, x in zip(columns, each)]))
    words = rows.select(F.inline(known)).groupBy("which", F.expr("shiftright(place, 6)").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits")
    ).toArrow()
    bits = np.zeros((len(columns), SIEVE_BITS // 64), dtype=np.int64)
    bits[words["which"].to_numpy(), words["word"].to_numpy()] = words["bits"].to_numpy()
    made = []
    for held in bits.reshape(len(columns), -1, ROW_BITS // 64):
        filled = [(i, row.tolist()) for i, row in enumerate(held) if row.any()]
        made.append(Sieve(rows.sparkSession.createDataFrame(filled, "_row long, _bits array<long>"), not filled))
    return made


def sifted(rows: DataFrame, column: str, by: Sieve, flag: str | None = None) -> DataFrame:
    """Rows whose value may be one of the sieve's: all that are, and some others.  With ``flag`` all rows, so marked."""
    place = _place(F.col(column))
    bit = F.getbit(F.element_at("_bits", (F.shiftright(place, 6) % (ROW_BITS // 64) + 1).cast("int")), (place % 64).cast("int"))
    met = (F.shiftright(place, 15) == F.col("_row")) & (bit == 1)
    if flag is None:
        return rows.join(F.broadcast(by.rows), met, "left_semi")
    return rows.join(F.broadcast(by.rows), met, "left").withColumn(flag, F.col("_row").isNotNull()).drop("_row", "_bits")
