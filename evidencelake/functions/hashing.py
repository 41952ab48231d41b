"""Content-derived identities."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\0"


def nul_join(*parts: Column) -> Column:
    """Join parts with NUL so that no concatenation is ambiguous."""
    return F.concat_ws(NUL, *parts)


def short_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the first 16 hex digits of the digest of the parts."""
    digest = F.sha2(F.encode(nul_join(*parts), "utf-8"), 256)
    return F.concat(F.lit(prefix + "-"), F.left(digest, F.lit(16)))


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the UTF-8 text."""
    return F.sha2(F.encode(text, "utf-8"), 256)


def json_text(value: Column) -> Column:
    """Quote a string the way a compact JSON encoder keeps non-ASCII text."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    # '{"v":' ... '}'
    return F.when(value.isNull(), F.lit("null")).otherwise(
        F.substring(wrapped, F.lit(6), F.length(wrapped) - F.lit(6))
    )


def canonical_hash(payload: object) -> str:
    """Digest of one small artifact: sorted keys, compact, non-ASCII kept."""
    rendered = json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(rendered.encode()).hexdigest()


#: Leading hex digits of the row digests that name a bucket of a set: 4,096 buckets.
BUCKET_DIGITS = 3


def set_digests(rows: DataFrame, by: list[str], digest: str, out: str) -> DataFrame:
    """Identity of each set of rows, independent of their order, repeats included.

    The sorted row digests of a bucket are digested, then the sorted bucket
    digests; no set of rows is gathered as a whole, and sets differ unless the
    digest itself collides.
    """
    bucket = F.left(F.col(digest), F.lit(BUCKET_DIGITS)).alias("bucket")
    inner = rows.groupBy(*by, bucket).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(digest)), "-"), 256).alias("part"), F.count(digest).alias("n")
    )
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "part"))), lambda b: b["part"]), "-")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return inner.groupBy(*by).agg(
        total.cast("bigint").alias("rows"), F.sha2(F.concat_ws("-", total.cast("string"), parts), 256).alias(out)
    )


def set_digests_sql(source: str, by: str, digest: str, out: str) -> str:
    """The same statement for the SQL side; ``by`` may be empty."""
    keys = f"{by}, " if by else ""
    grouped = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}coalesce(sum(n), 0)::BIGINT AS rows,
      sha256(concat_ws('-', coalesce(sum(n), 0)::BIGINT::VARCHAR, coalesce(string_agg(part, '-' ORDER BY bucket), ''))) AS {out}
      FROM (SELECT {keys}left({digest}, {BUCKET_DIGITS}) AS bucket, count({digest}) AS n, sha256(string_agg({digest}, '-' ORDER BY {digest})) AS part
        FROM {source} GROUP BY {keys}left({digest}, {BUCKET_DIGITS})) {grouped}"""
