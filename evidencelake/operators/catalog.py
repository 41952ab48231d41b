"""Document catalog: access, validation, refresh and audit."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import validity
from evidencelake.session import ensure_checkpoint_dir

# Media type by file suffix.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
# Fields a reviewed entry must carry.
REQUIRED_FIELDS = ("title", "family", "organization", "version", "effective_from")


def media_type(path: Column) -> Column:
    """Media type of a path by its suffix; NULL when it is not supported."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    chosen = F.lit(None).cast("string")
    for name, value in MEDIA_TYPES.items():
        chosen = F.when(suffix == name, value).otherwise(chosen)
    return chosen


def normalize_media_type(value: Column) -> Column:
    """Drop parameters, blanks and case."""
    return F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1))))


def with_selection(entries: DataFrame, day: Column) -> DataFrame:
    """Why an entry is left out of a snapshot; NULL when it is selected."""
    return entries.withColumn(
        "selection",
        validity.selection_status(
            F.col("review_status"), day, F.col("effective_from"), F.col("effective_until")
        ),
    )


def access_status(entry: dict[str, Column], day: Column, content: Column) -> Column:
    """Fail-closed access decision with strict precedence.

    ``invalid_entry`` stands for a reviewed entry that lacks required metadata.
    """
    return (
        F.when(entry["review_status"] == "missing", "missing_source")
        .when(entry["review_status"] != "reviewed", "pending_review")
        .when(entry["effective_from"].isNull(), "invalid_entry")
        .when(day < entry["effective_from"], "not_yet_effective")
        .when(entry["effective_until"].isNotNull() & (day > entry["effective_until"]), "expired")
        .when(F.sha2(content, 256) != entry["content_sha256"], "content_mismatch")
        .when(entry["title"].isNull() | entry["version"].isNull(), "invalid_entry")
        .otherwise("granted")
    )


def entry_columns() -> dict[str, Column]:
    names = ("review_status", "effective_from", "effective_until", "content_sha256", "title", "version")
    return {name: F.col(name) for name in names}


def violations(entries: DataFrame) -> DataFrame:
    """All rule breaks of a catalog as (document_id, code, detail).

    ``entries``: document_id, content_sha256, relative_paths, size_bytes,
    review_status, required fields, effective_until and supersedes.
    """
    blank = [F.when(F.col(f).isNull() | (F.col(f).cast("string") == ""), F.lit(f)) for f in sorted(REQUIRED_FIELDS)]
    missing = F.array_join(F.array_compact(F.array(*blank)), ", ")
    reviewed = F.col("review_status") == "reviewed"
    rules = {
        "invalid_sha256": (F.length("content_sha256") != 64, F.lit("")),
        "negative_size": (F.col("size_bytes") < 0, F.lit("")),
        "missing_path": (F.size("relative_paths") == 0, F.lit("")),
        "invalid_period": (F.col("effective_until") < F.col("effective_from"), F.lit("")),
        "missing_fields": (reviewed & (missing != ""), missing),
        "self_supersedes": (F.array_contains("supersedes", F.col("document_id")), F.lit("")),
    }
    checks = F.array_compact(
        F.array(
            *[
                F.when(broken, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
                for code, (broken, detail) in rules.items()
            ]
        )
    )
    row_level = entries.select("document_id", F.inline(checks))
    repeated = []
    for key, code in (("document_id", "duplicate_document_id"), ("content_sha256", "duplicate_content_sha256")):
        counts = entries.groupBy(key).agg(
            F.min("document_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
        )
        repeated.append(
            counts.where(F.col("copies") > 1).select(
                F.col("first_id").alias("document_id"), F.lit(code).alias("code"), F.col(key).alias("detail")
            )
        )
    targets = entries.select("document_id", F.explode("supersedes").alias("target"))
    unknown = targets.join(
        entries.select(F.col("document_id").alias("target")), "target", "left_anti"
    ).select("document_id", F.lit("unknown_supersedes").alias("code"), F.col("target").alias("detail"))
    return reduce(DataFrame.unionByName, [row_level, *repeated, unknown])


def require_empty(found: DataFrame, message: str) -> None:
    """Raise when a violations table has a row."""
    row = found.limit(1).first()
    if row is not None:
        raise ValueError(f"{message}: {row.asDict()}")


def _jump(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of runs of documents with one successor each, by doubling the steps taken.

    ``single``: document_id, at (its successor).  Returns (document_id, at) of those that leave the run, ``at`` being
    the first document without exactly one successor, and the document ids of those that go round for ever.
    """
    limit = math.ceil(math.log2(single.count() + 2)) + 1
    for _ in range(limit):
        ahead = single.select(F.col("document_id").alias("at"), F.col("at").alias("beyond"))
        single = single.join(ahead, "at", "left").select(
            "document_id", F.coalesce("beyond", "at").alias("at"), F.col("beyond").isNotNull().alias("moving")
        ).checkpoint()
        if single.where("moving").limit(1).count() == 0:
            break
    return single.where("NOT moving").select("document_id", "at"), single.where("moving").select("document_id")


def on_or_before_cycle(links: DataFrame) -> DataFrame:
    """Documents from which a supersession cycle can be reached.

    Documents with one successor are jumped over in a logarithmic number of rounds, however long their chain.  What
    is left are documents with several successors; edges that end nowhere are dropped and the rest is jumped over
    again.  Once every document left has several successors among them, each of them reaches a cycle.  ``links``:
    document_id, target.  The lineage is cut by checkpoints in the shared folder.
    """
    ensure_checkpoint_dir(links.sparkSession)
    edges = links.select("document_id", "target").distinct().checkpoint()
    size, passed, found = edges.count(), [], []
    while size:
        degree = edges.groupBy("document_id").agg(F.count("*").alias("n"), F.min("target").alias("at"))
        single = degree.where("n = 1").select("document_id", "at").checkpoint()
        many = degree.where("n > 1").select("document_id")
        if single.limit(1).count():
            ended, turning = _jump(single)
            passed.append(ended)
            found.append(turning)
        else:
            ended, turning = single, single.select("document_id")
        # a document that leads into a circle of single successors stands for it as its own successor
        led = turning.select(F.col("document_id").alias("target"), F.lit(True).alias("turns"))
        ends = ended.select(F.col("document_id").alias("target"), F.col("at").alias("end"))
        moved = edges.join(many, "document_id", "left_semi").join(ends, "target", "left").join(led, "target", "left")
        goal = F.when(F.col("turns"), F.col("document_id")).otherwise(F.coalesce("end", "target"))
        moved = moved.select("document_id", goal.alias("target")).distinct()
        edges = moved.join(many.select(F.col("document_id").alias("target")), "target", "left_semi").select("document_id", "target").checkpoint()
        before, size = size, edges.count()
        if size == before:
            found.append(edges.select("document_id"))
            break
    if not found:
        return edges.select("document_id")
    alive = reduce(DataFrame.unionByName, found).distinct()
    for ended in reversed(passed):
        reached = ended.join(alive.select(F.col("document_id").alias("at")), "at", "left_semi").select("document_id")
        alive = alive.unionByName(reached).distinct()
    return alive


def grouped_copies(inventory: DataFrame) -> DataFrame:
    """One row per content hash: first path, size, media type and copy count.

    The paths of all copies are the rows of :func:`copy_paths`; a content found
    in a third of all files must not become one row's array.
    """
    return inventory.groupBy("content_sha256").agg(
        F.min("relative_path").alias("first_path"),
        F.min_by("size_bytes", "relative_path").alias("size_bytes"),
        F.min_by("media_type", "relative_path").alias("media_type"),
        F.count(F.lit(1)).cast("bigint").alias("copy_count"),
    )


def copy_paths(inventory: DataFrame) -> DataFrame:
    """Every path of every content as a row: content_sha256, relative_path, is_first."""
    first = grouped_copies(inventory).select("content_sha256", "first_path")
    return inventory.select("content_sha256", "relative_path").distinct().join(first, "content_sha256").select(
        "content_sha256", "relative_path", (F.col("relative_path") == F.col("first_path")).alias("is_first")
    )


def refresh(inventory: DataFrame, previous: DataFrame) -> DataFrame:
    """Merge the current inventory into the previous catalog by content hash.

    Known content keeps its reviewed metadata, content that returns becomes
    pending, vanished content becomes missing, new content enters as pending.
    """
    current = grouped_copies(inventory).withColumnRenamed("content_sha256", "sha")
    old = previous.select(
        F.col("content_sha256").alias("old_sha"),
        F.col("document_id").alias("old_id"),
        F.col("review_status").alias("old_status"),
        F.col("size_bytes").alias("old_size"),
        *[c for c in previous.columns if c not in ("content_sha256", "document_id", "review_status", "size_bytes")],
    )
    joined = current.join(old, F.col("sha") == F.col("old_sha"), "full")
    extra = [c for c in old.columns if not c.startswith("old_")]
    status = (
        F.when(F.col("sha").isNull(), "missing")
        .when(F.col("old_sha").isNull() | (F.col("old_status") == "missing"), "pending")
        .otherwise(F.col("old_status"))
    )
    return joined.select(
        F.coalesce("old_id", F.concat(F.lit("doc-"), F.left("sha", F.lit(16)))).alias("document_id"),
        F.coalesce("sha", "old_sha").alias("content_sha256"),
        status.alias("review_status"),
        F.coalesce("size_bytes", "old_size").alias("size_bytes"),
        "first_path",
        "media_type",
        F.coalesce("copy_count", F.lit(0)).cast("bigint").alias("copy_count"),
        *extra,
    )


def audit(entries: DataFrame, inventory_hashes: DataFrame, day: Column) -> DataFrame:
    """Aggregate health of a catalog against the corpus, one row of counts."""
    corpus = inventory_hashes.select(F.col("content_sha256").alias("sha")).distinct()
    joined = entries.join(corpus, F.col("content_sha256") == F.col("sha"), "full")
    known = F.col("document_id").isNotNull()
    held = F.col("sha").isNotNull()
    status = F.col("review_status")
    reviewed = known & (status == "reviewed")
    future = reviewed & F.col("effective_from").isNotNull() & (day < F.col("effective_from"))
    past = reviewed & ~F.coalesce(future, F.lit(False)) & F.col("effective_until").isNotNull() & (
        day > F.col("effective_until")
    )
    future, past = F.coalesce(future, F.lit(False)), F.coalesce(past, F.lit(False))

    def count(flag: Column, name: str) -> Column:
        return F.count_if(flag).cast("bigint").alias(name)

    counts = joined.agg(
        count(known, "document_count"),
        F.count_distinct("sha").cast("bigint").alias("corpus_document_count"),
        count(status == "missing", "missing_count"),
        count(status == "pending", "pending_count"),
        count(status == "reviewed", "reviewed_count"),
        count(reviewed & ~future & ~past, "effective_reviewed_count"),
        count(future, "not_yet_effective_count"),
        count(past, "expired_count"),
        F.count_distinct(F.when(held & ~known, F.col("sha"))).cast("bigint").alias("untracked_content_count"),
        F.count_distinct(F.when(known & ~held, F.col("content_sha256"))).cast("bigint").alias(
            "unavailable_content_count"
        ),
        count(known & held & (status == "missing"), "inconsistent_missing_status_count"),
    )
    ready = (
        (F.col("pending_count") == 0)
        & (F.col("untracked_content_count") == 0)
        & (F.col("unavailable_content_count") == 0)
        & (F.col("inconsistent_missing_status_count") == 0)
    )
    return counts.withColumn("ready", ready)


def resolve_sources(entries: DataFrame, inventory: DataFrame) -> DataFrame:
    """Path to read per entry: its own paths first, then the last path by hash.

    Paths that leave the root are ignored.
    """
    inside = ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    files = inventory.select(F.col("relative_path").alias("path"), F.col("content_sha256").alias("sha"))
    own = (
        entries.select("document_id", F.posexplode("relative_paths").alias("position", "path"))
        .where(inside)
        .join(files.select("path"), "path", "left_semi")
        .groupBy("document_id")
        .agg(F.min_by("path", "position").alias("own_path"))
    )
    by_hash = files.groupBy("sha").agg(F.max("path").alias("hash_path"))
    return (
        entries.join(own, "document_id", "left")
        .join(by_hash, entries["content_sha256"] == by_hash["sha"], "left")
        .withColumn("source_path", F.coalesce("own_path", "hash_path"))
        .drop("own_path", "hash_path", "sha")
    )


def processing_summary(entries: DataFrame, chunk_counts: DataFrame, day: Column) -> DataFrame:
    """Count entries per outcome of a snapshot run.

    ``chunk_counts``: document_id, chunk_count (0 = empty, NULL = error).
    """
    joined = with_selection(entries, day).join(
        chunk_counts.withColumn("tried", F.lit(True)), "document_id", "left"
    )
    status = (
        F.when(F.col("selection").isNotNull(), F.col("selection"))
        .when(F.col("tried").isNull() | F.col("chunk_count").isNull(), "error")
        .when(F.col("chunk_count") == 0, "empty")
        .otherwise("processed")
    )
    return joined.groupBy(status.alias("status")).agg(F.count(F.lit(1)).cast("bigint").alias("documents"))


def local_document_id(content: Column) -> Column:
    return F.concat(F.lit("local-"), F.left(F.sha2(content, 256), F.lit(16)))
