"""Gated corpus runs: catalog to source to content gate to parser to chunks, for many reference dates at once.

A content is read, checked, parsed and chunked once, whatever number of dates it is valid on; dates are attached to
the finished chunks.  Whatever goes wrong with one entry is a row with a reason and never ends the run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing, validity
from evidencelake.operators import catalog, chunking, parsing
from evidencelake.sources import parsers as plugins

PLAIN_TEXT = "text/plain"


def with_days(entries: DataFrame, days: list[dt.date]) -> DataFrame:
    """Adds ``selections``: for each reference date why the entry is left out, NULL where it is selected."""
    listed = F.array(*(F.lit(day) for day in sorted(set(days)))).cast("array<date>")
    judged = F.transform(
        listed,
        lambda day: F.struct(
            day.alias("reference_date"),
            validity.selection_status(
                F.col("review_status"), day, F.col("effective_from"), F.col("effective_until")
            ).alias("selection"),
        ),
    )
    return entries.withColumn("selections", judged)


def admitted(entries: DataFrame, files: DataFrame, days: list[dt.date]) -> DataFrame:
    """Entries with their content and ``reason``, NULL where the content may be parsed.

    ``files``: relative_path, content.  Only entries selected on some date are read.  The reasons are
    ``missing_source``, ``content_mismatch`` and ``invalid_entry``.
    """
    judged = with_days(entries, days)
    wanted = judged.where(F.exists("selections", lambda s: s["selection"].isNull()))
    held = files.select("relative_path", F.sha2("content", 256).alias("content_sha256"))
    resolved = catalog.resolve_sources(wanted, held)
    contents = files.select(F.col("relative_path").alias("source_path"), "content")
    read = resolved.join(contents, "source_path", "left")
    reason = (
        F.when(F.col("content").isNull(), "missing_source")
        .when(F.sha2("content", 256) != F.col("content_sha256"), "content_mismatch")
        .when(F.col("title").isNull() | F.col("version").isNull(), "invalid_entry")
    )
    return read.withColumn("reason", reason)


def parsed(sources: DataFrame, parsers: dict[str, plugins.Parser] | None = None) -> DataFrame:
    """document_id, elements, reason of admitted sources.

    Plain text is parsed by column expressions.  Other media types go to the plug-in of their type; a plug-in that
    fails gives the name of its error as reason, a type without one ``unsupported_media_type``.
    """
    parsers = {k.partition(";")[0].strip().lower(): v for k, v in (parsers or {}).items()}
    kind = catalog.normalize_media_type(F.col("media_type"))
    open_ = sources.where(F.col("reason").isNull()).select("document_id", kind.alias("media_type"), "content")
    shape = "array<struct<element_id:string,ordinal:int,kind:string,text:string,page:int,section:string,parser:string,sheet:string,row:int>>"
    nothing = F.lit(None).cast(shape)
    is_plain = F.col("media_type") == PLAIN_TEXT
    native = F.transform(
        parsing.plain_text_elements(F.col("document_id"), F.decode("content", "utf-8")),
        lambda e: F.struct(
            *(e[c].alias(c) for c in ("element_id", "ordinal", "kind", "text", "page", "section")),
            F.lit("plain-text").alias("parser"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("int").alias("row"),
        ),
    ).cast(shape)
    none = F.lit(None).cast("string")
    out = open_.where(is_plain).select("document_id", native.alias("elements"), none.alias("reason"))
    known = F.coalesce(F.col("media_type").isin(*parsers), F.lit(False)) if parsers else F.lit(False)
    unknown = open_.where(~F.coalesce(is_plain, F.lit(False)) & ~known)
    out = out.unionByName(unknown.select("document_id", nothing.alias("elements"), F.lit("unsupported_media_type").alias("reason")))
    if parsers:
        found = plugins.parse_files(open_.where(~is_plain & known), parsers)
        element = F.struct(
            "ordinal", "element_id", "kind", "text", "page", "section", F.lit("plug-in").alias("parser"),
            F.when(F.col("row").isNotNull(), F.col("section")).alias("sheet"), "row",
        )
        listed = F.sort_array(F.collect_list(F.when(F.col("error_type").isNull(), element)))  # the elements of one document
        rows = found.groupBy("document_id").agg(listed.alias("found"), F.max("error_type").alias("reason"))
        ordered = F.transform("found", lambda e: F.struct(*(e[c].alias(c) for c in ("element_id", "ordinal", "kind", "text", "page", "section", "parser", "sheet", "row"))))
        done = rows.select("document_id", F.when(F.col("reason").isNull(), ordered).cast(shape).alias("elements"), "reason")
        # a file without any element gives no row above
        silent = open_.where(~is_plain & known).select("document_id").join(done, "document_id", "left_anti")
        out = out.unionByName(done).unionByName(silent.select("document_id", F.array().cast(shape).alias("elements"), none.alias("reason")))
    return out


class Run:
    """One corpus run over some reference dates; its tables are written to ``folder`` once and read from there."""

    def __init__(
        self, entries: DataFrame, files: DataFrame, days: list[dt.date], folder: str,
        *, parsers: dict[str, plugins.Parser] | None = None, max_characters: int = chunking.MAX_CHARACTERS,
    ):
        spark = entries.sparkSession
        sources = admitted(entries, files, days)
        known = parsed(sources, parsers)
        keep = ["version", "effective_from", "effective_until", "media_type"]
        refused = sources.where(F.col("reason").isNotNull()).select("document_id", "reason")
        known.write.parquet(f"{folder}/parsed")
        self.parsed = spark.read.parquet(f"{folder}/parsed")
        made = chunking.chunk_by_format(self.parsed.where(F.col("reason").isNull()).select("document_id", "elements"), max_characters=max_characters)
        made.write.parquet(f"{folder}/chunks")
        self.chunks = spark.read.parquet(f"{folder}/chunks")
        self.documents = with_days(entries, days).select("document_id", *keep, "selections")
        self.refused = refused.unionByName(self.parsed.where(F.col("reason").isNotNull()).select("document_id", "reason"))

    def outcomes(self) -> DataFrame:
        """document_id, reference_date, status, reason, chunk_count: one row for each entry and date."""
        counts = self.chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
        each = self.documents.select("document_id", F.inline("selections"))
        each = each.join(self.refused, "document_id", "left").join(counts, "document_id", "left")
        selected = F.col("selection").isNull()
        count = F.when(selected & F.col("reason").isNull(), F.coalesce("chunk_count", F.lit(0))).otherwise(F.lit(0))
        status = (
            F.when(~selected, F.col("selection")).when(F.col("reason").isNotNull(), "error").when(count == 0, "empty").otherwise("processed")
        )
        return each.select(
            "document_id", "reference_date", status.alias("status"), F.when(selected, F.col("reason")).alias("reason"),
            count.cast("bigint").alias("chunk_count"),
        )

    def records(self) -> DataFrame:
        """Chunks in the exchange format, once for each date their document is selected on."""
        days = F.transform(F.filter("selections", lambda s: s["selection"].isNull()), lambda s: s["reference_date"])
        documents = self.documents.select("*", days.alias("days"))
        joined = self.chunks.join(documents, "document_id").withColumn("reference_date", F.explode("days"))
        return joined.select(
            F.lit(1).alias("schema_version"), "reference_date",
            F.struct(
                "document_id", "version", F.col("effective_from").cast("string").alias("effective_from"),
                F.col("effective_until").cast("string").alias("effective_until"), "media_type",
            ).alias("document"),
            F.struct("chunk_id", "document_id", "text", "page", "section", "strategy").alias("chunk"),
        )


def summary(outcomes: DataFrame) -> DataFrame:
    """Content-free counts of each date and status."""
    return outcomes.groupBy("reference_date", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count("*").cast("bigint").alias("documents"), F.sum("chunk_count").cast("bigint").alias("chunks")
    )


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def manifest(spark: SparkSession, target: str) -> DataFrame | None:
    """The last committed state of each date; NULL before the first commit."""
    found = _existing(spark, f"{target}/manifest")
    if found is None:
        return None
    return found.groupBy("reference_date").agg(F.max_by(F.struct("rows", "digest", "version"), "version").alias("m")).select("reference_date", "m.*")


def _row_digest(rows: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != "reference_date"))), 256)


def commit_snapshots(records: DataFrame, target: str, *, version: int) -> DataFrame:
    """Publish the snapshots of a run: reference_date, rows, digest, written.

    The run is staged beside the table first.  Dates whose content differs from the manifest are replaced as whole
    partitions, the others are left untouched, so a run may be repeated after any failure: before the manifest is
    written a repetition writes the same partitions again, afterwards it writes none.  ``version`` has to grow.
    """
    spark = records.sparkSession
    staged = f"{target}/staged/{version}"
    records.write.mode("overwrite").partitionBy("reference_date").parquet(staged)
    rows = spark.read.schema(records.schema).parquet(staged)
    found = hashing.set_digests(rows.withColumn("row_digest", _row_digest(rows)), ["reference_date"], "row_digest", "digest")
    before = manifest(spark, target)
    if before is None:
        before = spark.createDataFrame([], "reference_date date, rows bigint, digest string, version bigint")
    old = before.select("reference_date", F.col("digest").alias("old_digest"))
    state = found.join(old, "reference_date", "left").select(
        "reference_date", "rows", "digest", (~F.col("digest").eqNullSafe(F.col("old_digest"))).alias("written")
    )
    state = spark.createDataFrame(state.collect(), state.schema)  # a row for each date
    changed = [r.reference_date for r in state.where("written").collect()]
    if changed:
        rows.where(F.col("reference_date").isin(changed)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("reference_date").parquet(f"{target}/chunks")
        news = state.where("written").select("reference_date", "rows", "digest", F.lit(version).cast("bigint").alias("version"))
        news.coalesce(1).write.mode("append").parquet(f"{target}/manifest")
    return state


def result_json(run: Run) -> DataFrame:
    """document_id and ``result``: the parsed document and its chunks, by id, as one JSON text with sorted keys."""
    every = {"ignoreNullFields": "false"}
    listed = F.sort_array(F.collect_list(F.struct("chunk_id", "page", "section", "strategy", "text")))
    chunks = run.chunks.groupBy("document_id").agg(listed.alias("chunks"))
    elements = F.transform("elements", lambda e: F.struct(*(e[c].alias(c) for c in ("element_id", "kind", "ordinal", "page", "section", "text"))))
    rows = run.parsed.where(F.col("reason").isNull()).join(run.documents.drop("selections"), "document_id").join(chunks, "document_id", "left")
    day = lambda name: F.col(name).cast("string").alias(name)
    document = F.struct("document_id", day("effective_from"), day("effective_until"), "version")
    parsed_document = F.struct(document.alias("document"), elements.alias("elements"))
    payload = F.struct(F.coalesce("chunks", F.array().cast(chunks.schema["chunks"].dataType)).alias("chunks"), parsed_document.alias("parsed_document"), F.lit(1).alias("schema_version"))
    return rows.select("document_id", F.to_json(payload, every).alias("result"))
