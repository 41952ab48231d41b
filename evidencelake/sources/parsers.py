"""Plug-in boundary for binary formats.

Decoders of binary formats are functions of the caller, looked up by media type
(without parameters, in lower case).  A file that fails becomes a row with an
error type, it never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.functions import hashing
from evidencelake.operators import catalog

# a parser yields (page, section, row, kind, text) for one file
Parser = Callable[[bytes], Iterator[tuple[int | None, str | None, int | None, str, str]]]
_SCHEMA = (
    "document_id string, ordinal int, page int, section string, row int, kind string, text string, error_type string"
)


def parse_files(files: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """Elements of binary files; ``files``: document_id, media_type, content.

    Unknown media types and failing files yield one row with ``error_type``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document_id, media_type, content in zip(batch["document_id"], batch["media_type"], batch["content"]):
                rows = []
                try:
                    for ordinal, found in enumerate(parsers[media_type](content)):
                        rows.append((document_id, ordinal, *found, None))
                except Exception as error:
                    while error.__cause__ is not None:
                        error = error.__cause__
                    rows = [(document_id, None, None, None, None, None, None, type(error).__name__)]
                yield pd.DataFrame(
                    rows, columns=["document_id", "ordinal", "page", "section", "row", "kind", "text", "error_type"]
                ).astype({"ordinal": "Int32", "page": "Int32", "row": "Int32"})

    kind = catalog.normalize_media_type(F.col("media_type")).alias("media_type")
    parsed = files.select("document_id", kind, "content").mapInPandas(run, _SCHEMA)
    identity = F.when(
        F.col("row").isNotNull(),
        hashing.short_id("el", F.col("document_id"), F.col("section"), F.col("row").cast("string"), F.col("text")),
    ).otherwise(hashing.short_id("el", F.col("document_id"), F.col("ordinal").cast("string"), F.col("text")))
    return parsed.withColumn("element_id", F.when(F.col("error_type").isNull(), identity))
