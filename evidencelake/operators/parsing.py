"""Plain-text parsing and the OCR fallback merge.

A document is one row, so its ordered elements are built inside the row: no
element is shuffled and no order has to be restored afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.functions import arrays, hashing

_EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
ELEMENT = (
    "array<struct<element_id:string,ordinal:int,kind:string,text:string,page:int,section:string>>"
)


def strip(text: Column) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.regexp_replace(text, _EDGE_BLANKS, "")


def _marked(block: Column, position: Column) -> Column:
    """Kind and text of a block by its Markdown marker."""
    text = block["text"]
    title, heading, item = text.startswith("# "), text.startswith("## "), text.startswith("- ")
    kind = (
        F.when(title & (position == 0), "title")
        .when(title | heading, "heading")
        .when(item, "list_item")
        .otherwise("paragraph")
    )
    body = (
        F.when(heading, strip(F.substring(text, F.lit(4), F.length(text))))
        .when(title | item, strip(F.substring(text, F.lit(3), F.length(text))))
        .otherwise(text)
    )
    return F.struct(
        kind.alias("kind"), body.alias("text"), block["page"].alias("page"), (title | heading).alias("opens")
    )


def plain_text_elements(document_id: Column, text: Column) -> Column:
    """Elements of a text: form feeds end pages, blank lines end blocks."""
    blocks = F.flatten(
        F.transform(
            F.split(text, "\f"),
            lambda page, number: F.transform(
                F.split(page, "\n\n"),
                lambda block: F.struct((number + 1).alias("page"), strip(block).alias("text")),
            ),
        )
    )
    kept = F.filter(blocks, lambda b: b["text"] != "")

    def with_sections(marked: Column) -> Column:
        """Blocks from one that opens a section up to the next are one run; no block is appended to a growing array."""
        opening = F.filter(F.transform(marked, lambda b, i: F.when(b["opens"], i)), lambda i: i.isNotNull())
        before = F.when(F.coalesce(F.get(opening, 0), F.lit(-1)) == 0, F.slice(opening, 1, 0)).otherwise(F.array(F.lit(0)))
        run = lambda r: F.transform(
            r,
            lambda b: F.struct(
                b["kind"].alias("kind"), b["text"].alias("text"), b["page"].alias("page"),
                F.when(F.get(r, 0)["opens"], F.get(r, 0)["text"]).alias("section"),
            ),
        )
        return F.flatten(F.transform(arrays.cut_at(marked, F.concat(before, opening)), run))

    placed = arrays.once(F.transform(kept, _marked), with_sections)
    return F.transform(
        placed,
        lambda e, i: F.struct(
            hashing.short_id("el", document_id, i.cast("string"), e["text"]).alias("element_id"),
            i.alias("ordinal"),
            e["kind"].alias("kind"),
            e["text"].alias("text"),
            e["page"].alias("page"),
            e["section"].alias("section"),
        ),
    )


def parse_plain_text(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the ``elements`` array to documents (document_id, text)."""
    return documents.withColumn("elements", plain_text_elements(F.col("document_id"), F.col(text_col)))


def explode_elements(parsed: DataFrame) -> DataFrame:
    """One row per element."""
    return parsed.select("document_id", F.inline("elements"))


def element_violations(elements: DataFrame) -> DataFrame:
    """Elements with a negative or repeated ordinal or without text."""
    bad = (
        F.when(F.col("ordinal") < 0, "negative_ordinal").when(F.trim("text") == "", "blank_text")
    )
    rows = elements.select("document_id", "ordinal", bad.alias("code")).where(F.col("code").isNotNull())
    repeated = elements.groupBy("document_id", "ordinal").count().where(F.col("count") > 1)
    return rows.unionByName(repeated.select("document_id", "ordinal", F.lit("repeated_ordinal").alias("code")))


def ocr_merge(elements: DataFrame, page_counts: DataFrame, recognized: DataFrame, provider: str) -> DataFrame:
    """Add recognized text for pages without any element and renumber.

    ``page_counts``: document_id, page_count.  ``recognized``: document_id,
    page, text from the OCR plug-in.  Pages with text are never replaced.
    """
    pages = page_counts.where(F.col("page_count") > 0).select(
        "document_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page")
    )
    empty = pages.join(elements.select("document_id", "page"), ["document_id", "page"], "left_anti")
    text = strip(F.col("text"))
    added = (
        empty.join(recognized, ["document_id", "page"])
        .where(text != "")
        .select(
            hashing.short_id("el", F.col("document_id"), F.col("page").cast("string"), F.lit(provider), text).alias("element_id"),
            "document_id",
            F.lit(2_000_000_000).alias("ordinal"),
            F.lit("paragraph").alias("kind"),
            text.alias("text"),
            "page",
            F.lit(None).cast("string").alias("section"),
        )
    )
    merged = elements.unionByName(added)
    order = Window.partitionBy("document_id").orderBy(F.coalesce("page", F.lit(0)), "ordinal")
    return merged.withColumn("ordinal", (F.row_number().over(order) - 1).cast("int"))
