"""Parsing, chunking and profiles over whole document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import hashing
from evidencelake.operators import chunking, lexical, parsing, profiles
from evidencelake.plans import inputs
from evidencelake.plans.registry import query


def rendered(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as Markdown: title, lines as blocks, some headings, lists, pages."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    text = F.regexp_replace(text, r"\n\n(The|Et|Und|La|Is|Of|Le|Die) ", "\n\n## $1 ")
    text = F.regexp_replace(text, r"\n\n(And|Ou|De|In|Der) ", "\n\n- $1 ")
    text = F.replace(text, F.lit(". In"), F.lit(".\fIn"))
    return inputs.table(spark, folder, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"),
        F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), text).alias("text"),
    )


ELEMENTS_SQL = r"""
rendered AS (SELECT doc_id, lang, 'doc-' || doc_id AS document_id, '# ' || source || chr(10) || chr(10) || replace(regexp_replace(regexp_replace(
    replace(text, chr(10), chr(10) || chr(10)), '\n\n(The|Et|Und|La|Is|Of|Le|Die) ', chr(10) || chr(10) || '## \1 ', 'g'),
    '\n\n(And|Ou|De|In|Der) ', chr(10) || chr(10) || '- \1 ', 'g'), '. In', '.' || chr(12) || 'In') AS text FROM documents),
paged AS (SELECT doc_id, lang, document_id, unnest(string_split(text, chr(12))) AS body, unnest(range(1, len(string_split(text, chr(12))) + 1)) AS page FROM rendered),
blocked AS (SELECT doc_id, lang, document_id, page, unnest(range(1, len(string_split(body, chr(10) || chr(10))) + 1)) AS b,
    regexp_replace(unnest(string_split(body, chr(10) || chr(10))), '^\s+|\s+$', '', 'g') AS raw FROM paged),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page, b) - 1) AS ordinal FROM blocked WHERE raw <> ''),
marked AS (SELECT *, CASE WHEN starts_with(raw, '# ') AND ordinal = 0 THEN 'title' WHEN starts_with(raw, '# ') OR starts_with(raw, '## ') THEN 'heading'
      WHEN starts_with(raw, '- ') THEN 'list_item' ELSE 'paragraph' END AS kind,
    CASE WHEN starts_with(raw, '## ') THEN regexp_replace(raw[4:], '^\s+|\s+$', '', 'g')
      WHEN starts_with(raw, '# ') OR starts_with(raw, '- ') THEN regexp_replace(raw[3:], '^\s+|\s+$', '', 'g') ELSE raw END AS text FROM numbered),
els AS (SELECT doc_id, lang, document_id, ordinal, page, kind, text,
    'el-' || left(sha256(document_id || chr(0) || ordinal || chr(0) || text), 16) AS element_id,
    last_value(CASE WHEN kind IN ('title', 'heading') THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal) AS section FROM marked)"""


@query(
    "plaintext_elements",
    f"WITH {ELEMENTS_SQL} SELECT document_id, element_id, ordinal, kind, text, page, coalesce(section, '') AS section FROM els",
)
def plaintext_elements(spark: SparkSession, folder: str) -> DataFrame:
    rows = parsing.explode_elements(parsing.parse_plain_text(rendered(spark, folder)))
    return rows.select(
        "document_id",
        "element_id",
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "kind",
        "text",
        F.col("page").cast("bigint").alias("page"),
        F.coalesce("section", F.lit("")).alias("section"),
    )


CHUNKS_SQL = f"""{ELEMENTS_SQL},
fold AS (SELECT doc_id, ordinal, 0 AS position, length(text) + 1 AS used, page AS fp, section AS fs FROM els WHERE ordinal = 0
  UNION ALL SELECT e.doc_id, e.ordinal, f.position + s.flush::INT, CASE WHEN s.flush THEN length(e.text) + 1 ELSE f.used + length(e.text) + 1 END,
    CASE WHEN s.flush THEN e.page ELSE f.fp END, CASE WHEN s.flush THEN e.section ELSE f.fs END
  FROM fold f JOIN els e ON e.doc_id = f.doc_id AND e.ordinal = f.ordinal + 1,
    LATERAL (SELECT (e.page IS DISTINCT FROM f.fp OR e.section IS DISTINCT FROM f.fs OR f.used + length(e.text) > 1500) AS flush) s),
chunks AS (SELECT e.document_id, min(e.lang) AS lang, f.position, string_agg(e.text, chr(10) || chr(10) ORDER BY e.ordinal) AS text, min(e.page) AS page, min(e.section) AS section,
    'ch-' || left(sha256(e.document_id || chr(0) || '1500' || chr(0) || string_agg(e.element_id, chr(0) ORDER BY e.ordinal)), 16) AS chunk_id, count(*) AS elements
  FROM fold f JOIN els e ON e.doc_id = f.doc_id AND e.ordinal = f.ordinal GROUP BY e.document_id, f.position)"""


def structural(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.structural_chunks(parsing.parse_plain_text(rendered(spark, folder)))


@query(
    "structural_chunks",
    f"WITH RECURSIVE {CHUNKS_SQL} SELECT chunk_id, document_id, position, text, page, coalesce(section, '') AS section, elements FROM chunks",
)
def structural_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return structural(spark, folder).select(
        "chunk_id",
        "document_id",
        "position",
        "text",
        F.col("page").cast("bigint").alias("page"),
        F.coalesce("section", F.lit("")).alias("section"),
        F.size("element_ids").cast("bigint").alias("elements"),
    )


@query(
    "chunk_length_profile",
    f"""WITH RECURSIVE {CHUNKS_SQL}, sized AS (SELECT lang AS name, length(text) AS n FROM chunks UNION ALL SELECT 'all', length(text) FROM chunks)
    SELECT name, count(*) AS count, sum(n)::BIGINT AS total, min(n) AS min, round(avg(n), 2) AS mean, quantile_disc(n, 0.5) AS p50,
      quantile_disc(n, 0.95) AS p95, max(n) AS max FROM sized GROUP BY name""",
)
def chunk_length_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk sizes overall and by language (in the place of the media type)."""
    parsed = parsing.parse_plain_text(rendered(spark, folder)).withColumn(
        "document_id", F.concat_ws("|", "lang", "document_id")
    )
    sized = chunking.structural_chunks(parsed).select(
        F.split_part("document_id", F.lit("|"), F.lit(1)).alias("lang"), F.length("text").alias("size")
    )
    return profiles.length_profile(sized, "size", "lang", {"p50": 0.5, "p95": 0.95})


@query(
    "token_length_profile",
    f"""WITH t AS (SELECT lang, len({inputs.TOKENS_SQL.format('text')}) AS n FROM documents),
    sized AS (SELECT lang AS name, n FROM t UNION ALL SELECT 'all', n FROM t)
    SELECT name, count(*) AS count, sum(n)::BIGINT AS total, min(n) AS min, round(avg(n), 2) AS mean, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95,
      quantile_disc(n, 0.99) AS p99, max(n) AS max, count(*) FILTER (n > 512) AS truncated_count, round(count(*) FILTER (n > 512) / count(*), 6) AS truncated_rate
    FROM sized GROUP BY name""",
)
def token_length_profile(spark: SparkSession, folder: str) -> DataFrame:


    sized = lexical.tokenize(inputs.table(spark, folder, "documents")).select("lang", F.size("terms").alias("size"))
    return profiles.length_profile(sized, "size", "lang", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, limit=512)


SHEETS_SQL = r"""
lines AS (SELECT doc_id, 'doc-' || doc_id AS document_id, lang AS sheet, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS rownum,
    regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS text FROM documents),
rows0 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rownum) AS i, count(*) OVER (PARTITION BY doc_id) AS n,
    'el-' || left(sha256(document_id || chr(0) || sheet || chr(0) || rownum || chr(0) || text), 16) AS element_id FROM lines WHERE text <> ''),
heads AS (SELECT doc_id, CASE WHEN n > 1 AND length(text) <= 300 THEN text END AS head, element_id AS head_id, rownum AS head_row FROM rows0 WHERE i = 1),
data AS (SELECT r.*, head, head_id, head_row, row_number() OVER (PARTITION BY r.doc_id ORDER BY rownum) AS j FROM rows0 r JOIN heads h USING (doc_id)
  WHERE head IS NULL OR i > 1),
fold AS (SELECT doc_id, j, 0 AS position, coalesce(length(head) + 1, 0) + length(text) AS used FROM data WHERE j = 1
  UNION ALL SELECT d.doc_id, d.j, CASE WHEN f.used + 1 + length(d.text) > 1500 THEN f.position + 1 ELSE f.position END,
    CASE WHEN f.used + 1 + length(d.text) > 1500 THEN coalesce(length(head) + 1, 0) + length(d.text) ELSE f.used + 1 + length(d.text) END
  FROM fold f JOIN data d ON d.doc_id = f.doc_id AND d.j = f.j + 1)"""


@query(
    "spreadsheet_chunks",
    f"""WITH RECURSIVE {SHEETS_SQL}
    SELECT d.document_id, d.sheet, f.position,
      'ch-' || left(sha256(d.document_id || chr(0) || 'spreadsheet-rows-v1' || chr(0) || '1500' || chr(0) || CASE WHEN min(head) IS NOT NULL THEN min(head_id) || chr(0) ELSE '' END
        || string_agg(d.element_id, chr(0) ORDER BY rownum)), 16) AS chunk_id,
      CASE WHEN min(head) IS NOT NULL THEN min(head) || chr(10) ELSE '' END || string_agg(d.text, chr(10) ORDER BY rownum) AS text,
      min(rownum) AS row_start, max(rownum) AS row_end, CASE WHEN min(head) IS NOT NULL THEN min(head_row) ELSE 0 END AS header_row
    FROM fold f JOIN data d ON d.doc_id = f.doc_id AND d.j = f.j GROUP BY d.document_id, d.sheet, f.position""",
)
def spreadsheet_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a document as the rows of its one sheet."""
    document_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct((i + 1).alias("row"), parsing.strip(line).alias("text")),
    )
    rows = F.transform(
        F.filter(lines, lambda r: r["text"] != ""),
        lambda r: F.struct(
            hashing.short_id("el", document_id, F.col("lang"), r["row"].cast("string"), r["text"]).alias("element_id"),
            r["row"].alias("row"),
            r["text"].alias("text"),
        ),
    )
    sheets = inputs.table(spark, folder, "documents").select(
        document_id.alias("document_id"), F.col("lang").alias("sheet"), rows.alias("rows")
    )
    return chunking.spreadsheet_chunks(sheets).select(
        "document_id",
        "sheet",
        "position",
        "chunk_id",
        "text",
        F.col("row_start").cast("bigint").alias("row_start"),
        F.col("row_end").cast("bigint").alias("row_end"),
        F.coalesce("header_row", F.lit(0)).cast("bigint").alias("header_row"),
    )


@query(
    "ocr_fallback_merge",
    f"""WITH {ELEMENTS_SQL}, readable AS (SELECT * FROM els WHERE (doc_id + page) % 3 <> 0),
    pages AS (SELECT document_id, doc_id, unnest(range(1, len(string_split(text, chr(12))) + 1)) AS page FROM rendered),
    added AS (SELECT p.document_id, p.page, 2000000000 AS ordinal, 'scan ' || p.page AS text, 'el-' || left(sha256(p.document_id || chr(0) || p.page || chr(0) || 'test-ocr' || chr(0) || 'scan ' || p.page), 16) AS element_id
      FROM pages p WHERE (p.document_id, p.page) NOT IN (SELECT document_id, page FROM readable) AND (doc_id + p.page) % 2 = 0),
    merged AS (SELECT document_id, page, ordinal, text, element_id FROM readable UNION ALL SELECT * FROM added)
    SELECT document_id, page, row_number() OVER (PARTITION BY document_id ORDER BY page, ordinal) - 1 AS ordinal, element_id, text FROM merged""",
)
def ocr_fallback_merge(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the pages is unreadable; half of those is recognized."""
    documents = rendered(spark, folder)
    elements = parsing.explode_elements(parsing.parse_plain_text(documents))
    number = F.split_part("document_id", F.lit("-"), F.lit(2)).cast("bigint")
    readable = elements.where((number + F.col("page")) % 3 != 0)
    counts = documents.select("document_id", F.size(F.split("text", "\f")).alias("page_count"))
    pages = counts.select("document_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    recognized = pages.select(
        "document_id",
        "page",
        F.when((number + F.col("page")) % 2 == 0, F.concat(F.lit("scan "), F.col("page").cast("string")))
        .otherwise(F.lit(" "))
        .alias("text"),
    )
    merged = parsing.ocr_merge(readable, counts, recognized, "test-ocr")
    return merged.select(
        "document_id",
        F.col("page").cast("bigint").alias("page"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "element_id",
        "text",
    )
