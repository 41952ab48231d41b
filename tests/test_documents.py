import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import chunking, parsing, profiles

ELEMENT = "array<struct<element_id:string,ordinal:int,kind:string,text:string,page:int,section:string>>"
ROW = "array<struct<element_id:string,row:int,text:string>>"


def digest(prefix, *parts):
    return f"{prefix}-{hashlib.sha256(chr(0).join(parts).encode()).hexdigest()[:16]}"


def test_markdown_parsing(spark):
    body = "# Title\n\nfirst\n\n\n\n  ## Part  \n\n- item\x0c# Again\n\nlast"
    df = spark.createDataFrame([("d", body), ("e", " \n\n\x0c ")], "document_id string, text string")
    rows = parsing.explode_elements(parsing.parse_plain_text(df)).orderBy("ordinal").collect()
    assert [(r.kind, r.text, r.page, r.section) for r in rows] == [
        ("title", "Title", 1, "Title"), ("paragraph", "first", 1, "Title"), ("heading", "Part", 1, "Part"),
        ("list_item", "item", 1, "Part"), ("heading", "Again", 2, "Again"), ("paragraph", "last", 2, "Again"),
    ]
    assert rows[1].element_id == digest("el", "d", "1", "first")


def greedy(elements, limit):
    groups, current = [], []
    for e in elements:
        if current:
            size = sum(len(x[3]) for x in current) + len(current) + len(e[3])
            atomic = {"table", "figure"}
            if (e[4], e[5]) != (current[0][4], current[0][5]) or size > limit or e[2] in atomic or current[0][2] in atomic:
                groups.append(current)
                current = []
        current.append(e)
    return groups + ([current] if current else [])


def test_structural_fold_equals_sequential_definition(spark):
    rng = random.Random(11)
    documents = []
    for d in range(12):
        page, section, elements = 1, None, []
        for i in range(rng.randint(0, 25)):
            if rng.random() < 0.15:
                page += 1
            if rng.random() < 0.2:
                section = rng.choice([None, "s", "t"])
            kind = rng.choice(["paragraph"] * 8 + ["table", "figure"])
            elements.append((f"e{d}-{i}", i, kind, "x" * rng.randint(1, 30), page, section))
        documents.append((f"d{d}", elements))
    df = spark.createDataFrame(documents, f"document_id string, elements {ELEMENT}")
    got = {}
    for r in chunking.structural_chunks(df, max_characters=60).orderBy("document_id", "position").collect():
        got.setdefault(r.document_id, []).append((r.chunk_id, r.element_ids, r.text, r.page, r.section))
    for name, elements in documents:
        want = [
            (digest("ch", name, "60", *[e[0] for e in g]), [e[0] for e in g], "\n\n".join(e[3] for e in g), g[0][4], g[0][5])
            for g in greedy(elements, 60)
        ]
        assert got.get(name, []) == want


@pytest.mark.parametrize("header_limit", [300, 5])
def test_sheet_fold_repeats_the_header(spark, header_limit):
    rows = [("h", 1, "cab;ecalho")] + [(f"r{i}", i, "v" * (3 + i % 7)) for i in range(2, 14)]
    sheets = spark.createDataFrame([("d", "s", rows), ("one", "s", rows[:1]), ("none", "s", [])], f"document_id string, sheet string, rows {ROW}")
    out = chunking.spreadsheet_chunks(sheets, max_characters=30, max_header_characters=header_limit)
    got = {(r.document_id, r.position): r for r in out.collect()}
    assert not any(d == "none" for d, _ in got)
    assert got[("one", 0)].header_row is None and got[("one", 0)].text == "cab;ecalho"
    header = rows[0] if len(rows[0][2]) <= header_limit else None
    data, groups, current = (rows[1:] if header else rows), [], []
    render = lambda part: "\n".join(([header[2]] if header else []) + [r[2] for r in part])
    for r in data:
        if current and len(render([*current, r])) > 30:
            groups.append(current)
            current = []
        current.append(r)
    groups.append(current)
    assert [got[("d", i)].text for i in range(len(groups))] == [render(g) for g in groups]
    assert [(got[("d", i)].row_start, got[("d", i)].row_end) for i in range(len(groups))] == [(g[0][1], g[-1][1]) for g in groups]


def test_format_dispatch(spark):
    schema = (
        "document_id string, elements array<struct<element_id:string,ordinal:int,kind:string,text:string,page:int,"
        "section:string,parser:string,sheet:string,row:int>>"
    )
    sheet = [("a", 0, "table", "h", None, "S", "xlrd-rows-v1", "S", 1), ("b", 1, "table", "v", None, "S", "xlrd-rows-v1", "S", 2)]
    prose = [("c", 0, "paragraph", "p", 1, None, "pymupdf-blocks-v1", None, None), ("d", 1, "table", "v", 1, None, "xlrd-rows-v1", "S", 2)]
    df = spark.createDataFrame([("x", sheet), ("y", prose)], schema)
    got = sorted((r.document_id, r.strategy, r.text) for r in chunking.chunk_by_format(df).collect())
    assert got == [("x", chunking.SPREADSHEET, "h\nv"), ("y", chunking.STRUCTURAL, "p"), ("y", chunking.STRUCTURAL, "v")]


def test_length_profile_and_statuses(spark):
    values = list(range(1, 101))
    df = spark.createDataFrame([("a" if v % 2 else "b", v) for v in values], "m string, n int")
    rows = {r.name: r for r in profiles.length_profile(df, "n", "m", {"p50": 0.5, "p95": 0.95}, limit=90).collect()}
    assert (rows["all"].p50, rows["all"].p95, rows["all"].truncated_count) == (50, 95, 10)
    assert (rows["a"]["count"], rows["a"].min, rows["a"].max) == (50, 1, 99)
    states = [(".pdf", 0, 2), (".pdf", 0, 0), (".xls", 0, 0), (".xlsx", 3, 0)]
    files = spark.createDataFrame(states, "s string, e int, p int")
    status = profiles.extraction_status(F.col("s"), F.col("e"), F.col("p"), F.lit(False), F.lit(None).cast("string"))
    assert [r[0] for r in files.select(status).collect()] == ["needs_ocr", "empty_document", "empty", "extracted"]
