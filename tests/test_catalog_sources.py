import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from evidencelake.functions import validity
from evidencelake.operators import catalog, review, temporal
from evidencelake.sources import files, parsers, tables

ENTRY = {
    "document_id": "a", "content_sha256": "0" * 64, "relative_paths": ["x/a.pdf"], "media_type": "application/pdf",
    "size_bytes": 3, "review_status": "reviewed", "title": "T", "family": "F", "organization": "O", "version": "1",
    "published_at": None, "effective_from": "2024-01-01", "effective_until": None, "supersedes": [],
}


def write(tmp_path, *entries, version=1):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"schema_version": version, "entries": entries}))
    return str(path)


def test_catalog_round_trip_and_dates(spark, tmp_path):
    other = {**ENTRY, "document_id": "b", "content_sha256": "1" * 64, "effective_from": "2024-02-01T23:30:00-03:00"}
    rows = {r.document_id: r for r in tables.read_catalog(spark, write(tmp_path, ENTRY, other)).collect()}
    assert rows["b"].effective_from == dt.date(2024, 2, 1)


@pytest.mark.parametrize(
    "change",
    [
        {"content_sha256": "0"}, {"size_bytes": -1}, {"relative_paths": []}, {"title": None}, {"supersedes": ["a"]},
        {"supersedes": ["zz"]}, {"effective_until": "2023-01-01"}, {"review_status": "done"}, {"effective_from": "nope"},
    ],
)
def test_invalid_catalogs_are_rejected(spark, tmp_path, change):
    with pytest.raises(ValueError):
        tables.read_catalog(spark, write(tmp_path, {**ENTRY, **change}))


def test_duplicates_cycles_and_versions_are_rejected(spark, tmp_path):
    twin = {**ENTRY, "document_id": "b"}
    with pytest.raises(ValueError):
        tables.read_catalog(spark, write(tmp_path, ENTRY, twin))
    ring = [{**ENTRY, "document_id": n, "content_sha256": c * 64, "supersedes": [t]} for n, c, t in
            (("a", "0", "b"), ("b", "1", "c"), ("c", "2", "a"))]
    with pytest.raises(ValueError, match="circle"):
        tables.read_catalog(spark, write(tmp_path, *ring))
    with pytest.raises(ValueError, match="schema"):
        tables.read_catalog(spark, write(tmp_path, ENTRY, version=2))


def test_long_chains_have_no_cycle(spark):
    links = spark.createDataFrame([(f"d{i}", f"d{i + 1}") for i in range(11)], "document_id string, target string")
    assert catalog.on_or_before_cycle(links).count() == 0


def test_snapshots_equal_brute_force(spark):
    base = dt.date(2023, 1, 15)
    rows = [(i, base + dt.timedelta(days=17 * i), base + dt.timedelta(days=17 * i + 13 * (i % 9)) if i % 4 else None)
            for i in range(30)] + [(99, None, None)]
    dates = [base + dt.timedelta(days=d) for d in (0, 16, 17, 200, 480, 900)]
    entries = spark.createDataFrame(rows, "document_id int, effective_from date, effective_until date")
    asked = spark.createDataFrame([(d,) for d in dates], "reference_date date")
    got = {(r.reference_date, r.document_id) for r in temporal.snapshots(entries, asked).collect()}
    assert got == {(d, i) for d in dates for i, s, e in rows if s and s <= d and (e is None or d <= e)}


def test_refresh_states(spark):
    inventory = spark.createDataFrame(
        [("b", 1, "h1", "m"), ("a", 1, "h1", "m"), ("c", 2, "h2", "m"), ("d", 3, "h3", "m")],
        "relative_path string, size_bytes bigint, content_sha256 string, media_type string",
    )
    previous = spark.createDataFrame(
        [("h1", "one", "reviewed", 1), ("h2", "two", "missing", 2), ("h9", "nine", "reviewed", 9)],
        "content_sha256 string, document_id string, review_status string, size_bytes bigint",
    )
    got = {r.document_id: (r.review_status, r.first_path, r.copy_count) for r in catalog.refresh(inventory, previous).collect()}
    assert got == {
        "one": ("reviewed", "a", 2), "two": ("pending", "c", 1), "nine": ("missing", None, 0), "doc-h3": ("pending", "d", 1),
    }


def test_inventory_and_fingerprint(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.PDF").write_bytes(b"one")
    (tmp_path / "in" / "b.xlsx").write_bytes(b"two")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    rows = {r.relative_path: r for r in files.inventory(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"sub/a.PDF", "b.xlsx"}
    assert rows["sub/a.PDF"].media_type == "application/pdf"
    files.verify_fingerprint(spark, str(tmp_path / "in" / "b.xlsx"), rows["b.xlsx"].content_sha256)
    with pytest.raises(ValueError):
        files.verify_fingerprint(spark, str(tmp_path / "in" / "b.xlsx"), "0" * 64)


def test_chunk_files(spark, tmp_path):
    chunks = spark.createDataFrame(
        [("c1", "a", "um", 1, None), ("c2", "a", "dois", 2, "s")], "chunk_id string, document_id string, text string, page int, section string"
    )
    entries = spark.createDataFrame([("a", "1", None, None, "m")], "document_id string, version string, effective_from date, effective_until date, media_type string")
    target = str(tmp_path / "chunks")
    tables.write_chunks(tables.chunk_records(chunks, entries, "2024-01-01"), target)
    rows = tables.read_chunks(spark, target)
    assert {(r.chunk_id, r.text, str(r.reference_date)) for r in rows.collect()} == {("c1", "um", "2024-01-01"), ("c2", "dois", "2024-01-01")}
    both = rows.unionByName(rows.withColumn("reference_date", F.to_date(F.lit("2024-02-01"))))
    assert tables.unique_chunks(both).count() == 2
    with pytest.raises(Exception, match="other text"):
        tables.unique_chunks(both.withColumn("text", F.concat("text", F.col("reference_date").cast("string")))).collect()


def test_reports_are_private_single_rows(spark, tmp_path):
    target = tmp_path / "r.local.json"
    tables.write_report(spark.range(3).agg(F.count("*").alias("n")), str(target))
    assert json.loads(target.read_text()) == {"n": 3}
    with pytest.raises(ValueError):
        tables.write_report(spark.range(1), str(tmp_path / "r.json"))
    with pytest.raises(ValueError):
        tables.write_report(spark.range(3), str(target))


def test_parser_plugins_isolate_failures(spark):
    def lines(content):
        for number, line in enumerate(content.decode().split("\n"), start=1):
            yield None, "Sheet", number, "table", line

    rows = [("a", "text/x", b"um\ndois"), ("b", "TEXT/X; charset=utf-8", b"\xff"), ("c", "unknown", b"")]
    df = spark.createDataFrame(rows, "document_id string, media_type string, content binary")
    got = parsers.parse_files(df, {"text/x": lines}).collect()
    assert [(r.row, r.text) for r in got if r.document_id == "a"] == [(1, "um"), (2, "dois")]
    assert {r.document_id: r.error_type for r in got if r.error_type} == {"b": "UnicodeDecodeError", "c": "KeyError"}


def test_label_mapping(spark):
    labels = spark.createDataFrame([("Manual Ção", "d1"), ("manual-cao", "d1"), ("Norma", "d2"), ("norma", "d3")], "label string, document_id string")
    asked = spark.createDataFrame([("x", "MANUAL ção!"), ("y", "Norma"), ("z", "nada")], "candidate_id string, label string")
    got = {r.candidate_id: (r.status, r.document_id) for r in review.map_labels(asked, review.label_index(labels)).collect()}
    assert got == {"x": ("mapped", "d1"), "y": ("ambiguous", None), "z": ("missing", None)}


def test_catalog_date(spark):
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-02T03:04:05+09:00",), ("x",)], "s string")
    assert [r[0] for r in df.select(validity.catalog_date(F.col("s"))).collect()] == [dt.date(2024, 1, 2), dt.date(2024, 1, 2), None]


def test_written_catalogs_are_read_again(spark, tmp_path):
    entry = {**ENTRY, "relative_paths": ["a.txt", "b.txt"]}
    entries = tables.read_catalog(spark, write(tmp_path, entry))
    tables.write_catalog(entries, str(tmp_path / "stored"))
    again = tables.read_catalog(spark, str(tmp_path / "stored"))
    assert again.select(*entries.columns).collect() == entries.collect()
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_catalog(entries, str(tmp_path / "stored"))
