import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evidencelake.operators import ingestion

DAYS = [dt.date(2024, 1, 1), dt.date(2025, 1, 1)]
ENTRY = "document_id string, content_sha256 string, relative_paths array<string>, media_type string, review_status string, title string, version string, effective_from date, effective_until date"


def sha(content):
    return hashlib.sha256(content).hexdigest()


def entry(name, content, *, paths=None, kind="text/plain", status="reviewed", title="t", start=dt.date(2023, 1, 1), end=None):
    return (name, sha(content), paths or [f"{name}.txt"], kind, status, title, "v1", start, end)


@pytest.fixture
def tables(spark):
    def build(entries, files):
        return spark.createDataFrame(entries, ENTRY), spark.createDataFrame(files, "relative_path string, content binary")

    return build


@pytest.fixture
def corpus(tables):
    good, moved, sheet = b"# Title\n\nA first block.\n\nA second one.", b"moved text", b"rows"
    entries = [
        entry("good", good),
        entry("future", good, start=dt.date(2024, 6, 1)),
        entry("old", good, end=dt.date(2024, 1, 1)),
        entry("pending", good, status="pending"),
        entry("moved", moved, paths=["gone/moved.txt"]),
        entry("outside", moved, paths=["../secret.txt"]),
        entry("lost", b"nowhere"),
        entry("edited", b"before the edit"),
        entry("untitled", good, title=None),
        entry("blank", b" \n\n \f "),
        entry("sheet", sheet, kind="Application/X-Rows; v=1"),
        entry("broken", b"broken", kind="application/x-rows"),
        entry("picture", b"png", kind="image/png"),
        entry("typeless", b"what", kind=None),
    ]
    files = [
        *((f"{name}.txt", good) for name in ("good", "future", "old", "untitled")),
        ("elsewhere/moved.txt", moved), ("edited.txt", b"after the edit"), ("blank.txt", b" \n\n \f "), ("sheet.txt", sheet),
        ("broken.txt", b"broken"), ("picture.txt", b"png"), ("typeless.txt", b"what"), ("empty.txt", None),
    ]
    return tables(entries, files)


def rows_parser():
    def parse(content):
        if content == b"broken":
            try:
                raise KeyError("inner")
            except KeyError as error:
                raise RuntimeError("outer") from error
        for number in range(3):
            yield None, "Sheet 1", number + 1, "row", f"{content.decode()} {number}"

    return parse


def test_every_entry_has_one_outcome_on_every_date(corpus, tmp_path):
    run = ingestion.Run(*corpus, DAYS, f"file://{tmp_path}/run", parsers={"application/x-rows": rows_parser()})
    got = {(r.document_id, r.reference_date.year): (r.status, r.reason, r.chunk_count > 0) for r in run.outcomes().collect()}
    error = lambda reason: ("error", reason, False)
    both = {
        "good": ("processed", None, True), "pending": ("not_reviewed", None, False), "moved": ("processed", None, True),
        "outside": ("processed", None, True), "lost": error("missing_source"), "edited": error("content_mismatch"),
        "untitled": error("invalid_entry"), "blank": ("empty", None, False), "sheet": ("processed", None, True),
        "broken": error("KeyError"), "picture": error("unsupported_media_type"), "typeless": error("unsupported_media_type"),
    }
    wanted = {(name, year): outcome for name, outcome in both.items() for year in (2024, 2025)}
    wanted |= {("future", 2024): ("not_yet_effective", None, False), ("future", 2025): ("processed", None, True)}
    wanted |= {("old", 2024): ("processed", None, True), ("old", 2025): ("expired", None, False)}
    assert got == wanted
    counts = {(r.reference_date.year, r.status, r.reason): r.documents for r in ingestion.summary(run.outcomes()).collect()}
    assert counts[2024, "processed", ""] == 5 and counts[2024, "error", "content_mismatch"] == 1


def test_a_run_is_committed_once_and_changes_replace_whole_dates(spark, corpus, tables, tmp_path):
    entries, files = corpus
    target = f"file://{tmp_path}/table"
    first = ingestion.Run(entries, files, DAYS, f"file://{tmp_path}/a")
    state = ingestion.commit_snapshots(first.records(), target, version=1)
    assert {r.reference_date: r.written for r in state.collect()} == dict.fromkeys(DAYS, True)
    before = sorted(map(str, spark.read.parquet(f"{target}/chunks").collect()))
    assert len(before) == sum(r.rows for r in state.collect())
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "table/chunks").rglob("*.parquet")}

    again = ingestion.commit_snapshots(ingestion.Run(entries, files, DAYS, f"file://{tmp_path}/b").records(), target, version=2)
    assert not any(r.written for r in again.collect())
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "table/chunks").rglob("*.parquet")} == kept

    # one document ends, so only the later date is another one
    ended = entries.withColumn("effective_until", F.when(F.col("document_id") == "moved", F.lit(dt.date(2024, 5, 1))).otherwise(F.col("effective_until")))
    later = ingestion.Run(ended.where("document_id <> 'outside'"), files, DAYS[1:], f"file://{tmp_path}/c")
    changed = ingestion.commit_snapshots(later.records(), target, version=3)
    assert [(r.reference_date, r.written) for r in changed.collect()] == [(DAYS[1], True)]
    rows = spark.read.parquet(f"{target}/chunks")
    assert rows.where("document.document_id = 'moved'").select("reference_date").distinct().collect()[0][0] == DAYS[0]
    state = {r.reference_date: r.version for r in ingestion.manifest(spark, target).collect()}
    assert state == {DAYS[0]: 1, DAYS[1]: 3}


def test_a_lost_manifest_is_written_again(spark, corpus, tmp_path):
    """A run that ended between its partitions and its manifest is repeated without harm."""
    run = ingestion.Run(*corpus, DAYS, f"file://{tmp_path}/run")
    ingestion.commit_snapshots(run.records(), f"file://{tmp_path}/t", version=1)
    whole = spark.read.parquet(f"file://{tmp_path}/t/chunks").count()
    (tmp_path / "t/manifest").rename(tmp_path / "t/lost")
    again = ingestion.commit_snapshots(run.records(), f"file://{tmp_path}/t", version=1)
    assert all(r.written for r in again.collect())
    assert spark.read.parquet(f"file://{tmp_path}/t/chunks").count() == whole


def test_results_as_json(corpus, tmp_path):
    run = ingestion.Run(*corpus, DAYS, f"file://{tmp_path}/run")
    got = {r.document_id: json.loads(r.result) for r in ingestion.result_json(run).collect()}
    good = got["good"]
    assert [e["kind"] for e in good["parsed_document"]["elements"]] == ["title", "paragraph", "paragraph"]
    assert good["parsed_document"]["document"] == {"document_id": "good", "effective_from": "2023-01-01", "effective_until": None, "version": "v1"}
    assert good["schema_version"] == 1 and len(good["chunks"]) == 1 and list(good) == sorted(good)
    assert got["blank"]["chunks"] == []


def test_nothing_to_run_on(tables, tmp_path):
    run = ingestion.Run(*tables([], []), DAYS, f"file://{tmp_path}/run")
    assert run.outcomes().collect() == []
    assert ingestion.commit_snapshots(run.records(), f"file://{tmp_path}/t", version=1).collect() == []
