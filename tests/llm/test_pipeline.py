import __spark_entry__ as contract
import corpus_pipeline
from evidencelake.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = contract.queries()
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.ORACLES) <= set(names)


def test_stages_pass_documents_on(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        if number < 4:
            assert docs.columns == columns, name
            counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] <= counts[4]
    mixed = spark.read.parquet(f"{tmp_path}/3")
    assert mixed.select("doc_id").distinct().count() == counts[3]
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in mixed.collect()}
    redacted = [r for r in spark.read.parquet(f"{tmp_path}/2").collect() if "@mail" in texts[r["doc_id"]]]
    assert all("@mail" not in r["text"] for r in redacted)
    deduplicated = [r["text"] for r in spark.read.parquet(f"{tmp_path}/1").collect()]
    assert len(set(deduplicated)) == len(deduplicated)


def test_stages_take_odd_and_empty_tables(odd, odd_texts, none):
    """Every stage by itself on nulls, repeated rows, very long texts and columns with clashing names, and on no row."""
    counts = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(odd.sparkSession, odd, SMALL)
        rows = found.collect()
        counts.append(len(rows))
        assert stage(odd.sparkSession, none, SMALL).collect() == [], name
        if number < 4:
            assert found.columns == odd.columns, name
    assert counts[0] <= len(odd_texts) and counts[2] == len(odd_texts) and counts[3] >= len(odd_texts) and counts[4] >= len(odd_texts)
    # the least of equal texts stays: null and empty texts, two times "word", two times the same prose
    assert counts[1] == len({t or "" for t in odd_texts})
