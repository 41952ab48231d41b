import duckdb
import pytest

import __spark_entry__ as contract
from evidencelake.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
CHECKED = [
    "tokenize_terms", "dense_topk", "catalog_access_reason", "rule_overlap_audit", "structural_chunks", "query_plan_steps",
    "graph_admission", "response_validation", "hash_stratified_split",
]


def test_every_oracle_belongs_to_a_query():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    own_queries, own_oracles = registry.load()
    assert set(own_queries) == set(own_oracles)


def test_entry_has_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.columns == ["query_id", "status", "rank", "chunk_id", "score", "document_id"]
    assert df.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_their_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    df = contract.queries()[name](spark, SMALL)
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(map(str, df.select(*columns).toPandas().itertuples(index=False, name=None)))
    want = sorted(map(str, cursor.df()[columns].itertuples(index=False, name=None)))
    assert got == want
