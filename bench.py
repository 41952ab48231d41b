"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

import pyarrow.parquet as pq

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evidencelake.plans import registry  # noqa: E402
from evidencelake.session import build_session  # noqa: E402

HEADLINE = (
    "term_statistics", "bm25_topk", "gated_retrieval", "dense_topk", "rrf_fusion", "ranking_metrics_chunk",
    "diagnostics_grouping_sets", "signal_distribution", "threshold_sweep", "two_signal_grid", "catalog_refresh_merge",
    "temporal_snapshot_join", "temporal_bm25_topk", "rule_resolution", "rule_overlap_audit", "structural_chunks",
    "chunk_length_profile", "query_plan_steps", "graph_paths_forward", "graph_gateway", "decomposition_execution",
    "context_budget_selection", "response_validation", "structured_fact_verifier",
)


def in_row_groups(folder: str, target: str, groups: int) -> str:
    """The tables of a folder, written with several row groups each; the given ones have one, which no scan can split."""
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        if os.path.isdir(path):
            return folder  # tables of several files are split already
        table = pq.read_table(path)
        pq.write_table(table, os.path.join(target, os.path.basename(path)), row_group_size=max(1, -(-table.num_rows // groups)))
    return target


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    with tempfile.TemporaryDirectory(prefix="bench-") as target:
        run(given, in_row_groups(given, target, 4 * int(os.environ.get("BENCH_CPUS", "8"))))


def run(given: str, folder: str) -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        extra={
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.sql.files.maxPartitionBytes": "2m",  # as many splits as cores, of small tables
            "spark.sql.files.openCostInBytes": "262144",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry.load()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    # compile every plan once on the smallest data, so that the runs below are warm
    smallest = os.path.join(os.path.dirname(given.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        for name in names:
            queries[name](spark, smallest).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
