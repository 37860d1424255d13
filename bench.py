"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 1 after one warm-up), BENCH_DUCKDB=0 leaves out the SQL times,
BENCH_ALL=1 runs every registered query.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ontoweave.catalog import ORACLES, QUERIES  # noqa: E402
from ontoweave.session import local_session  # noqa: E402

HEADLINE = [
    "filter_operators", "search_text", "link_two_hop", "link_composite_key", "account_balance_view", "customer_risk_view",
    "rule_first_match_batch", "rule_all_with_reasons", "guard_sla", "profile_pivot", "dedupe_last_wins", "asof_effective", "bracket_lookup",
    "sequence_running_total", "topk_per_group", "reconcile_diff", "emergency_affected_facilities", "toll_build_graph", "toll_compute_fees",
    "grid_search_sources", "grid_filter_sources", "grid_score_plans", "payroll_calculate", "payroll_cumulative_withholding",
    "launch_next_executable", "alarm_chain_judgement", "search_bm25", "doc_terms", "vector_search", "relation_shared_references",
    "graph_components", "graph_pagerank",
]
COMPARED = list(HEADLINE)  # with their SQL in DuckDB; the plans below are all-pairs statements there
HEADLINE += [
    "search_recall", "toll_find_paths", "graph_shortest_paths", "graph_bounded_paths", "scheme_ranked", "relation_semantic",
    "relation_soft_terms", "relation_groups", "relation_title_citations",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def duckdb_times(names: list[str], sf: str) -> dict[str, float]:
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    out = {}
    for name in names:
        if name in ORACLES:
            start = time.perf_counter()
            con.execute(ORACLES[name]).fetchall()
            out[name] = round(time.perf_counter() - start, 3)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cpus)
    run(spark, "profile_distribution", sf)
    times = {}
    for name in names:
        run(spark, name, sf)
        times[name] = round(statistics.median(run(spark, name, sf) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    line = {"metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf)}
    if os.environ.get("BENCH_DUCKDB", "1") == "1":
        line["duckdb"] = duckdb_times([n for n in names if n in COMPARED], sf)
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
