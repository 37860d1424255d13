"""Registered queries against their SQL on the smallest tables."""

import pytest

from ontoweave.catalog import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
# Slower plans that share their parts with listed ones; tests/run_oracles.py runs everything.
SLOW = {
    "scheme_no_solution", "scheme_feeder_transfers", "scheme_transformer_transfers", "grid_finalize_plans", "grid_compose_plans", "relation_stats",
    "relation_context", "payroll_items", "search_source_histogram", "doc_term_kinds", "toll_compute_fees", "alarm_chain_features", "launch_node_status",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ok, note = compare(df, con, ORACLES[name])
        assert ok, note
    else:
        assert df.count() >= 0


def test_names_are_unique_and_checked():
    assert len(QUERIES) > 100 and set(ORACLES) <= set(QUERIES)
    assert {"doc_markdown_chunks", "doc_sections", "doc_metadata", "doc_best_year"} == set(QUERIES) - set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= entry.oracle_sql().keys()
