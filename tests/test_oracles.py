"""Queries against their SQL on the smallest tables. WEFT_ORACLES=all runs every one."""

import os

import pytest
from conftest import same_rows

from weftlake.plans.registry import ORACLE_SQL, QUERIES

SOME = """orphan_check corpus_summary_country topic_distribution coauthor_edges grouping_sets_counts valid_cube_rows mine_windows
association_rules incremental_equals_full country_growth rank_emerging link_heuristics vector_topk ndcg_at_10 waterfill_quotas""".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL) if os.environ.get("WEFT_ORACLES") == "all" else SOME)
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, "/root/testdata/sf0.001").toArrow(), duck.sql(ORACLE_SQL[name]).to_arrow_table())


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
