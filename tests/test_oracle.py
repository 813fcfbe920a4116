"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

from veritloom import queries

from .oracle import difference

# The others build on the same parts; `python -m tests.oracle sf0.01` compares all.
NAMES = [n for n in queries.ORACLE_SQL if n[0] in "TV" or n in ("J3_dense_cosine", "J6_pairwise_threshold", "J7_topk_similarity", "J11_depends_on", "A5_degree", "P1_bfs_discover", "P4_extract_edges_adaptive", "A2_graph_stats", "flagship")]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, name):
    assert difference(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], small) == ""


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
