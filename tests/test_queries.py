"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from factloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(name, same_rows):
    same_rows(name, catalog.QUERIES[name], catalog.SQL[name])


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.QUERIES


def test_queries_use_no_cartesian_join(spark, data):
    """Pairs meet on equal keys only; one-row tables are broadcast."""
    for name in ("er_candidate_scores", "list_match_status", "trigram_similar_pairs", "interval_window_join", "banded_age_join"):
        plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
