"""Every registered query against its SQL counterpart on the small tables."""

from __future__ import annotations

import os

import pytest

from tallyscope.plans import oracles, registry
from tests.oracle_check import compare, connect

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return connect(FOLDER)


def test_every_counterpart_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


# a sample of each layer; tests/oracle_check.py runs all of them
@pytest.mark.parametrize(
    "name",
    ["csv_infer", "missing_summary", "kpi_overview", "column_stats", "type_scores",
     "grouped_comparison_by_region", "ranked_groups_by_region", "diagnostic_findings",
     "trend_by_dimension", "forecast_projection_by_nation", "forecast_findings_events",
     "recommendations_by_region", "narrative_sections", "narrative_quality"],
)
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) == ""
