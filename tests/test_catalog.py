import pytest
from sqlcheck import spark_rows, sql_rows

import loomgraph.plans.java_queries  # noqa: F401 - registers its queries
import loomgraph.plans.project_reports  # noqa: F401 - registers its queries
import loomgraph.plans.source_calls  # noqa: F401 - registers its queries
import loomgraph.plans.summaries  # noqa: F401 - registers its queries
import loomgraph.plans.workspace_queries  # noqa: F401 - registers its queries
from loomgraph.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == sql_rows(SMALL, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
