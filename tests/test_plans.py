"""Plan checks: no cartesian products or nested-loop
joins in the big plans; filters and column pruning reach the Parquet scan."""

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["prepare_dataset", "find_similar", "line_pairs", "unique_pairs", "token_counts"])
def test_no_cartesian(spark, name):
    p = _plan(e.queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_pushdown_and_pruning(spark):
    p = _plan(e.queries()["filter_dates"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp" in p


@pytest.mark.parametrize("name", ["prepare_dataset", "line_pairs"])
def test_inputs_are_not_read_again_and_again(spark, name):
    """What several steps need is stored once: the final plan reads stored tables, not the documents."""
    p = _plan(e.queries()[name](spark, SF))
    assert p.count("/documents.parquet") <= 2 and p.count("/labels.parquet") <= 2
