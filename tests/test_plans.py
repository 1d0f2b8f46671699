"""Plan-shape guards: no Python evaluation on the row path, train/test
filters prune partitions, fixed reference tables are broadcast."""

import pytest

import __spark_entry__ as E
from conftest import SMALL

QUERIES = E.queries()
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["neighborhood_profile", "complete_prep", "score_heuristic", "retrofit_whatif",
                                  "ecdf", "text_clean_latin1", "metrics_by_segment", "explain_terms"])
def test_no_python_on_row_path(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    assert not any(n in plan for n in PYTHON_NODES)


@pytest.mark.parametrize("name", ["missing_transform", "target_encode", "winsorize", "onehot"])
def test_test_side_transforms_prune_partitions(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL))
    assert "PartitionFilters: [" in plan and "is_train" in plan


def test_fixed_benchmark_table_is_broadcast(spark):
    plan = _plan(QUERIES["score_heuristic"](spark, SMALL))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
