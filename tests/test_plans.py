"""Plan guards: the physical plans keep the properties the scale design relies on."""

import re

import pytest

from tipflow.plans.registry import queries

from .conftest import SF_SMALL

FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|"
                       r"FlatMapGroupsInPandas|MapInPandas")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(queries()))
def test_no_cross_join_or_python_in_plan(spark, key):
    p = plan(queries()[key](spark, SF_SMALL))
    assert not FORBIDDEN.search(p), FORBIDDEN.findall(p)


@pytest.mark.parametrize("key", ["top_collaborators", "collaborator_lookup", "collaborators_active",
                                 "collaborators_all", "topup_history_page"])
def test_topk_has_partial_group_limit(spark, key):
    df = queries()[key](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p


def test_scan_pushdown_and_pruning(spark):
    df = queries()["weekly_topups"](spark, SF_SMALL)
    p = plan(df)
    scan = [line for line in p.splitlines() if "FileScan parquet" in line and "credit" in line]
    assert scan, p
    assert "credit_date" in scan[0] and "PushedFilters" in scan[0]
    assert "EqualTo(sit_id,1)" in scan[0]
    read_schema = re.search(r"ReadSchema: struct<([^>]*)>", scan[0]).group(1)
    assert set(re.findall(r"(\w+):", read_schema)) == {"usr_id", "cli_id", "credit_value", "credit_date", "sit_id"}
