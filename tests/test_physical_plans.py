"""The plans stay the ones wanted at scale."""

import re

from checks.base import dev, log, table, wo
from gapline.operators.cleaning import keep_period
from gapline.operators.history import with_history
from gapline.plans.events import event_control


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_needs_one_exchange(spark, sf):
    text = plan(with_history(log(spark, sf)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert text.count("Sort [") == 1
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_device_table_needs_one_exchange_and_few_columns(spark, sf):
    text = plan(dev(spark, sf))
    assert len(re.findall(r"Exchange", text)) == 1
    assert "ReadSchema: struct<o_orderkey" in text


def test_filters_reach_the_scan(spark, sf):
    text = plan(keep_period(table(spark, sf, "orders"), ("1996-01-01", "1997-01-01"), "o_orderdate"))
    assert "DataFilters: [" in text and "1996-01-01" in text.split("DataFilters")[1]


def test_no_cross_joins(spark, sf):
    text = plan(event_control(wo(spark, sf)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
