"""What the plans must and must not hold."""

import pytest

from __spark_entry__ import queries
from tickforge.operators import gold, silver
from tickforge.plans.queries import BATCH, Market


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(BATCH))
def test_no_cross_joins(spark, sf_dir, name):
    plan = plan_of(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_copies_are_dropped_before_the_shuffle(spark, sf_dir):
    plan = plan_of(silver.silver_trades(Market(spark, sf_dir).bronze))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_spreads_need_no_sort_for_their_quotes(spark, sf_dir):
    """Only the sums per run, which hold a text, are merged by a sort."""
    market = Market(spark, sf_dir)
    plan = plan_of(gold.spread_features(silver.quote_rows(market.bronze)))
    assert "HashAggregate" in plan and plan.count("SortAggregate") <= 2


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(queries()["chunk_documents"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan  # not n_chars
