"""The plans the models get when no side is small enough to broadcast."""

import re

import pytest

from undertow.functions.summaries import percentile_cont
from undertow.operators import knockout
from undertow.plans import CONSUMERS, MODELS, Warehouse


@pytest.fixture(scope="module")
def large(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Warehouse(spark, "/root/testdata/sf0.001")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_model_pairs_rows_without_a_key_or_leaves_the_engine(large):
    for name in MODELS:
        text = plan(large[name])
        assert not re.search("CartesianProduct|NestedLoop|BroadcastHashJoin|Python|Pandas", text), name


def test_no_consumer_sorts_everything_to_take_a_few(large):
    for c in CONSUMERS.values():
        text = plan(c.run(*[large[t] for t in c.reads]))
        if "limit" in text.lower() and "GlobalLimit" in text:
            assert "TakeOrdered" in text, c.name


def test_scans_read_only_the_columns_that_are_used(large):
    text = plan(large["raw_orders"].where("status = 'completed'").select("order_id"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_filters_reach_the_scan(large):
    text = plan(large["ev_page_views"].select("event_id"))
    assert "EqualTo(event_type,view)" in text


def test_equal_values_are_counted_before_they_move(large):
    text = plan(percentile_cont(large["stg_shipments"], ["carrier_id"], "transit_days", 0.5, "m"))
    assert "partial_count" in text


def test_top_texts_are_cut_before_the_exchange(large):
    assert "WindowGroupLimit" in plan(knockout.top_queries(large["lin_usage"]))
