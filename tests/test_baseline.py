import pytest
from pyspark.sql import functions as F

from undertow.operators import baseline, rebuild
from undertow.operators.baseline import Baseline
from undertow.plans import MODELS, Warehouse
from undertow.sources.sinks import refresh

NAMES = ["stg_orders", "stg_refunds", "stg_fx_rates", "stg_order_items", "stg_promotions"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    w = Warehouse(spark, "/root/testdata/sf0.001")
    made = Baseline(w, str(tmp_path_factory.mktemp("stored")), 16)
    made.store(NAMES)
    return made


def test_levels_read_earlier_levels_only():
    found = baseline.levels(MODELS)
    assert sorted(sum(found, [])) == sorted(MODELS)
    seen = set()
    for level in found:
        assert not any(t in MODELS and t not in seen for n in level for t in MODELS[n].reads)
        seen |= set(level)
    assert baseline.levels([]) == []


def test_lists_agree_with_whole_checksums(stored):
    from undertow.functions.summaries import contents

    df = stored.production(NAMES)["stg_orders"]
    got = stored.listed("stg_orders").agg(F.count("*"), F.sum("row_count"), F.sum("checksum")).first()
    assert tuple(got) == (16, *contents(df).first())
    assert stored.compare("stg_orders", df.repartition(5)) == (None, "identical")


def test_only_the_buckets_of_changed_rows_differ(stored):
    df = stored.production(NAMES)["stg_orders"]
    key = next(c.column for c in MODELS["stg_orders"].checks if c.kind == "unique")
    one = df.agg(F.min(key)).first()[0]
    other = next(c for c in df.columns if c != key and dict(df.dtypes)[c] == "string")
    altered = df.withColumn(other, F.when(F.col(key) == one, F.lit("never seen")).otherwise(F.col(other)))
    assert stored.compare("stg_orders", altered) == ("degraded", "same row count, contents differ in 1 of 16 buckets")
    ours, theirs = stored.differing_rows("stg_orders", altered)
    assert 0 < ours.count() == theirs.count() < df.count()
    assert tuple(rebuild.row_differences(ours, theirs).first()) == (1, 1)
    impact, detail = stored.compare("stg_orders", df.where(F.col(key) != one))
    assert impact == "degraded" and "(-1), in 1 of 16 buckets" in detail
    assert stored.compare("stg_orders", df.drop(other)) == ("degraded", "columns differ")
    assert stored.compare("stg_orders", df.limit(0))[0] == "degraded"


def test_tables_without_rows_and_repeated_rows(spark, tmp_path):
    made = Baseline(Warehouse(spark, "/root/testdata/sf0.001"), str(tmp_path), 4)
    df = spark.createDataFrame([(1, None), (1, None), (None, "b")], "promotion_id bigint, other string")
    refresh(df.limit(0), f"{tmp_path}/stg_promotions")
    assert made.compare("stg_promotions", df.limit(0)) == (None, "identical")
    assert made.compare("stg_promotions", df)[1].startswith("3 rows against 0 (+3)")
    refresh(df, f"{tmp_path}/stg_promotions")  # the list of the version before is not used for this one
    assert made.compare("stg_promotions", df) == (None, "identical")
    assert made.compare("stg_promotions", df.distinct())[0] == "degraded"
    assert made.vacuum("stg_promotions") == 1 and made.compare("stg_promotions", df) == (None, "identical")


def test_nothing_of_a_stored_production_is_built_again(stored):
    production = stored.production(NAMES)
    fault = rebuild.Fault("null_out_column", "raw_refunds", "amount")
    got = rebuild.classify(production, fault, ["stg_refunds"], stored).collect()
    assert [tuple(r) for r in got] == [("stg_refunds", "degraded", got[0]["detail"])] and "buckets" in got[0]["detail"]
    assert production._kept == set(NAMES)  # nothing was added: keep() has written no model of production
    shadow = rebuild.overlay(production, fault)
    assert shadow._kept == set(NAMES) - set(rebuild.scope(fault))
    assert shadow["stg_orders"] is production["stg_orders"] and shadow["stg_refunds"] is not production["stg_refunds"]


def test_both_ways_of_comparing_agree(stored, w):
    fault = rebuild.Fault("null_out_column", "raw_orders", "channel")
    with_lists = rebuild.cascade(stored.production(NAMES), fault, ["stg_orders"], stored).drop("detail").collect()
    assert with_lists == rebuild.cascade(w, fault, ["stg_orders"]).drop("detail").collect()
