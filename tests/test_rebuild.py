import pytest
from pyspark.sql import functions as F

from undertow.operators import faults, grading, publishing, rebuild
from undertow.operators.faults import FaultNotExecutable
from undertow.plans import MODELS, MissingTable, downstream_models
from undertow.sources.contracts import ContractError


def test_each_fault_leaves_the_copy_it_should(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert faults.drop_column(df, "s").columns == ["n"]
    assert dict(faults.change_column_type(df, "n").dtypes)["n"] == "string"
    nulled = faults.null_out_column(df, "n")
    assert dict(nulled.dtypes)["n"] == "int" and nulled.where("n is not null").isEmpty()
    assert faults.faulted(df, "drop_asset") is None


@pytest.mark.parametrize("kind, column", [("drop_column", "zz"), ("change_column_type", "s"), ("no such", "n")])
def test_faults_that_cannot_be_applied_are_refused(spark, kind, column):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    with pytest.raises(FaultNotExecutable):
        faults.faulted(df, kind, column)
    with pytest.raises(FaultNotExecutable):
        faults.drop_column(df.select("n"), "n")


def test_withheld_days_count_back_from_the_newest_row(spark):
    days = [("2024-01-01",), ("2024-01-07",), ("2024-01-08",), ("2024-01-10",), (None,)]
    df = spark.createDataFrame(days, "d string").select(F.to_date("d").alias("d"))
    left = [str(r["d"]) for r in faults.stop_new_rows(df, "d", 3).orderBy("d").collect()]
    assert left == ["2024-01-01", "2024-01-07"]


def test_models_are_registered_in_build_order():
    seen = set()
    for name, m in MODELS.items():
        assert not [r for r in m.reads if r in MODELS and r not in seen]
        for table, columns in m.typed.items():
            assert table in m.reads, (name, table, columns)
        seen.add(name)
    assert len(MODELS) == 57


def test_typed_columns_exist(w):
    for m in MODELS.values():
        for table, columns in m.typed.items():
            assert set(columns) <= set(w[table].columns), (m.name, table)


def test_a_type_regression_stops_readers_that_compute_on_it(w):
    shadow = rebuild.overlay(w, rebuild.Fault("change_column_type", "raw_fx_rates", "rate"))
    assert shadow["stg_fx_rates"] is not None  # only passes the column on
    with pytest.raises(ContractError):
        shadow["int_orders_enriched"]


def test_a_missing_table_and_a_missing_column_make_readers_unavailable(w):
    gone = rebuild.overlay(w, rebuild.Fault("drop_asset", "raw_refunds"))
    with pytest.raises(MissingTable):
        gone["stg_refunds"]
    cut = rebuild.overlay(w, rebuild.Fault("drop_column", "raw_orders", "merchant_id"))
    impact, _ = rebuild.observe(cut, w, "int_merchant_daily")
    assert impact == "unavailable"
    assert rebuild.observe(cut, w, "stg_payments") == (None, "identical")


def test_a_failed_test_stops_everything_below(w):
    fault = rebuild.Fault("null_out_column", "raw_orders", "customer_id")
    got = {r["asset"]: r["impact"] for r in rebuild.cascade(w, fault).collect()}
    assert got.pop("stg_orders") == "degraded"
    assert got and set(got.values()) == {"unavailable"}
    assert set(got) | {"stg_orders"} == set(downstream_models("raw_orders"))


def test_probes_run_without_tests(w):
    fault = rebuild.Fault("null_out_column", "raw_refunds", "amount")
    got = {r["asset"]: r["impact"] for r in rebuild.probes(w, fault).collect()}
    assert set(got) == set(rebuild.scope(fault))
    assert {k: v for k, v in got.items() if v} == {"stg_refunds": "degraded"}


def test_a_stalled_feed_degrades_and_the_counts_say_by_how_much(w):
    fault = rebuild.Fault("stop_new_rows", "raw_orders", "order_ts", 30)
    shadow = rebuild.overlay(w, fault)
    impact, detail = rebuild.observe(shadow, w, "stg_orders")
    assert impact == "degraded" and "rows against" in detail
    diff = rebuild.row_differences(shadow["stg_orders"], w["stg_orders"]).first()
    assert diff["only_rebuilt"] == 0 and diff["only_real"] > 0


def test_consumers_report_the_query_that_broke(w):
    fault = rebuild.Fault("drop_column", "o_mart_capacity_risk", "load_ratio")
    got = rebuild.consumers(rebuild.overlay(w, fault), ["capacity_watch", "carrier_score"]).collect()
    assert [(r["consumer"], r["error"] is None) for r in got] == [("capacity_watch", False), ("carrier_score", True)]


def card(spark, predicted, observed, scope):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "asset string")
    graded = grading.verdicts(one(predicted), one(observed), one(scope), ["asset"])
    return grading.scorecard(graded.withColumn("all", F.lit(1)), ["all"]).first()


def test_grading(spark):
    got = card(spark, ["a", "b", "out"], ["a", "c", "elsewhere"], ["a", "b", "c"])
    assert (got["hits"], got["false_alarms"], got["misses"], got["ungraded"]) == (1, 1, 1, 1)
    assert got["precision"] == 0.5 and got["recall"] == 0.5 and not got["suspicious"]


def test_grading_leaves_undefined_figures_open(spark):
    assert card(spark, [], ["c"], ["c"])["precision"] is None
    assert card(spark, ["a"], [], ["a"])["recall"] is None
    assert card(spark, ["a"], ["a"], ["a"])["suspicious"]


def test_publishing_touches_only_what_is_ours(spark, rows):
    published = spark.createDataFrame(
        [("a", "undertow_score", "1"), ("a", "note", "x"), ("b", "undertow_score", "2")],
        "asset string, property string, value string",
    )
    assert rows(publishing.without_prefix(published)) == [("a", "note", "x")]
    assert publishing.assets_with_prefix(published).first()[0] == 2
    fresh = spark.createDataFrame([("a", "undertow_score", "9")], "asset string, property string, value string")
    once = publishing.upsert(published, fresh, ["asset", "property"])
    assert rows(publishing.upsert(once, fresh, ["asset", "property"])) == rows(once)
    assert ("a", "undertow_score", "9") in rows(once) and ("a", "note", "x") in rows(once)


def test_incidents_repeat_under_the_same_id_and_resolve_without_deletion(spark):
    observed = spark.createDataFrame(
        [("s", "m.a", "degraded"), ("s", "m.b", None), ("s", "lost", "unavailable")],
        "scenario string, asset string, impact string",
    )
    urns = spark.createDataFrame([("m.a", "u2"), ("m.a", "u1"), ("m.b", "u3")], "asset string, urn string")
    raised = publishing.incidents(observed, urns, "t1")
    row = raised.first()
    assert raised.count() == 1 and row["urn"] == "u1" and row["type"] == "FIELD"
    other = raised.withColumn("incident", F.lit("urn:li:incident:theirs"))
    after = publishing.resolve(raised.unionByName(other), "t2").collect()
    assert sorted(r["state"] for r in after) == ["ACTIVE", "RESOLVED"]


def test_an_incident_is_one_row_with_all_its_urns_and_its_evidence(spark):
    observed = spark.createDataFrame([("s.1", "m.a", "unavailable", "no such table"), ("s.1", "m.b", "degraded", None)],
                                     "scenario string, asset string, impact string, detail string")
    urns = spark.createDataFrame([("m.a", "u2"), ("m.a", "u1"), ("m.a", "u2"), ("m.b", "u3"), ("m.b", None)], "asset string, urn string")
    rows = {r["asset"]: r for r in publishing.incidents(observed, urns, "t1", "run 7").collect()}
    assert len(rows) == 2 and rows["m.a"]["urns"] == ["u1", "u2"] and rows["m.b"]["urns"] == ["u3"]
    assert rows["m.a"]["title"] == "m.a is unavailable under s.1" and rows["m.a"]["incident"].endswith("undertow_s_1_m_a")
    assert "no such table" in rows["m.a"]["description"] and rows["m.a"]["description"].endswith("run 7")
    assert "reported" not in rows["m.b"]["description"]
    again = publishing.incidents(observed, urns, "t2")
    assert {r["incident"] for r in again.collect()} == {r["incident"] for r in rows.values()}
