"""Data tests: many checks in one exchange, each with the failures it has by itself."""

import re

from undertow.operators import quality
from undertow.plans import MODELS
from undertow.plans.warehouse import Check, Model


def test_unique_checks_of_all_models_share_one_exchange(spark):
    one = spark.createDataFrame([(1, "a", 1.5), (1, "b", None), (2, "b", 1.5), (None, None, 0.25), (None, "é", 2.0)], "id bigint, code string, x double")
    two = spark.createDataFrame([("1",), ("2",)], "id string")
    def checks(*columns):
        return tuple(Check("unique", c) for c in columns) + (Check("not_null", columns[0]),)
    models = [Model("one", "s", (), None, {}, checks("id", "code", "x")), Model("two", "s", (), None, {}, checks("id"))]
    models.append(Model("none", "s", (), None, {}, (Check("not_null", "id"),)))
    report = quality.report({"one": one, "two": two, "none": None}, models, "unique")
    got = {(r["model"], r["column_name"]): r["failures"] for r in report.collect()}
    assert got == {("one", "id"): 1, ("one", "code"): 1, ("one", "x"): 1, ("two", "id"): 0}
    plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(check#\d+, key#\d+", plan)) == 1
    missing = quality.report({"one": one, "two": two, "none": one}, models, "not_null")
    assert {r["model"]: r["failures"] for r in missing.collect()} == {"one": 2, "two": 0, "none": 2}


def test_the_report_has_the_failures_of_each_check(spark, w):
    names = ["stg_orders", "stg_payments", "int_merchant_daily"]
    for kind in ("unique", "not_null"):
        got = {(r["model"], r["column_name"]): r["failures"] for r in quality.report({n: w[n] for n in names}, [MODELS[n] for n in names], kind).collect()}
        each = {(n, c.column): quality.failures(w[n], c).first()[0] for n in names for c in MODELS[n].checks if c.kind == kind}
        assert got == each and each
