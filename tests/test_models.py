"""Cases the landed tables do not show, on frames made for them; and SQL agreement at small scale."""

import datetime as dt
from decimal import Decimal

import pytest

from undertow.plans import Warehouse
from undertow.sources.contracts import ContractError, contract
from undertow.sources.tables import scan


def day(n):
    return dt.datetime(2024, 1, n, 12)


@pytest.fixture(scope="module")
def shop(spark):
    """Two customers; one order in a currency with no rate; one customer who never ordered."""
    d = Decimal
    make = lambda role, rows: spark.createDataFrame(rows, contract(role))
    return Warehouse(
        spark,
        "unused",
        {
            "raw_customers": make("raw_customers", [
                (1, "A@X", "A", "us", day(1), "active", True, None, None),
                (2, "B@X", "B", "us", day(1), "closed", True, "gold", None),
                (3, "C@X", "C", "us", day(1), "active", True, "gold", day(2)),
            ]),
            "raw_orders": make("raw_orders", [
                (10, 1, 7, day(3), "completed", "eur", d("10.00"), d("1.00"), d("2.00"), "web"),
                (11, 1, 7, day(3), "completed", "chf", d("10.00"), d("0.00"), d("0.00"), "web"),
            ]),
            "raw_order_items": make("raw_order_items", [(1, 10, 5, 2, d("3.50"), "eur")]),
            "raw_fx_rates": make("raw_fx_rates", [(dt.date(2024, 1, 3), "usd", "eur", d("0.50"), "x")]),
            "raw_payments": make("raw_payments", [
                (20, 10, 1, day(3), day(4), "settled", d("11.00"), "eur", "p", None),
                (21, 10, 1, day(4), None, "declined", d("11.00"), "eur", "p", "no"),
            ]),
            "raw_refunds": make("raw_refunds", [(1, 20, day(5), d("1.00"), "eur", "late"),
                                                (2, 20, day(5), d("2.00"), "eur", "late")]),
            "raw_chargebacks": make("raw_chargebacks", [(1, 20, day(6), None, d("3.00"), "eur", "fraud", "m")]),
        },
    )


def test_orders_are_priced_at_their_own_days_rate(shop):
    got = {r["order_id"]: r for r in shop["int_orders_enriched"].collect()}
    assert float(got[10]["net_amount_usd"]) == 22.0 and float(got[10]["items_amount"]) == 7.0
    assert got[11]["net_amount_usd"] is None and got[11]["item_count"] == 0


def test_soft_deleted_customers_are_gone_and_never_ordered_ones_stay(shop):
    got = {r["customer_id"]: r for r in shop["int_customer_lifetime"].collect()}
    assert set(got) == {1, 2} and got[2]["is_never_ordered"] and got[2]["days_since_last_order"] is None
    assert float(got[1]["lifetime_net_usd"]) == 22.0 and got[1]["lifetime_tier"] == "none"


def test_refunds_and_disputes_do_not_fan_out(shop):
    got = {r["payment_id"]: r for r in shop["int_payment_attempts"].collect()}
    assert len(got) == 2 and got[20]["refund_count"] == 2 and got[20]["has_open_dispute"]
    assert float(got[20]["net_settled_usd"]) == (11 - 3 - 3) / 0.5
    assert float(got[21]["net_settled_usd"]) == 0 and got[21]["amount_usd"] is None


def test_a_day_with_payments_only_is_kept(shop):
    got = {str(r["activity_date"]): r for r in shop["mart_revenue_daily"].collect()}
    assert got["2024-01-04"]["order_count"] == 0 and got["2024-01-04"]["payment_attempt_count"] == 1
    assert got["2024-01-04"]["authorisation_rate"] == 0


def test_the_identity_rate_exists_once_per_day(shop, rows):
    dollars = shop["stg_fx_rates"].where("quote_currency = 'USD'")
    assert [float(r["rate"]) for r in dollars.collect()] == [1.0]


def test_a_file_without_a_declared_column_is_refused(w, tmp_path):
    orders = w.spark.read.parquet(f"{w.root}/orders.parquet")
    orders.drop("o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    with pytest.raises(ContractError, match="o_totalprice is absent"):
        scan(w.spark, str(tmp_path), "orders")
    wrong = orders.withColumn("o_totalprice", orders.o_totalprice.cast("string"))
    wrong.write.parquet(f"{tmp_path}/mistyped/orders.parquet")
    with pytest.raises(ContractError, match="o_totalprice is string"):
        scan(w.spark, f"{tmp_path}/mistyped", "orders")
