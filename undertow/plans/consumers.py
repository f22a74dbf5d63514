"""The dashboard and ad hoc queries that read the marts.

Top-k queries carry a key as the last sort column so that equal rows are always cut the same
way; a descending sort puts missing values first where the dashboards expect them there.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..functions.summaries import percentile_cont


@dataclass(frozen=True)
class Consumer:
    name: str
    reads: tuple[str, ...]
    daily_runs: int
    run: Callable[..., DataFrame]


CONSUMERS: dict[str, Consumer] = {}


def consumer(daily_runs: int):
    """Register a query; its parameter name is the model it reads."""

    def register(fn):
        reads = tuple(inspect.signature(fn).parameters)
        CONSUMERS[fn.__name__] = Consumer(fn.__name__, reads, daily_runs, fn)
        return fn

    return register


@consumer(84)
def authorisation_rate(mart_revenue_daily):
    return (
        mart_revenue_daily.where(F.col("payment_attempt_count") > 0)
        .select(
            "activity_date",
            "authorisation_rate",
            "payment_attempt_count",
            "settled_payment_count",
        )
        .orderBy(F.desc("activity_date"))
        .limit(90)
    )


@consumer(24)
def carrier_on_time(mart_logistics_sla):
    return mart_logistics_sla.select(
        "carrier_name",
        "service_level",
        "promised_days",
        "shipment_count",
        "on_time_rate",
        "p95_transit_days",
    ).orderBy(F.asc_nulls_first("on_time_rate"), "carrier_name")


@consumer(15)
def customer_value(mart_customer_360):
    tiers = mart_customer_360.groupBy("lifetime_tier").agg(
        F.count("*").alias("customer_count"), F.avg("lifetime_net_usd").alias("avg_lifetime_usd")
    )
    median = percentile_cont(
        mart_customer_360, ["lifetime_tier"], "lifetime_net_usd", 0.5, "median_lifetime_usd"
    )
    return tiers.join(median, "lifetime_tier", "left").orderBy(
        F.desc_nulls_first("avg_lifetime_usd")
    )


@consumer(64)
def dispute_exposure(mart_transaction_enriched):
    return (
        mart_transaction_enriched.where("has_open_dispute")
        .groupBy("attempted_date")
        .agg(
            F.sum("disputed_amount_usd").alias("disputed_usd"),
            F.count_if("has_open_dispute").alias("open_dispute_count"),
        )
        .orderBy(F.desc("attempted_date"))
        .limit(60)
    )


@consumer(11)
def fraud_feature_freshness(feature_customer_risk):
    return feature_customer_risk.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("failed_login_rate") > 0).alias("with_failed_logins"),
        F.avg("min_device_trust").alias("avg_min_device_trust"),
        F.max("max_customers_sharing_device").alias("max_shared_device"),
    )


@consumer(41)
def funnel_conversion(mart_marketing_funnel):
    return (
        mart_marketing_funnel.select(
            "session_date",
            "session_count",
            "reached_product_count",
            "reached_cart_count",
            "reached_confirm_count",
            "product_to_cart_rate",
            "cart_to_confirm_rate",
        )
        .orderBy(F.desc("session_date"))
        .limit(60)
    )


@consumer(38)
def merchant_revenue(mart_merchant_scorecard):
    return (
        mart_merchant_scorecard.select(
            "merchant_id",
            "merchant_name",
            "net_amount_usd",
            "completed_order_count",
            "on_time_rate",
        )
        .orderBy(F.desc_nulls_last("net_amount_usd"), "merchant_id")
        .limit(50)
    )


@consumer(3)
def merchant_risk_review(feature_merchant_risk):
    return (
        feature_merchant_risk.where(F.col("payment_count") > 20)
        .select(
            "merchant_id",
            "merchant_name",
            "risk_band",
            "payment_count",
            "dispute_rate",
            "disputed_value_share",
        )
        .orderBy(F.desc_nulls_last("disputed_value_share"), "merchant_id")
        .limit(40)
    )


@consumer(19)
def mrr_by_plan(mart_subscription_health):
    return mart_subscription_health.select(
        "plan_code", "billing_interval", "active_count", "active_mrr_usd", "churn_rate"
    ).orderBy(F.desc_nulls_last("active_mrr_usd"))


@consumer(6)
def order_investigation(int_orders_enriched):
    return (
        int_orders_enriched.where(F.col("currency_code") != "USD")
        .select(
            "order_id",
            "order_date",
            "currency_code",
            "net_amount",
            "fx_rate_to_usd",
            "net_amount_usd",
        )
        .orderBy(F.desc("order_date"), "order_id")
        .limit(100)
    )


@consumer(72)
def reconciliation_gap(mart_finance_reconciliation):
    # A mean of daily ratios, on purpose: every day weighs the same.
    return (
        mart_finance_reconciliation.groupBy("processor")
        .agg(
            F.sum("unreconciled_usd").alias("unreconciled_usd"),
            F.avg("unreconciled_ratio").alias("avg_unreconciled_ratio"),
            F.avg("authorisation_rate").alias("avg_authorisation_rate"),
        )
        .orderBy(F.desc_nulls_first("unreconciled_usd"))
    )


@consumer(96)
def revenue_trend(mart_revenue_daily):
    return (
        mart_revenue_daily.select("activity_date", "net_usd", "gross_usd", "settled_net_usd")
        .orderBy(F.desc("activity_date"))
        .limit(90)
    )


@consumer(2)
def support_load_review(int_customer_support_load):
    return (
        int_customer_support_load.where(F.col("escalated_ticket_count") > 0)
        .select(
            "customer_id",
            "ticket_count",
            "escalated_ticket_count",
            "avg_resolution_hours",
            "avg_csat_score",
        )
        .orderBy(F.desc("escalated_ticket_count"), "customer_id")
        .limit(50)
    )


@consumer(7)
def velocity_outliers(feature_txn_velocity):
    return (
        feature_txn_velocity.where(F.col("peak_to_mean_attempts").isNotNull())
        .select(
            "customer_id",
            "total_attempts",
            "max_daily_attempts",
            "peak_to_mean_attempts",
            "decline_rate",
        )
        .orderBy(F.desc("peak_to_mean_attempts"), "customer_id")
        .limit(200)
    )


@consumer(12)
def zero_result_search(mart_marketing_funnel):
    return (
        mart_marketing_funnel.select(
            "session_date",
            "search_count",
            "zero_result_count",
            ratio(F.col("zero_result_count"), F.col("search_count")).alias("zero_result_rate"),
        )
        .orderBy(F.desc("session_date"))
        .limit(60)
    )


@consumer(43)
def capacity_watch(o_mart_capacity_risk):
    tight = F.col("load_ratio") >= F.lit(0.55).cast("decimal(6,4)")
    return (
        o_mart_capacity_risk.where(tight | (F.col("temperature_alerts") > 0))
        .select("facility_code", "region", "operation_date", "load_ratio", "temperature_alerts")
        .orderBy(F.desc("operation_date"), F.desc_nulls_first("load_ratio"), "facility_code")
        .limit(100)
    )


@consumer(17)
def carrier_score(o_mart_carrier_network):
    return o_mart_carrier_network.select(
        "carrier_name", "service_tier", "on_time_rate", "mean_transit_hours"
    ).orderBy(F.desc_nulls_first("on_time_rate"), "carrier_name")


@consumer(22)
def delivery_features(o_feature_delivery_risk):
    return o_feature_delivery_risk.groupBy("carrier_id").agg(
        F.avg("exception_scan_ratio").alias("exception_ratio"),
        F.avg("observed_late").alias("late_rate"),
    )


@consumer(31)
def exception_queue(o_mart_exception_queue):
    return (
        o_mart_exception_queue.orderBy(F.desc("event_ts"), "event_id", "work_order_id")
        .limit(100)
        .select("facility_id", "exception_code", "severity", "work_order_status")
    )


@consumer(58)
def network_sla(o_mart_delivery_sla):
    return (
        o_mart_delivery_sla.groupBy("facility_id", "carrier_id", "sla_state")
        .agg(F.count("*").alias("shipments"))
        .orderBy(F.desc("shipments"), "facility_id", "carrier_id", "sla_state")
    )
