"""Commerce marts and model features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import (
    avg_where,
    is_false,
    or_false,
    or_zero,
    ratio,
    sum_where,
)
from ..functions.summaries import percentile_cont
from .intermediate import days_before_end, with_usd_rate
from .warehouse import model


@model("marts", typed="stg_subscriptions.normalised_mrr", key="customer_id")
def mart_customer_360(int_customer_lifetime, int_customer_support_load, stg_subscriptions):
    plans = stg_subscriptions.groupBy("customer_id").agg(
        F.count("*").alias("subscription_count"),
        F.count_if("is_active").alias("active_subscription_count"),
        sum_where(F.col("normalised_mrr"), F.col("is_active")).alias("active_mrr"),
    )
    support = int_customer_support_load.select(
        "customer_id",
        "ticket_count",
        "open_ticket_count",
        "escalated_ticket_count",
        "avg_resolution_hours",
        "avg_csat_score",
    )
    whole = int_customer_lifetime.join(support, "customer_id", "left").join(
        plans, "customer_id", "left"
    )
    filled = (
        "ticket_count",
        "open_ticket_count",
        "escalated_ticket_count",
        "subscription_count",
        "active_subscription_count",
        "active_mrr",
    )
    return whole.withColumns({c: or_zero(F.col(c)) for c in filled}).withColumn(
        "is_subscriber", F.col("active_subscription_count") > 0
    )


@model(
    "marts",
    typed="int_payment_attempts.amount_usd int_payment_attempts.net_settled_usd "
    "int_payment_attempts.refunded_amount_usd int_payment_attempts.disputed_amount_usd "
    "int_orders_enriched.net_amount_usd",
)
def mart_finance_reconciliation(int_payment_attempts, int_orders_enriched):
    paid = int_payment_attempts.groupBy("attempted_date", "processor").agg(
        F.count("*").alias("attempt_count"),
        F.count_if("is_settled").alias("settled_count"),
        sum_where(F.col("amount_usd"), F.col("is_settled")).alias("settled_gross_usd"),
        F.sum("net_settled_usd").alias("settled_net_usd"),
        F.sum("refunded_amount_usd").alias("refunded_usd"),
        F.sum("disputed_amount_usd").alias("disputed_usd"),
    )
    ordered = int_orders_enriched.groupBy(F.col("order_date").alias("attempted_date")).agg(
        sum_where(F.col("net_amount_usd"), F.col("is_completed")).alias("ordered_net_usd")
    )
    gap = F.col("ordered_net_usd") - F.col("settled_net_usd")
    return paid.join(ordered, "attempted_date", "left").withColumns(
        {
            "unreconciled_usd": gap,
            "unreconciled_ratio": ratio(gap, F.col("ordered_net_usd")),
            "authorisation_rate": ratio(F.col("settled_count"), F.col("attempt_count")),
        }
    )


CARRIER = ["carrier_id", "carrier_name", "service_level", "promised_days"]


@model(
    "marts",
    typed="int_shipment_performance.transit_days int_shipment_performance.days_late "
    "int_shipment_performance.order_date",
    key="carrier_id",
)
def mart_logistics_sla(int_shipment_performance):
    totals = int_shipment_performance.groupBy(*CARRIER).agg(
        F.count("*").alias("shipment_count"),
        F.count_if("is_delivered").alias("delivered_count"),
        F.count_if("met_promise").alias("on_time_count"),
        F.count_if(is_false(F.col("met_promise"))).alias("late_count"),
        F.avg("transit_days").alias("avg_transit_days"),
        avg_where(F.col("days_late"), F.col("days_late") > 0).alias("avg_days_late_when_late"),
        F.max("order_date").alias("last_order_date"),
    )
    p95 = percentile_cont(
        int_shipment_performance, ["carrier_id"], "transit_days", 0.95, "p95_transit_days"
    )
    return totals.join(p95, "carrier_id", "left").select(
        *CARRIER,
        "shipment_count",
        "delivered_count",
        "on_time_count",
        "late_count",
        ratio(F.col("on_time_count"), F.col("delivered_count")).alias("on_time_rate"),
        "avg_transit_days",
        "p95_transit_days",
        "avg_days_late_when_late",
        "last_order_date",
    )


@model("marts", key="session_date")
def mart_marketing_funnel(int_funnel_steps, stg_search_queries):
    searches = stg_search_queries.groupBy("session_id").agg(
        F.count("*").alias("searches"), F.count_if("is_zero_result").alias("empty_searches")
    )
    flags = {
        "anonymous_session_count": "is_anonymous",
        "reached_product_count": "reached_product",
        "reached_cart_count": "reached_cart",
        "reached_checkout_count": "reached_checkout",
        "reached_confirm_count": "reached_confirm",
        "abandoned_count": "any_abandoned",
    }
    days = (
        int_funnel_steps.join(searches, "session_id", "left")
        .groupBy("session_date")
        .agg(
            F.count("*").alias("session_count"),
            *[F.count_if(flag).alias(name) for name, flag in flags.items()],
            F.sum("page_view_count").alias("page_view_count"),
            F.sum("product_view_count").alias("product_view_count"),
            F.sum(or_zero(F.col("searches"))).alias("search_count"),
            F.sum(or_zero(F.col("empty_searches"))).alias("zero_result_count"),
        )
    )
    return days.withColumns(
        {
            "product_to_cart_rate": ratio(
                F.col("reached_cart_count"), F.col("reached_product_count")
            ),
            "cart_to_confirm_rate": ratio(
                F.col("reached_confirm_count"), F.col("reached_cart_count")
            ),
        }
    )


MERCHANT = ["merchant_id", "merchant_name", "country_code", "risk_band", "is_suspended"]


@model(
    "marts",
    typed="int_merchant_daily.net_amount_usd int_merchant_daily.order_count "
    "int_merchant_daily.order_date int_shipment_performance.transit_days "
    "int_shipment_performance.days_late",
    key="merchant_id",
)
def mart_merchant_scorecard(int_merchant_daily, int_shipment_performance):
    sums = (
        "order_count",
        "completed_order_count",
        "net_amount_usd",
        "completed_net_amount_usd",
        "discount_amount_usd",
    )
    sold = int_merchant_daily.groupBy(*MERCHANT).agg(
        F.count_distinct("order_date").alias("active_days"),
        *[F.sum(c).alias(c) for c in sums],
        F.max("order_date").alias("last_order_date"),
    )
    shipped = (
        int_shipment_performance.where(F.col("merchant_id").isNotNull())
        .groupBy("merchant_id")
        .agg(
            F.count("*").alias("shipment_count"),
            F.count_if("met_promise").alias("on_time_count"),
            F.avg("transit_days").alias("avg_transit_days"),
            F.avg("days_late").alias("avg_days_late"),
        )
    )
    return sold.join(shipped, "merchant_id", "left").select(
        *sold.columns,
        or_zero(F.col("shipment_count")).alias("shipment_count"),
        or_zero(F.col("on_time_count")).alias("on_time_count"),
        ratio(F.col("on_time_count"), F.col("shipment_count")).alias("on_time_rate"),
        "avg_transit_days",
        "avg_days_late",
        ratio(F.col("discount_amount_usd"), F.col("net_amount_usd")).alias("discount_intensity"),
    )


@model(
    "marts",
    typed="int_payment_attempts.net_settled_usd int_payment_attempts.refunded_amount_usd "
    "int_payment_attempts.disputed_amount_usd int_orders_enriched.gross_amount_usd "
    "int_orders_enriched.net_amount_usd int_orders_enriched.discount_amount_usd",
)
def mart_revenue_daily(int_payment_attempts, int_orders_enriched):
    ordered = int_orders_enriched.groupBy(F.col("order_date").alias("activity_date")).agg(
        F.count("*").alias("order_count"),
        F.count_if("is_completed").alias("completed_order_count"),
        F.count_distinct("customer_id").alias("distinct_customers"),
        F.count_distinct("merchant_id").alias("distinct_merchants"),
        F.sum("gross_amount_usd").alias("gross_usd"),
        F.sum("net_amount_usd").alias("net_usd"),
        F.sum("discount_amount_usd").alias("discount_usd"),
    )
    settled = int_payment_attempts.groupBy(F.col("attempted_date").alias("activity_date")).agg(
        F.sum("net_settled_usd").alias("settled_net_usd"),
        F.sum("refunded_amount_usd").alias("refunded_usd"),
        F.sum("disputed_amount_usd").alias("disputed_usd"),
        F.count("*").alias("payment_attempt_count"),
        F.count_if("is_settled").alias("settled_payment_count"),
    )
    # A day may have orders without payments or payments without orders; both are kept.
    days = ordered.join(settled, "activity_date", "full")
    return days.select(
        "activity_date",
        *[or_zero(F.col(c)).alias(c) for c in days.columns if c != "activity_date"],
        ratio(F.col("settled_payment_count"), F.col("payment_attempt_count")).alias(
            "authorisation_rate"
        ),
    )


@model(
    "marts",
    typed="stg_subscriptions.normalised_mrr stg_subscriptions.started_ts stg_fx_rates.rate "
    "stg_fx_rates.rate_date int_customer_lifetime.lifetime_net_usd",
)
def mart_subscription_health(stg_subscriptions, stg_fx_rates, int_customer_lifetime):
    worth = int_customer_lifetime.select("customer_id", "lifetime_net_usd")
    priced = with_usd_rate(
        stg_subscriptions, stg_fx_rates, F.to_date("started_ts"), "_rate"
    ).withColumn("_mrr", F.col("normalised_mrr") / F.col("_rate"))
    gone = ~F.col("is_active")
    plans = (
        priced.join(worth, "customer_id", "left")
        .groupBy("plan_code", "billing_interval")
        .agg(
            F.count("*").alias("subscription_count"),
            F.count_if("is_active").alias("active_count"),
            F.count_if(gone).alias("cancelled_count"),
            F.sum("_mrr").alias("mrr_usd"),
            sum_where(F.col("_mrr"), F.col("is_active")).alias("active_mrr_usd"),
            F.avg("_mrr").alias("avg_mrr_usd"),
            # One value per subscription row, so a customer with two plans counts twice.
            F.avg("lifetime_net_usd").alias("avg_subscriber_lifetime_usd"),
            F.count_distinct("customer_id").alias("distinct_subscribers"),
        )
    )
    return plans.withColumn(
        "churn_rate", ratio(F.col("cancelled_count"), F.col("subscription_count"))
    )


@model(
    "marts",
    typed="int_session_device.trust_score int_session_device.is_emulator",
    key="payment_id",
)
def mart_transaction_enriched(int_payment_attempts, int_orders_enriched, int_session_device):
    devices = (
        int_session_device.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count_distinct("device_id").alias("distinct_devices"),
            F.count_distinct("session_id").alias("session_count"),
            F.sum("failed_login_count").alias("failed_login_count"),
            F.sum("failed_mfa_count").alias("failed_mfa_count"),
            F.min("trust_score").alias("min_device_trust"),
            F.avg("trust_score").alias("avg_device_trust"),
            F.bool_or("is_emulator").alias("any_emulator"),
            F.max("distinct_countries").alias("max_countries_per_device"),
        )
    )
    orders = int_orders_enriched.select(
        "order_id",
        "customer_id",
        "merchant_id",
        "channel",
        "item_count",
        "unit_count",
        F.col("net_amount_usd").alias("order_net_amount_usd"),
    )
    payments = int_payment_attempts.select(
        "payment_id",
        "order_id",
        "attempted_ts",
        "attempted_date",
        "status",
        "processor",
        "decline_reason",
        "is_settled",
        "settle_latency_seconds",
        "currency_code",
        "amount_usd",
        "net_settled_usd",
        "refunded_amount_usd",
        "disputed_amount_usd",
        "has_fraud_dispute",
        "has_open_dispute",
    )
    whole = payments.join(orders, "order_id", "left").join(devices, "customer_id", "left")
    counts = (
        "distinct_devices",
        "session_count",
        "failed_login_count",
        "failed_mfa_count",
        "max_countries_per_device",
    )
    return whole.withColumns(
        {
            **{c: or_zero(F.col(c)) for c in counts},
            "any_emulator": or_false(F.col("any_emulator")),
        }
    )


@model(
    "features",
    typed="int_customer_lifetime.signup_ts int_customer_lifetime.order_count "
    "int_session_device.duration_seconds int_session_device.trust_score",
    key="customer_id",
)
def feature_customer_risk(int_customer_lifetime, int_session_device):
    signal = (
        int_session_device.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count_distinct("device_id").alias("device_count"),
            F.count_distinct("session_id").alias("session_count"),
            F.count_if("is_low_trust").alias("low_trust_session_count"),
            F.sum("failed_login_count").alias("failed_login_count"),
            F.sum("failed_mfa_count").alias("failed_mfa_count"),
            F.max("distinct_customers_on_device").alias("max_customers_sharing_device"),
            F.max("distinct_countries").alias("max_countries_per_device"),
            F.min("trust_score").alias("min_device_trust"),
            F.avg(F.coalesce("duration_seconds", F.lit(0.0))).alias("avg_session_seconds"),
            F.count_if("is_unterminated").alias("unterminated_session_count"),
        )
    )
    kept = ("min_device_trust", "avg_session_seconds", "customer_id")
    return int_customer_lifetime.join(signal, "customer_id", "left").select(
        "customer_id",
        "country_code",
        "order_count",
        "lifetime_net_usd",
        "days_since_last_order",
        "is_never_ordered",
        days_before_end(F.col("signup_ts")).alias("account_age_days"),
        *[or_zero(F.col(c)).alias(c) for c in signal.columns if c not in kept],
        "min_device_trust",
        "avg_session_seconds",
        ratio(or_zero(F.col("failed_login_count")), F.col("session_count")).alias(
            "failed_login_rate"
        ),
        ratio(or_zero(F.col("device_count")), F.col("order_count")).alias("devices_per_order"),
    )


@model(
    "features",
    typed="int_payment_attempts.disputed_amount_usd int_payment_attempts.refunded_amount_usd "
    "int_merchant_daily.net_amount_usd int_merchant_daily.order_count",
    key="merchant_id",
)
def feature_merchant_risk(int_payment_attempts, int_orders_enriched, int_merchant_daily):
    sellers = int_orders_enriched.select("order_id", "merchant_id")
    trouble = (
        int_payment_attempts.join(sellers, "order_id")
        .groupBy("merchant_id")
        .agg(
            F.count("*").alias("payment_count"),
            F.count_if(~F.col("is_settled")).alias("declined_payment_count"),
            F.count_if(F.col("dispute_count") > 0).alias("dispute_count"),
            F.count_if("has_fraud_dispute").alias("fraud_dispute_count"),
            F.count_if(F.col("refund_count") > 0).alias("refunded_payment_count"),
            F.sum("disputed_amount_usd").alias("disputed_usd"),
            F.sum("refunded_amount_usd").alias("refunded_usd"),
        )
    )
    volume = int_merchant_daily.groupBy(
        "merchant_id", "merchant_name", "risk_band", "is_suspended"
    ).agg(
        F.count_distinct("order_date").alias("active_days"),
        F.sum("order_count").alias("order_count"),
        F.sum("distinct_customers").alias("customer_touches"),
        F.sum("net_amount_usd").alias("net_amount_usd"),
    )
    filled = [c for c in trouble.columns if c != "merchant_id"]
    payments = F.col("payment_count")
    return volume.join(trouble, "merchant_id", "left").select(
        *volume.columns,
        *[or_zero(F.col(c)).alias(c) for c in filled],
        ratio(F.col("declined_payment_count"), payments).alias("decline_rate"),
        ratio(F.col("dispute_count"), payments).alias("dispute_rate"),
        ratio(or_zero(F.col("disputed_usd")), F.col("net_amount_usd")).alias(
            "disputed_value_share"
        ),
    )


@model(
    "features",
    typed="mart_transaction_enriched.amount_usd mart_transaction_enriched.is_settled",
    key="customer_id",
)
def feature_txn_velocity(mart_transaction_enriched):
    days = (
        mart_transaction_enriched.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "attempted_date")
        .agg(
            F.count("*").alias("attempts"),
            F.count_if(~F.col("is_settled")).alias("declines"),
            F.sum("amount_usd").alias("usd"),
            F.count_distinct("merchant_id").alias("merchants"),
        )
    )
    return days.groupBy("customer_id").agg(
        F.count("*").alias("active_days"),
        F.sum("attempts").alias("total_attempts"),
        F.sum("declines").alias("total_declines"),
        F.sum("usd").alias("total_amount_usd"),
        F.avg("attempts").alias("avg_daily_attempts"),
        F.max("attempts").alias("max_daily_attempts"),
        F.stddev_pop("attempts").alias("stddev_daily_attempts"),
        ratio(F.max("attempts"), F.avg("attempts")).alias("peak_to_mean_attempts"),
        F.avg("usd").alias("avg_daily_amount_usd"),
        F.max("usd").alias("max_daily_amount_usd"),
        F.max("merchants").alias("max_daily_merchants"),
        ratio(F.sum("declines"), F.sum("attempts")).alias("decline_rate"),
        F.max("attempted_date").alias("last_attempt_date"),
    )
