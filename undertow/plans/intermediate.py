"""Commerce intermediate tables: one grain each, joined and rolled up.

Where a fact meets a dimension, the fact is rolled up to the join grain first: the rollup
combines on the map side, so a key that holds a third of the rows leaves each task as one row
instead of being gathered by a join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import elapsed, or_false, or_zero, ratio, sum_where
from .warehouse import model

DAY = 86_400
HOUR = 3_600
ESTATE_END = "2001-12-31"


def days_before_end(ts):
    return elapsed(F.lit(ESTATE_END).cast("timestamp"), ts, DAY)


def with_usd_rate(df, rates, day, alias="fx_rate_to_usd"):
    """Add the dollar rate of the row's own currency on its own day; null when not published."""
    usd = rates.where(F.col("base_currency") == "USD").select(
        F.col("rate_date").alias("_day"),
        F.col("quote_currency").alias("_quote"),
        F.col("rate").alias(alias),
    )
    return df.join(
        usd, (day == F.col("_day")) & (F.col("currency_code") == F.col("_quote")), "left"
    ).drop("_day", "_quote")


def usd(amount, rate):
    """``amount`` in dollars. Bounding the amount's digits leaves the quotient sixteen decimals;
    dividing a wide sum directly would leave eight."""
    return amount.cast("decimal(16,2)") / rate


@model(
    "intermediate",
    typed="stg_order_items.quantity stg_order_items.line_amount stg_orders.order_date "
    "stg_orders.gross_amount stg_orders.discount_amount stg_orders.net_amount "
    "stg_fx_rates.rate stg_fx_rates.rate_date",
    key="order_id",
    required="net_amount_usd",
)
def int_orders_enriched(stg_orders, stg_order_items, stg_fx_rates):
    items = stg_order_items.groupBy("order_id").agg(
        F.count("*").alias("item_count"),
        F.sum("quantity").alias("unit_count"),
        F.sum("line_amount").alias("items_amount"),
    )
    priced = with_usd_rate(
        stg_orders.join(items, "order_id", "left"), stg_fx_rates, F.col("order_date")
    )
    rate = F.col("fx_rate_to_usd")
    return priced.select(
        "order_id",
        "customer_id",
        "merchant_id",
        "order_ts",
        "order_date",
        "status",
        "channel",
        "is_completed",
        "currency_code",
        "gross_amount",
        "discount_amount",
        "shipping_amount",
        "net_amount",
        *[or_zero(F.col(c)).alias(c) for c in ("item_count", "unit_count", "items_amount")],
        rate,
        *[
            usd(F.col(f"{c}_amount"), rate).alias(f"{c}_amount_usd")
            for c in ("net", "gross", "discount")
        ],
    )


@model(
    "intermediate",
    typed="int_orders_enriched.net_amount_usd int_orders_enriched.order_ts "
    "int_orders_enriched.is_completed",
    key="customer_id",
)
def int_customer_lifetime(stg_customers, int_orders_enriched):
    done = F.col("is_completed")
    bought = int_orders_enriched.groupBy("customer_id").agg(
        F.count("*").alias("order_count"),
        F.count_if(done).alias("completed_order_count"),
        sum_where(F.col("net_amount_usd"), done).alias("lifetime_net_usd"),
        F.count_distinct("merchant_id").alias("distinct_merchants"),
        F.min("order_ts").alias("first_order_ts"),
        F.max("order_ts").alias("last_order_ts"),
    )
    measures = ("order_count", "completed_order_count", "lifetime_net_usd", "distinct_merchants")
    return stg_customers.join(bought, "customer_id", "left").select(
        "customer_id",
        "email",
        "country_code",
        "signup_ts",
        "account_status",
        "lifetime_tier",
        "is_active",
        *[or_zero(F.col(c)).alias(c) for c in measures],
        "first_order_ts",
        "last_order_ts",
        days_before_end(F.col("last_order_ts")).alias("days_since_last_order"),
        (or_zero(F.col("order_count")) == 0).alias("is_never_ordered"),
    )


@model(
    "intermediate",
    typed="raw_support_tickets.opened_ts raw_support_tickets.closed_ts "
    "raw_support_tickets.csat_score",
    key="customer_id",
)
def int_customer_support_load(stg_customers, raw_support_tickets):
    load = raw_support_tickets.groupBy("customer_id").agg(
        F.count("ticket_id").alias("ticket_count"),
        F.count_if(F.col("closed_ts").isNull() & F.col("ticket_id").isNotNull()).alias(
            "open_ticket_count"
        ),
        F.count_if(
            F.col("priority").isin("high", "urgent") & F.col("ticket_id").isNotNull()
        ).alias("escalated_ticket_count"),
        F.count_distinct("order_id").alias("orders_with_tickets"),
        F.avg(elapsed(F.col("closed_ts"), F.col("opened_ts"), HOUR)).alias("avg_resolution_hours"),
        F.avg("csat_score").alias("avg_csat_score"),
        F.max("opened_ts").alias("last_ticket_ts"),
    )
    counts = (
        "ticket_count",
        "open_ticket_count",
        "escalated_ticket_count",
        "orders_with_tickets",
    )
    return stg_customers.join(load, "customer_id", "left").select(
        "customer_id",
        "country_code",
        "lifetime_tier",
        *[or_zero(F.col(c)).alias(c) for c in counts],
        "avg_resolution_hours",
        "avg_csat_score",
        "last_ticket_ts",
    )


@model(
    "intermediate",
    typed="stg_app_sessions.started_ts ev_add_to_cart.quantity ev_checkout_steps.step_index "
    "ev_checkout_steps.abandoned",
    key="session_id",
)
def int_funnel_steps(
    stg_app_sessions, stg_page_views, stg_product_views, ev_add_to_cart, ev_checkout_steps
):
    pages = stg_page_views.groupBy("session_id").agg(F.count("*").alias("page_view_count"))
    products = stg_product_views.groupBy("session_id").agg(
        F.count("*").alias("product_view_count"),
        F.count_distinct("product_id").alias("distinct_products_viewed"),
    )
    carts = ev_add_to_cart.groupBy("session_id").agg(
        F.count("*").alias("add_to_cart_count"), F.sum("quantity").alias("cart_units")
    )
    checkouts = ev_checkout_steps.groupBy("session_id").agg(
        F.count("*").alias("checkout_step_count"),
        F.max("step_index").alias("furthest_step_index"),
        F.bool_or("abandoned").alias("any_abandoned"),
    )
    joined = stg_app_sessions
    for side in (pages, products, carts, checkouts):
        joined = joined.join(side, "session_id", "left")
    counts = (
        "page_view_count",
        "product_view_count",
        "distinct_products_viewed",
        "add_to_cart_count",
        "cart_units",
        "checkout_step_count",
    )
    furthest = F.col("furthest_step_index")
    return joined.select(
        "session_id",
        "customer_id",
        "started_ts",
        F.to_date("started_ts").alias("session_date"),
        "is_anonymous",
        *[or_zero(F.col(c)).alias(c) for c in counts],
        furthest,
        or_false(F.col("any_abandoned")).alias("any_abandoned"),
        (or_zero(F.col("product_view_count")) > 0).alias("reached_product"),
        (or_zero(F.col("add_to_cart_count")) > 0).alias("reached_cart"),
        furthest.isNotNull().alias("reached_checkout"),
        # Stays unknown for a session that never entered checkout.
        (furthest == 3).alias("reached_confirm"),
    )


@model(
    "intermediate",
    typed="int_orders_enriched.net_amount_usd int_orders_enriched.discount_amount_usd "
    "int_orders_enriched.unit_count int_orders_enriched.is_completed",
)
def int_merchant_daily(int_orders_enriched, stg_merchants):
    done = F.col("is_completed")
    daily = int_orders_enriched.groupBy("merchant_id", "order_date").agg(
        F.count("*").alias("order_count"),
        F.count_if(done).alias("completed_order_count"),
        F.count_distinct("customer_id").alias("distinct_customers"),
        F.sum("net_amount_usd").alias("net_amount_usd"),
        sum_where(F.col("net_amount_usd"), done).alias("completed_net_amount_usd"),
        F.sum("discount_amount_usd").alias("discount_amount_usd"),
        F.sum("unit_count").alias("unit_count"),
    )
    who = stg_merchants.select(
        "merchant_id",
        "merchant_name",
        "country_code",
        "risk_band",
        "settlement_currency",
        "is_suspended",
    )
    measures = [c for c in daily.columns if c not in ("merchant_id", "order_date")]
    return daily.join(who, "merchant_id").select(
        "merchant_id",
        "order_date",
        "merchant_name",
        "country_code",
        "risk_band",
        "settlement_currency",
        "is_suspended",
        *measures,
    )


@model(
    "intermediate",
    typed="stg_payments.attempted_ts stg_payments.amount stg_payments.is_settled "
    "stg_refunds.amount stg_chargebacks.amount stg_fx_rates.rate stg_fx_rates.rate_date",
    key="payment_id",
)
def int_payment_attempts(stg_payments, stg_refunds, stg_chargebacks, stg_fx_rates):
    refunds = stg_refunds.groupBy("payment_id").agg(
        F.sum("amount").alias("refunded"), F.count("*").alias("refund_count")
    )
    disputes = stg_chargebacks.groupBy("payment_id").agg(
        F.sum("amount").alias("disputed"),
        F.count("*").alias("dispute_count"),
        F.bool_or("is_fraud_dispute").alias("has_fraud_dispute"),
        F.bool_or("is_open").alias("has_open_dispute"),
    )
    attempts = (
        stg_payments.withColumn("attempted_date", F.to_date("attempted_ts"))
        .join(refunds, "payment_id", "left")
        .join(disputes, "payment_id", "left")
    )
    priced = with_usd_rate(attempts, stg_fx_rates, F.col("attempted_date"))
    rate = F.col("fx_rate_to_usd")
    refunded, disputed = or_zero(F.col("refunded")), or_zero(F.col("disputed"))
    return priced.select(
        "payment_id",
        "order_id",
        "payment_method_id",
        "attempted_ts",
        "attempted_date",
        "settled_ts",
        "status",
        "processor",
        "decline_reason",
        "is_settled",
        "settle_latency_seconds",
        "currency_code",
        "amount",
        rate,
        usd(F.col("amount"), rate).alias("amount_usd"),
        usd(refunded, rate).alias("refunded_amount_usd"),
        usd(disputed, rate).alias("disputed_amount_usd"),
        or_zero(F.col("refund_count")).alias("refund_count"),
        or_zero(F.col("dispute_count")).alias("dispute_count"),
        or_false(F.col("has_fraud_dispute")).alias("has_fraud_dispute"),
        or_false(F.col("has_open_dispute")).alias("has_open_dispute"),
        F.when(F.col("is_settled"), usd(F.col("amount") - refunded - disputed, rate))
        .otherwise(0)
        .alias("net_settled_usd"),
    )


@model(
    "intermediate",
    typed="raw_promotion_redemptions.discount_applied int_orders_enriched.discount_amount_usd "
    "int_orders_enriched.net_amount_usd stg_promotions.budget_amount",
    key="promotion_id",
)
def int_promotion_impact(stg_promotions, raw_promotion_redemptions, int_orders_enriched):
    orders = int_orders_enriched.select("order_id", "discount_amount_usd", "net_amount_usd")
    redeemed = (
        raw_promotion_redemptions.join(orders, "order_id", "left")
        .groupBy("promotion_id")
        .agg(
            F.count("redemption_id").alias("redemption_count"),
            F.count_distinct("customer_id").alias("distinct_redeemers"),
            F.sum("discount_applied").alias("discount_applied_local"),
            F.sum("discount_amount_usd").alias("discount_applied_usd"),
            F.sum("net_amount_usd").alias("attributed_net_usd"),
        )
    )
    return stg_promotions.join(redeemed, "promotion_id", "left").select(
        "promotion_id",
        "promo_code",
        "discount_type",
        "discount_value",
        "budget_amount",
        "starts_ts",
        "ends_ts",
        "window_days",
        or_zero(F.col("redemption_count")).alias("redemption_count"),
        or_zero(F.col("distinct_redeemers")).alias("distinct_redeemers"),
        "discount_applied_local",
        "discount_applied_usd",
        "attributed_net_usd",
        ratio(F.col("discount_applied_usd"), F.col("budget_amount")).alias("budget_consumed_ratio"),
    )


@model(
    "intermediate",
    typed="stg_auth_events.is_failed_login stg_auth_events.is_failed_mfa",
    key="session_id",
)
def int_session_device(stg_app_sessions, stg_device_fingerprints, stg_auth_events):
    logins = stg_auth_events.groupBy("device_id").agg(
        F.count("*").alias("auth_event_count"),
        F.count_if("is_failed_login").alias("failed_login_count"),
        F.count_if("is_failed_mfa").alias("failed_mfa_count"),
        F.count_distinct("customer_id").alias("distinct_customers_on_device"),
        F.count_distinct("ip_country").alias("distinct_countries"),
    )
    device = stg_device_fingerprints.withColumnRenamed(
        "first_seen_ts", "device_first_seen_ts"
    ).drop("last_seen_ts")
    # Device facts meet each other before the session rows, so sessions are exchanged once.
    known = device.join(logins, "device_id", "full")
    return stg_app_sessions.join(known, "device_id", "left").select(
        "session_id",
        "customer_id",
        "device_id",
        "started_ts",
        "ended_ts",
        "duration_seconds",
        "app_version",
        "ip_country",
        "is_unterminated",
        "is_anonymous",
        "os_family",
        "is_emulator",
        "trust_score",
        "is_low_trust",
        "device_first_seen_ts",
        *[or_zero(F.col(c)).alias(c) for c in logins.columns if c != "device_id"],
    )


@model(
    "intermediate",
    typed="stg_shipments.transit_days raw_carriers.promised_days",
    key="shipment_id",
)
def int_shipment_performance(stg_shipments, raw_carriers, stg_orders):
    orders = stg_orders.select("order_id", "order_date", "merchant_id")
    over = F.col("transit_days") - F.col("promised_days")
    return (
        stg_shipments.join(raw_carriers, "carrier_id")
        .join(orders, "order_id", "left")
        .select(
            "shipment_id",
            "order_id",
            "carrier_id",
            "carrier_name",
            "service_level",
            "promised_days",
            "shipped_ts",
            "delivered_ts",
            "status",
            "is_delivered",
            "transit_days",
            "order_date",
            "merchant_id",
            F.when(F.col("is_delivered"), over <= 0).alias("met_promise"),
            F.when(F.col("is_delivered"), F.greatest(over, F.lit(0.0))).alias("days_late"),
        )
    )
