"""Commerce staging: one cleaned view per source table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import blank_to, elapsed
from .warehouse import model

DAY = 86_400


def _replace(df, **columns):
    """``df`` with some columns rewritten in place or added at the end."""
    return df.withColumns(columns)


@model("staging", key="address_id")
def stg_addresses(raw_addresses):
    return _replace(
        raw_addresses,
        country_code=F.upper("country_code"),
        is_default_shipping=F.col("is_default") & (F.col("address_type") == "shipping"),
    )


@model(
    "staging",
    typed="ev_app_sessions.started_ts_ms ev_app_sessions.ended_ts_ms",
    key="session_id",
)
def stg_app_sessions(ev_app_sessions):
    start, end = F.col("started_ts_ms"), F.col("ended_ts_ms")
    return ev_app_sessions.select(
        "session_id",
        "customer_id",
        "device_id",
        F.timestamp_millis(start).alias("started_ts"),
        F.timestamp_millis(end).alias("ended_ts"),
        ((end - start) / F.lit(1000.0)).alias("duration_seconds"),
        "app_version",
        "ip_country",
        end.isNull().alias("is_unterminated"),
        F.col("customer_id").isNull().alias("is_anonymous"),
    )


@model("staging", typed="ev_auth_events.event_ts_ms ev_auth_events.succeeded", key="event_id")
def stg_auth_events(ev_auth_events):
    failed = ~F.col("succeeded")
    return _replace(
        ev_auth_events,
        event_ts=F.timestamp_millis("event_ts_ms"),
        is_failed_login=failed & (F.col("event_type") == "login"),
        is_failed_mfa=failed & (F.col("event_type") == "mfa_challenge"),
    ).drop("event_ts_ms")


@model("staging", key="chargeback_id")
def stg_chargebacks(raw_chargebacks):
    return _replace(
        raw_chargebacks,
        currency_code=F.upper("currency_code"),
        is_open=F.col("resolved_ts").isNull(),
        is_fraud_dispute=F.col("reason_code") == "fraud",
    )


@model("staging", key="customer_id", required="email")
def stg_customers(raw_customers):
    return _replace(
        raw_customers.where(F.col("deleted_at").isNull()).drop("deleted_at"),
        email=F.lower("email"),
        country_code=F.upper("country_code"),
        lifetime_tier=F.coalesce("lifetime_tier", F.lit("none")),
        is_active=F.col("account_status") == "active",
    )


@model(
    "staging",
    typed="ev_device_fingerprints.first_seen_ms ev_device_fingerprints.last_seen_ms "
    "ev_device_fingerprints.trust_score ev_device_fingerprints.is_emulator",
    key="device_id",
)
def stg_device_fingerprints(ev_device_fingerprints):
    return ev_device_fingerprints.select(
        "device_id",
        F.timestamp_millis("first_seen_ms").alias("first_seen_ts"),
        F.timestamp_millis("last_seen_ms").alias("last_seen_ts"),
        "os_family",
        "is_emulator",
        "trust_score",
        ((F.col("trust_score") < F.lit(0.4).cast("decimal(5,4)")) | F.col("is_emulator")).alias(
            "is_low_trust"
        ),
    )


@model("staging", required="rate quote_currency")
def stg_fx_rates(raw_fx_rates):
    """Published rates, plus dollars against themselves for every published day.

    The identity rows let a dollar order take the same join as any other.
    """
    published = _replace(
        raw_fx_rates,
        base_currency=F.upper("base_currency"),
        quote_currency=F.upper("quote_currency"),
    )
    dollars = raw_fx_rates.select("rate_date").distinct().select(
        "rate_date",
        F.lit("USD").alias("base_currency"),
        F.lit("USD").alias("quote_currency"),
        F.lit(1).cast("decimal(2,1)").alias("rate"),
        F.lit("identity").alias("source"),
    )
    return published.unionByName(dollars)


@model("staging", key="merchant_id")
def stg_merchants(raw_merchants):
    return _replace(
        raw_merchants,
        country_code=F.upper("country_code"),
        settlement_currency=F.upper("settlement_currency"),
        needs_review=(F.col("risk_band") == "high") | F.col("is_suspended"),
    )


@model(
    "staging",
    typed="raw_order_items.quantity raw_order_items.unit_price",
    key="order_item_id",
)
def stg_order_items(raw_order_items):
    return _replace(
        raw_order_items,
        currency_code=F.upper("currency_code"),
        line_amount=F.col("quantity") * F.col("unit_price"),
    )


@model(
    "staging",
    typed="raw_orders.order_ts raw_orders.gross_amount raw_orders.discount_amount "
    "raw_orders.shipping_amount",
    key="order_id",
    required="customer_id",
    accepted={"status": ["completed", "cancelled", "pending", "returned"]},
)
def stg_orders(raw_orders):
    net = F.col("gross_amount") - F.col("discount_amount") + F.col("shipping_amount")
    return _replace(
        raw_orders,
        order_date=F.to_date("order_ts"),
        currency_code=F.upper("currency_code"),
        net_amount=net,
        is_completed=F.col("status") == "completed",
    )


@model("staging", typed="ev_page_views.event_ts_ms", key="event_id")
def stg_page_views(ev_page_views):
    return _replace(
        ev_page_views,
        event_ts=F.timestamp_millis("event_ts_ms"),
        utm_source=blank_to(F.col("utm_source"), "direct"),
    ).drop("event_ts_ms")


@model(
    "staging",
    typed="raw_payments.attempted_ts raw_payments.settled_ts",
    key="payment_id",
    accepted={"status": ["settled", "declined"]},
)
def stg_payments(raw_payments):
    return _replace(
        raw_payments,
        currency_code=F.upper("currency_code"),
        is_settled=F.col("status") == "settled",
        settle_latency_seconds=elapsed(F.col("settled_ts"), F.col("attempted_ts")),
    )


@model(
    "staging",
    typed="ev_product_views.event_ts_ms ev_product_views.dwell_ms",
    key="event_id",
)
def stg_product_views(ev_product_views):
    return _replace(
        ev_product_views,
        event_ts=F.timestamp_millis("event_ts_ms"),
        is_engaged_view=F.col("dwell_ms") >= 30_000,
    ).drop("event_ts_ms")


@model("staging", key="product_id")
def stg_products(raw_products):
    return _replace(raw_products, currency_code=F.upper("currency_code"))


@model(
    "staging",
    typed="raw_promotions.starts_ts raw_promotions.ends_ts",
    key="promotion_id",
)
def stg_promotions(raw_promotions):
    return _replace(
        raw_promotions, window_days=elapsed(F.col("ends_ts"), F.col("starts_ts"), DAY)
    )


@model("staging", typed="raw_refunds.refunded_ts", key="refund_id")
def stg_refunds(raw_refunds):
    return _replace(
        raw_refunds,
        refund_date=F.to_date("refunded_ts"),
        currency_code=F.upper("currency_code"),
    )


@model(
    "staging",
    typed="ev_search_queries.event_ts_ms ev_search_queries.result_count",
    key="event_id",
)
def stg_search_queries(ev_search_queries):
    return _replace(
        ev_search_queries,
        event_ts=F.timestamp_millis("event_ts_ms"),
        is_zero_result=F.col("result_count") == 0,
    ).drop("event_ts_ms")


@model(
    "staging",
    typed="raw_shipments.shipped_ts raw_shipments.delivered_ts",
    key="shipment_id",
)
def stg_shipments(raw_shipments):
    return _replace(
        raw_shipments,
        is_delivered=F.col("status") == "delivered",
        transit_days=elapsed(F.col("delivered_ts"), F.col("shipped_ts"), DAY),
    )


@model("staging", typed="raw_subscriptions.mrr_amount", key="subscription_id")
def stg_subscriptions(raw_subscriptions):
    monthly = F.col("mrr_amount").cast("decimal(18,6)")
    return _replace(
        raw_subscriptions,
        normalised_mrr=F.when(
            F.col("billing_interval") == "annual", (monthly / 12).cast("decimal(18,10)")
        ).otherwise(monthly.cast("decimal(18,10)")),
        currency_code=F.upper("currency_code"),
        is_active=F.col("cancelled_ts").isNull(),
    )
