"""Column contracts of the source tables, and the check that a table meets its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Identifiers are 64-bit throughout: the tables are sized for more rows than a 32-bit key holds.
# Source tables with their columns and types.
CONTRACTS = {
    "raw_customers": "customer_id bigint, email string, full_name string, country_code string, "
    "signup_ts timestamp, account_status string, marketing_opt_in boolean, "
    "lifetime_tier string, deleted_at timestamp",
    "raw_addresses": "address_id bigint, customer_id bigint, address_type string, line1 string, "
    "city string, region string, postal_code string, country_code string, is_default boolean",
    "raw_product_categories": "category_id bigint, category_name string, "
    "parent_category_id bigint, is_regulated boolean",
    "raw_products": "product_id bigint, merchant_id bigint, category_id bigint, sku string, "
    "title string, list_price decimal(12,2), currency_code string, is_active boolean, "
    "created_ts timestamp",
    "raw_merchants": "merchant_id bigint, merchant_name string, country_code string, "
    "onboarded_ts timestamp, risk_band string, settlement_currency string, is_suspended boolean",
    "raw_orders": "order_id bigint, customer_id bigint, merchant_id bigint, order_ts timestamp, "
    "status string, currency_code string, gross_amount decimal(12,2), "
    "discount_amount decimal(12,2), shipping_amount decimal(12,2), channel string",
    "raw_order_items": "order_item_id bigint, order_id bigint, product_id bigint, quantity int, "
    "unit_price decimal(12,2), currency_code string",
    "raw_payment_methods": "payment_method_id bigint, customer_id bigint, method_type string, "
    "card_bin string, issuer_country string, added_ts timestamp",
    "raw_payments": "payment_id bigint, order_id bigint, payment_method_id bigint, "
    "attempted_ts timestamp, settled_ts timestamp, status string, amount decimal(12,2), "
    "currency_code string, processor string, decline_reason string",
    "raw_refunds": "refund_id bigint, payment_id bigint, refunded_ts timestamp, "
    "amount decimal(12,2), currency_code string, reason_code string",
    "raw_chargebacks": "chargeback_id bigint, payment_id bigint, opened_ts timestamp, "
    "resolved_ts timestamp, amount decimal(12,2), currency_code string, reason_code string, "
    "liability string",
    "raw_carriers": "carrier_id bigint, carrier_name string, service_level string, "
    "promised_days int",
    "raw_shipments": "shipment_id bigint, order_id bigint, carrier_id bigint, "
    "shipped_ts timestamp, delivered_ts timestamp, status string, tracking_ref string",
    "raw_promotions": "promotion_id bigint, promo_code string, discount_type string, "
    "discount_value decimal(12,2), starts_ts timestamp, ends_ts timestamp, "
    "budget_amount decimal(12,2)",
    "raw_promotion_redemptions": "redemption_id bigint, promotion_id bigint, order_id bigint, "
    "customer_id bigint, redeemed_ts timestamp, discount_applied decimal(12,2)",
    "raw_subscriptions": "subscription_id bigint, customer_id bigint, plan_code string, "
    "started_ts timestamp, cancelled_ts timestamp, mrr_amount decimal(12,2), "
    "currency_code string, billing_interval string",
    "raw_support_tickets": "ticket_id bigint, customer_id bigint, order_id bigint, "
    "opened_ts timestamp, closed_ts timestamp, category string, priority string, csat_score int",
    "raw_fx_rates": "rate_date date, base_currency string, quote_currency string, "
    "rate decimal(18,8), source string",
    "ev_page_views": "event_id string, session_id string, customer_id bigint, "
    "event_ts_ms bigint, path string, referrer string, utm_source string, device_type string",
    "ev_product_views": "event_id string, session_id string, customer_id bigint, "
    "product_id bigint, event_ts_ms bigint, dwell_ms int",
    "ev_add_to_cart": "event_id string, session_id string, customer_id bigint, "
    "product_id bigint, quantity int, event_ts_ms bigint",
    "ev_checkout_steps": "event_id string, session_id string, customer_id bigint, "
    "step_name string, step_index int, event_ts_ms bigint, abandoned boolean",
    "ev_app_sessions": "session_id string, customer_id bigint, device_id string, "
    "started_ts_ms bigint, ended_ts_ms bigint, app_version string, ip_country string",
    "ev_device_fingerprints": "device_id string, first_seen_ms bigint, last_seen_ms bigint, "
    "os_family string, is_emulator boolean, trust_score decimal(5,4)",
    "ev_search_queries": "event_id string, session_id string, customer_id bigint, "
    "query_text string, result_count int, event_ts_ms bigint",
    "ev_email_events": "event_id string, customer_id bigint, campaign_id string, "
    "event_type string, event_ts_ms bigint",
    "ev_auth_events": "event_id string, customer_id bigint, device_id string, "
    "event_type string, succeeded boolean, ip_country string, event_ts_ms bigint",
    "ops_facilities": "facility_id bigint, facility_code string, region string, "
    "capacity_units int, opened_date date, owner_team string",
    "ops_carriers": "carrier_id bigint, carrier_name string, service_tier string, "
    "home_region string",
    "ops_shipments": "shipment_id bigint, facility_id bigint, carrier_id bigint, "
    "route_code string, dispatched_at timestamp, promised_at timestamp, "
    "delivered_at timestamp, status string, package_count int, priority string",
    "ops_inventory_snapshots": "snapshot_id bigint, facility_id bigint, snapshot_date date, "
    "units_on_hand int, units_reserved int",
    "ops_work_orders": "work_order_id bigint, facility_id bigint, opened_at timestamp, "
    "closed_at timestamp, issue_code string, severity string, status string",
    "ops_scan_events": "event_id string, shipment_id bigint, facility_id bigint, "
    "event_type string, event_ts timestamp, exception_code string",
    "ops_temperature_readings": "event_id string, facility_id bigint, recorded_at timestamp, "
    "celsius decimal(8,2), sensor_status string",
    "lin_assets": "asset string, kind string, name string, layer string, team string, "
    "refresh_cadence string, sla_hours int, tier string, replicated boolean, "
    "fallback_source string, materialization string",
    "lin_columns": "asset string, column_name string, native_type string, nullable boolean",
    "lin_owners": "asset string, owner string",
    "lin_edges": "source string, target string",
    "lin_column_edges": "source string, source_column string, target string, "
    "target_column string",
    "lin_usage": "asset string, bucket date, user_name string, query_text string, runs bigint",
}


class ContractError(ValueError):
    """A table does not have the columns or types its contract declares."""


def contract(role: str) -> StructType:
    return StructType.fromDDL(CONTRACTS[role])


def check_contract(df: DataFrame, declared: StructType) -> DataFrame:
    """Return ``df`` unchanged, or raise naming every column that is absent or mistyped."""
    found = {f.name: f.dataType for f in df.schema.fields}
    problems = []
    for f in declared.fields:
        if f.name not in found:
            problems.append(f"{f.name} is absent")
        elif found[f.name] != f.dataType:
            problems.append(
                f"{f.name} is {found[f.name].simpleString()}, not {f.dataType.simpleString()}"
            )
    if problems:
        raise ContractError("; ".join(problems))
    return df


def conform(df: DataFrame, declared: StructType) -> DataFrame:
    """Project ``df`` to the declared columns, in order, with the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared.fields])
