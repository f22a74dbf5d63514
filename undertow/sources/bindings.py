"""How the landed tables play the roles of the warehouse's source tables.

Each role is one SELECT in the SQL subset that Spark and the checking engine share, so both
sides of a comparison start from the same rows. ``{name}`` is another role or a landed table;
``@name(...)`` is one of the few expressions the two engines spell differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .contracts import CONTRACTS, conform, contract

SPARK_SPELLING = {
    "ms": "unix_millis(cast({0} as timestamp))",
    "json": "get_json_object({0}, '$.{1}')",
    "each": "explode(array({args}))",
    "asset": "case when {0} % 14 = 0 then concat('dashboard:board ', {0}) "
    "when {0} % 7 = 0 then concat('chart:chart ', {0}) "
    "when {0} % 5 = 0 then concat('landing.feed_', {0}) "
    "when {0} % 5 in (1, 2) then concat('core.model_', {0}) "
    "else concat('marts.mart_', {0}) end",
}
DUCKDB_SPELLING = {
    **SPARK_SPELLING,
    "ms": "epoch_us({0}) // 1000",
    "json": "json_extract_string({0}, '$.{1}')",
    "each": "unnest([{args}])",
}

_CURRENCY = "case {0} % 4 when 0 then 'usd' when 1 then 'eur' when 2 then 'gbp' else 'jpy' end"

BINDINGS = {
    # One row per order line: the landed feed repeats some (order, line) pairs.
    "lines": """
        select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey,
               min(l_quantity) as l_quantity, min(l_extendedprice) as l_extendedprice,
               min(l_tax) as l_tax, min(ascii(l_returnflag)) as flag_code,
               min(l_shipdate) as l_shipdate
        from {lineitem} group by l_orderkey, l_linenumber""",
    "order_base": f"""
        select o_orderkey as order_id,
               case when o_custkey % 3 = 0 then o_custkey + 1 else o_custkey end as customer_id,
               o_orderkey % (select count(*) from {{supplier}}) as merchant_id,
               o_orderdate + (o_orderkey * 7919 % 86400) * interval '1' second as order_ts,
               case o_orderstatus
                   when 'F' then 'completed'
                   when 'O' then case when o_orderkey % 7 = 0 then 'pending' else 'completed' end
                   else case when o_orderkey % 2 = 0 then 'cancelled' else 'returned' end
               end as status,
               {_CURRENCY.format("o_custkey")} as currency_code,
               cast(o_totalprice as decimal(12,2)) as gross_amount,
               cast(case when o_orderpriority = '1-URGENT' then 20 else 0 end as decimal(12,2))
                   as discount_amount,
               cast(case when o_orderkey % 3 = 0 then 4.99 else 0.00 end as decimal(12,2))
                   as shipping_amount,
               case o_orderkey % 3 when 0 then 'web' when 1 then 'app' else 'partner' end as channel,
               o_orderpriority as priority
        from {{orders}}""",
    "raw_orders": """
        select order_id, customer_id, merchant_id, order_ts, status, currency_code, gross_amount,
               discount_amount, shipping_amount, channel
        from {order_base}""",
    "raw_customers": """
        select c_custkey as customer_id, c_name || '@Example.test' as email, c_name as full_name,
               lower(n_name) as country_code,
               cast('1994-01-01' as timestamp) + (c_custkey % 700) * interval '1' day as signup_ts,
               case when c_custkey % 10 < 7 then 'active' when c_custkey % 10 < 9 then 'dormant'
                    else 'closed' end as account_status,
               c_custkey % 2 = 0 as marketing_opt_in,
               case when c_mktsegment <> 'MACHINERY' then lower(c_mktsegment) end as lifetime_tier,
               case when c_custkey % 10 = 9 and c_acctbal < 3000
                    then cast('2001-06-30' as timestamp) end as deleted_at
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "raw_addresses": """
        select c_custkey * 2 as address_id, c_custkey as customer_id, 'shipping' as address_type,
               c_name as line1, 'city ' || cast(c_custkey % 50 as string) as city,
               case when c_custkey % 4 <> 0 then n_name end as region,
               case when c_custkey % 6 <> 0 then cast(10000 + c_custkey as string) end
                   as postal_code,
               lower(n_name) as country_code, c_custkey % 5 <> 0 as is_default
        from {customer} join {nation} on c_nationkey = n_nationkey
        union all
        select c_custkey * 2 + 1, c_custkey, 'billing', c_name,
               'city ' || cast(c_custkey % 40 as string), n_name,
               cast(20000 + c_custkey as string), lower(n_name), c_custkey % 5 = 0
        from {customer} join {nation} on c_nationkey = n_nationkey
        where c_acctbal > 5000""",
    "raw_product_categories": """
        select distinct cast(p_size as bigint) as category_id,
               'category ' || cast(p_size as string) as category_name,
               cast(case when p_size > 10 then p_size % 10 end as bigint) as parent_category_id,
               p_size % 9 = 0 as is_regulated
        from {part}""",
    "raw_products": f"""
        select p_partkey as product_id,
               p_partkey % (select count(*) from {{supplier}}) as merchant_id,
               cast(p_size as bigint) as category_id, 'sku-' || cast(p_partkey as string) as sku,
               p_name as title, cast(p_retailprice as decimal(12,2)) as list_price,
               {_CURRENCY.format("p_partkey")} as currency_code, p_partkey % 8 <> 0 as is_active,
               cast('1994-06-01' as timestamp) + (p_partkey % 400) * interval '1' day as created_ts
        from {{part}}""",
    "raw_merchants": f"""
        select s_suppkey as merchant_id, s_name as merchant_name, lower(n_name) as country_code,
               cast('1993-01-01' as timestamp) + (s_suppkey % 900) * interval '1' day
                   as onboarded_ts,
               case when s_suppkey % 6 < 3 then 'low' when s_suppkey % 6 < 5 then 'medium'
                    else 'high' end as risk_band,
               {_CURRENCY.format("s_suppkey")} as settlement_currency,
               s_suppkey % 33 = 0 as is_suspended
        from {{supplier}} join {{nation}} on s_nationkey = n_nationkey""",
    "raw_order_items": f"""
        select l_orderkey * 8 + l_linenumber as order_item_id, l_orderkey as order_id,
               l_partkey as product_id, 1 + l_linenumber % 3 as quantity,
               cast(l_extendedprice as decimal(12,2)) as unit_price,
               {_CURRENCY.format("l_orderkey")} as currency_code
        from {{lines}}""",
    "raw_payment_methods": """
        select c_custkey as payment_method_id, c_custkey as customer_id,
               case c_custkey % 3 when 0 then 'card' when 1 then 'wallet' else 'transfer' end
                   as method_type,
               case when c_custkey % 3 = 0 then cast(400000 + c_custkey % 1000 as string) end
                   as card_bin,
               case when c_custkey % 4 <> 0 then lower(n_name) end as issuer_country,
               cast('1994-02-01' as timestamp) + (c_custkey % 700) * interval '1' day as added_ts
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "payment_base": """
        select order_id * 2 as payment_id, order_id, customer_id, currency_code,
               order_ts + (2 + order_id % 239) * interval '1' second as attempted_ts,
               priority = '5-LOW' as is_declined, gross_amount - discount_amount + shipping_amount
                   as amount
        from {order_base} where status <> 'pending'
        union all
        select order_id * 2 + 1, order_id, customer_id, currency_code,
               order_ts + (300 + order_id % 9000) * interval '1' second,
               order_id % 4 = 0, gross_amount - discount_amount + shipping_amount
        from {order_base}
        where status <> 'pending' and priority = '5-LOW' and gross_amount > 150000""",
    "raw_payments": """
        select payment_id, order_id, customer_id as payment_method_id, attempted_ts,
               case when not is_declined
                    then attempted_ts + (1 + payment_id % 90) * interval '1' second end
                   as settled_ts,
               case when is_declined then 'declined' else 'settled' end as status,
               cast(amount as decimal(12,2)) as amount, currency_code,
               case order_id % 4 when 0 then 'northpay' when 1 then 'swiftline' when 2 then 'coral'
                    else 'meridian' end as processor,
               case when is_declined then case when order_id % 2 = 0 then 'insufficient_funds'
                    else 'do_not_honour' end end as decline_reason
        from {payment_base}""",
    "raw_refunds": f"""
        select l_orderkey as refund_id, l_orderkey * 2 as payment_id,
               l_shipdate + (l_partkey % 240) * interval '1' hour as refunded_ts,
               cast(l_quantity as decimal(12,2)) as amount,
               {_CURRENCY.format("l_orderkey")} as currency_code,
               case l_suppkey % 3 when 0 then 'damaged' when 1 then 'late' else 'unwanted' end
                   as reason_code
        from {{lines}} where flag_code = ascii('R') and l_linenumber = 1""",
    "raw_chargebacks": f"""
        select l_orderkey as chargeback_id, l_orderkey * 2 as payment_id,
               l_shipdate + interval '12' hour as opened_ts,
               case when l_orderkey % 3 <> 0
                    then l_shipdate + (24 * (10 + l_partkey % 50)) * interval '1' hour end
                   as resolved_ts,
               cast(l_quantity * 10 as decimal(12,2)) as amount,
               {_CURRENCY.format("l_orderkey")} as currency_code,
               case l_partkey % 4 when 0 then 'fraud' when 1 then 'not_received'
                    when 2 then 'duplicate' else 'quality' end as reason_code,
               case when l_suppkey % 2 = 0 then 'merchant' else 'platform' end as liability
        from {{lines}} where flag_code = ascii('A') and l_linenumber = 2 and l_tax > 0.05""",
    "raw_carriers": """
        select * from (values
            (1, 'Plover Freight', 'economy', 7), (2, 'Heron Post', 'standard', 4),
            (3, 'Swift Couriers', 'express', 2), (4, 'Kestrel Same Day', 'same_day', 1),
            (5, 'Gannet Lines', 'economy', 7), (6, 'Osprey Parcel', 'standard', 4),
            (7, 'Merlin Express', 'express', 2), (8, 'Wren Local', 'same_day', 1)
        ) as carriers(carrier_id, carrier_name, service_level, promised_days)""",
    "shipment_base": """
        select l_orderkey as shipment_id, l_orderkey as order_id,
               1 + l_suppkey % 8 as carrier_id,
               case when l_orderkey % 33 <> 0
                    then o_orderdate + (4 + l_partkey % 93) * interval '1' hour end as shipped_ts,
               l_partkey, l_suppkey
        from {lines} join {orders} on l_orderkey = o_orderkey where l_linenumber = 1""",
    "raw_shipments": """
        select shipment_id, order_id, carrier_id, shipped_ts,
               case when shipment_id % 16 <> 0
                    then shipped_ts + (24 * (1 + l_partkey % 9) + l_suppkey % 24) * interval '1' hour
               end as delivered_ts,
               case when shipped_ts is null then 'pending' when shipment_id % 16 = 0
                    then 'in_transit' else 'delivered' end as status,
               case when shipped_ts is not null then 'trk-' || cast(shipment_id as string) end
                   as tracking_ref
        from {shipment_base}""",
    "raw_promotions": """
        select p_partkey as promotion_id, 'PROMO-' || cast(p_partkey as string) as promo_code,
               case when p_partkey % 2 = 0 then 'percent' else 'fixed' end as discount_type,
               cast(5 + p_partkey % 20 as decimal(12,2)) as discount_value,
               cast('1995-01-01' as timestamp) + (p_partkey % 1200) * interval '1' day as starts_ts,
               cast('1995-01-01' as timestamp)
                   + (p_partkey % 1200 + 7 + p_partkey % 60) * interval '1' day as ends_ts,
               cast(case when p_partkey % 25 = 0 then 0 else 1000 + p_partkey % 5000 end
                    as decimal(12,2)) as budget_amount
        from {part}""",
    "raw_promotion_redemptions": """
        select order_id as redemption_id, order_id % (select count(*) from {part}) as promotion_id,
               order_id, customer_id, order_ts as redeemed_ts, discount_amount as discount_applied
        from {order_base} where discount_amount > 0""",
    "raw_subscriptions": f"""
        select c_custkey as subscription_id, c_custkey as customer_id,
               case c_custkey % 3 when 0 then 'basic' when 1 then 'plus' else 'pro' end as plan_code,
               cast('1995-03-01' as timestamp) + (c_custkey % 2000) * interval '1' day as started_ts,
               case when c_custkey % 4 = 0 then cast('1995-03-01' as timestamp)
                    + (c_custkey % 2000 + 90) * interval '1' day end as cancelled_ts,
               cast(10 + c_custkey % 90 as decimal(12,2)) as mrr_amount,
               {_CURRENCY.format("c_custkey")} as currency_code,
               case when c_custkey % 5 = 0 then 'annual' else 'monthly' end as billing_interval
        from {{customer}} where c_acctbal > 2000""",
    "raw_support_tickets": """
        select event_id as ticket_id, user_id as customer_id,
               case when event_id % 3 <> 0 then event_id % (select count(*) from {orders}) end
                   as order_id,
               ts as opened_ts,
               case when event_id % 7 <> 0 then ts + (event_id % 72) * interval '1' hour end
                   as closed_ts,
               case event_id % 5 when 0 then 'billing' when 1 then 'delivery' else 'product' end
                   as category,
               case event_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high'
                    else 'urgent' end as priority,
               case when event_id % 6 <> 0 then 1 + event_id % 5 end as csat_score
        from {events} where event_type = 'error'""",
    "fx_days": """
        select rate_date, @each('eur', 'gbp', 'jpy') as quote_currency
        from (select distinct cast(o_orderdate as date) as rate_date from {orders}) as days""",
    "raw_fx_rates": """
        select rate_date, 'usd' as base_currency, quote_currency,
               cast(case quote_currency when 'eur' then 0.92 when 'gbp' then 0.79 else 148.50 end
                    * (1 + (extract(day from rate_date) % 11 - 5) * 0.004) as decimal(18,8))
                   as rate,
               'reference desk' as source
        from {fx_days}""",
    "event_base": """
        select cast(event_id as string) as event_id, event_id as event_no,
               cast(user_id as string) || '-' || cast(cast(ts as date) as string) as session_id,
               case when user_id % 3 <> 0 then user_id end as customer_id, user_id,
               @ms(ts) as event_ts_ms, event_type, value,
               cast(@json(props, k) as int) as device_no, ts
        from {events}""",
    "ev_app_sessions": """
        select session_id, min(customer_id) as customer_id,
               'dev-' || cast(min(device_no) as string) as device_id,
               min(event_ts_ms) as started_ts_ms,
               case when min(user_id) % 25 <> 0 then max(event_ts_ms) end as ended_ts_ms,
               case when min(user_id) % 2 = 0 then '5.1.0' else '5.2.0' end as app_version,
               case when min(user_id) % 10 <> 0
                    then 'c' || cast(min(user_id) % 25 as string) end as ip_country
        from {event_base} group by session_id""",
    "ev_page_views": """
        select event_id, session_id, customer_id, event_ts_ms,
               '/p/' || cast(event_no % 40 as string) as path,
               case when event_no % 4 <> 0 then 'search' end as referrer,
               case when event_no % 5 = 0 then '' when event_no % 5 = 1 then null
                    when event_no % 5 = 2 then 'mail' else 'ads' end as utm_source,
               case when event_no % 2 = 0 then 'phone' else 'desktop' end as device_type
        from {event_base} where event_type = 'view'""",
    "ev_product_views": """
        select event_id, session_id, customer_id,
               event_no % (select count(*) from {part}) as product_id, event_ts_ms,
               case when event_no % 10 <> 0 then cast(event_no * 37 % 60001 as int) end as dwell_ms
        from {event_base} where event_type = 'click'""",
    "ev_add_to_cart": """
        select event_id, session_id, customer_id,
               event_no % (select count(*) from {part}) as product_id,
               cast(1 + event_no % 3 as int) as quantity, event_ts_ms
        from {event_base} where event_type = 'purchase'""",
    "ev_checkout_steps": """
        select event_id, session_id, customer_id,
               case event_no % 4 when 0 then 'address' when 1 then 'shipping' when 2 then 'payment'
                    else 'confirm' end as step_name,
               cast(event_no % 4 as int) as step_index, event_ts_ms,
               event_no % 6 = 0 as abandoned
        from {event_base} where event_type = 'purchase' and value > 15""",
    "ev_device_fingerprints": """
        select 'dev-' || cast(device_no as string) as device_id, min(event_ts_ms) as first_seen_ms,
               max(event_ts_ms) as last_seen_ms,
               case when device_no % 2 = 0 then 'android' else 'ios' end as os_family,
               device_no % 47 = 0 as is_emulator,
               cast((device_no % 100) * 0.01 as decimal(5,4)) as trust_score
        from {event_base} where device_no is not null group by device_no""",
    "ev_search_queries": """
        select 's' || event_id as event_id, session_id, customer_id,
               'term ' || cast(event_no % 60 as string) as query_text,
               cast(event_no % 8 as int) as result_count, event_ts_ms
        from {event_base} where event_type = 'view' and value > 20""",
    "ev_email_events": """
        select event_id, user_id as customer_id, 'camp-' || cast(event_no % 12 as string)
                   as campaign_id,
               case when event_no % 3 = 0 then 'open' else 'delivered' end as event_type,
               event_ts_ms
        from {event_base} where event_type = 'signup'""",
    "ev_auth_events": """
        select event_id, customer_id, 'dev-' || cast(device_no as string) as device_id,
               case when event_no % 2 = 0 then 'login' else 'mfa_challenge' end as event_type,
               event_no % 9 <> 0 as succeeded,
               case when user_id % 11 <> 0 then 'c' || cast(user_id % 25 as string) end
                   as ip_country,
               event_ts_ms
        from {event_base} where event_type in ('signup', 'error')""",
    "ops_facilities": """
        select s_suppkey as facility_id, 'F' || cast(1000 + s_suppkey as string) as facility_code,
               r_name as region, cast(800 + s_suppkey * 137 % 1700 as int) as capacity_units,
               cast('1990-01-01' as date) as opened_date, lower(n_name) as owner_team
        from {supplier} join {nation} on s_nationkey = n_nationkey
             join {region} on n_regionkey = r_regionkey""",
    "ops_carriers": """
        select cast(r_regionkey as bigint) as carrier_id,
               'Carrier ' || cast(r_regionkey as string) as carrier_name,
               case r_regionkey % 3 when 0 then 'gold' when 1 then 'silver' else 'bronze' end
                   as service_tier, r_name as home_region
        from {region}""",
    "ops_shipment_base": """
        select o_orderkey as shipment_id, o_custkey % (select count(*) from {supplier})
                   as facility_id,
               o_orderkey % 5 as carrier_id, o_custkey % 40 as route_no, o_orderpriority,
               o_orderdate + (o_orderkey % 24) * interval '1' hour as dispatched_at,
               o_orderdate + (o_orderkey % 24 + 24 * (1 + o_orderkey % 4)) * interval '1' hour
                   as promised_at
        from {orders}""",
    "ops_shipments": """
        select shipment_id, facility_id, carrier_id, 'R' || cast(route_no as string) as route_code,
               dispatched_at, promised_at,
               case when shipment_id % 11 <> 0
                    then promised_at + (shipment_id * 13 % 48 - 12) * interval '1' hour end
                   as delivered_at,
               case when shipment_id % 11 = 0 then 'in_transit' else 'delivered' end as status,
               cast(1 + shipment_id % 20 as int) as package_count,
               case o_orderpriority when '1-URGENT' then 'priority' when '2-HIGH' then 'fragile'
                    else 'standard' end as priority
        from {ops_shipment_base}""",
    "ops_snapshot_days": """
        select distinct o_custkey % (select count(*) from {supplier}) as facility_id,
               cast(o_orderdate as date) as snapshot_date
        from {orders} where o_orderstatus <> 'P'""",
    "ops_inventory_snapshots": """
        select facility_id * 100000000 + extract(year from snapshot_date) * 10000
                   + extract(month from snapshot_date) * 100 + extract(day from snapshot_date)
                   as snapshot_id,
               facility_id, snapshot_date,
               cast((facility_id * 97 + 31) % 1600 as int) as units_on_hand,
               cast(facility_id * 13 % 200 as int) as units_reserved
        from {ops_snapshot_days}""",
    "ops_work_orders": """
        select p_partkey as work_order_id, p_partkey % (select count(*) from {supplier})
                   as facility_id,
               cast('2001-01-01' as timestamp) + (p_partkey % 300) * interval '1' day as opened_at,
               case when p_partkey % 9 <> 0 then cast('2001-01-01' as timestamp)
                    + (24 * (p_partkey % 300) + 1 + p_partkey % 200) * interval '1' hour end
                   as closed_at,
               'issue-' || cast(p_partkey % 6 as string) as issue_code,
               case p_partkey % 3 when 0 then 'minor' when 1 then 'major' else 'critical' end
                   as severity,
               case when p_partkey % 9 = 0 then 'open' else 'closed' end as status
        from {part}""",
    "ops_scan_events": """
        select 'scan-' || cast(l_orderkey * 8 + l_linenumber as string) as event_id,
               l_orderkey as shipment_id, l_suppkey as facility_id,
               case when l_linenumber % 2 = 0 then 'depart' else 'arrive' end as event_type,
               l_shipdate + l_linenumber * interval '1' hour as event_ts,
               case when l_partkey % 17 = 0 then 'MISROUTE' when l_partkey % 23 = 0 then 'DAMAGED'
               end as exception_code
        from {lines}""",
    "ops_temperature_readings": """
        select cast(event_id as string) as event_id,
               user_id % (select count(*) from {supplier}) as facility_id,
               cast('1995-01-01' as timestamp) + (24 * (event_id * 31 % 2400) + event_id % 24)
                   * interval '1' hour as recorded_at,
               cast(value as decimal(8,2)) as celsius,
               case when event_id % 41 = 0 then 'alert' else 'ok' end as sensor_status
        from {events}""",
    # Lineage of a warehouse with one asset per part.
    "lin_assets": """
        select @asset(p_partkey) as asset,
               case when p_partkey % 14 = 0 then 'dashboard' when p_partkey % 7 = 0 then 'chart'
                    else 'dataset' end as kind,
               p_name as name,
               case when p_partkey % 7 = 0 then 'bi' when p_partkey % 5 = 0 then 'landing'
                    when p_partkey % 5 in (1, 2) then 'core' else 'marts' end as layer,
               case when p_partkey % 8 <> 0 then p_brand end as team,
               case when p_partkey % 11 = 0 then 'weekly' when p_partkey % 5 = 1 then 'continuous'
                    when p_partkey % 5 = 2 then 'hourly' when p_partkey % 5 = 3 then 'daily_0630'
                    when p_partkey % 5 = 4 then 'daily_1845' end as refresh_cadence,
               cast(case when p_partkey % 4 = 1 then 24 when p_partkey % 4 = 2 then 6 end as int)
                   as sla_hours,
               case p_partkey % 4 when 0 then 'tier1' when 1 then 'tier2' when 2 then 'tier3' end
                   as tier,
               case p_partkey % 6 when 0 then true when 1 then false when 3 then false end
                   as replicated,
               case when p_partkey % 9 = 0 then 'cold copy' end as fallback_source,
               case when p_partkey % 13 = 0 then null when p_partkey % 3 = 0 then 'view'
                    else 'table' end as materialization
        from {part}""",
    "lin_columns": """
        select @asset(p_partkey) as asset, column_name,
               case column_name when 'c0' then 'bigint' when 'c1' then 'timestamp'
                    else 'text' end as native_type,
               column_name <> 'c0' as nullable
        from (select p_partkey, @each('c0', 'c1', 'c2', 'c3') as column_name from {part}) as cols""",
    "lin_owners": """
        select @asset(p_partkey) as asset,
               'owner ' || cast(p_partkey % (select count(*) from {supplier}) as string) as owner
        from {part} where p_size <= 40
        union all
        select @asset(p_partkey), 'steward ' || p_brand from {part} where p_size between 20 and 45""",
    "lin_link_ids": """
        select distinct s, t
        from (select p_partkey as s, p_size,
                     @each(2 * p_partkey + 1, 2 * p_partkey + 2, 3 * p_partkey + 1) as t
              from {part}) as links
        where t < (select count(*) from {part}) and s < t""",
    "lin_edges": """
        select @asset(s) as source, @asset(t) as target from {lin_link_ids}""",
    "lin_column_link_ids": """
        select s, t, @each(0, 1, 2) as j
        from {lin_link_ids} join {part} on p_partkey = s where p_size > 10""",
    "lin_column_edges": """
        select @asset(s) as source, 'c' || cast(j as string) as source_column,
               @asset(t) as target, 'c' || cast((j + t) % 4 as string) as target_column
        from {lin_column_link_ids}""",
    "lin_usage": """
        select @asset(part_no) as asset, bucket, user_name, query_text, runs
        from (select o_orderkey * 17 % (select count(*) from {part}) as part_no,
                     cast(o_orderdate as date) as bucket,
                     'user ' || cast(o_custkey as string) as user_name,
                     'query ' || cast(o_orderkey % 97 as string) as query_text,
                     case when o_orderstatus = 'P' then 0 else 1 + o_orderkey % 3 end as runs
              from {orders}) as log
        where part_no % 7 <> 0""",
    # The same estate as a catalog describes it: a physical and a modelling record per dataset,
    # one record for everything else. Angle brackets stand for braces until the last step.
    "cat_record_text": """
        select 'urn:li:dataset:(urn:li:dataPlatform:postgres,warehouse.' || asset || ',PROD)' as urn,
               '<"name":"' || name || '","schemaMetadata":<"fields":[<"fieldPath":"c0",'
               || '"nativeDataType":"bigint","nullable":false>,<"fieldPath":"c1">]>>' as body
        from {lin_assets} where kind = 'dataset'
        union all
        select 'urn:li:dataset:(urn:li:dataPlatform:dbt,warehouse.' || asset || ',PROD)',
               '<"properties":<"name":"' || name || '","customProperties":['
               || '<"key":"team","value":"' || coalesce(team, '') || '">,'
               || '<"key":"sla_hours","value":"' || coalesce(cast(sla_hours as string), 'soon')
               || '">,<"key":"replicated","value":" ' || case when replicated then 'True' else 'no' end
               || ' ">]>,"ownership":<"owners":[<"owner":<"urn":"urn:li:corpuser:'
               || coalesce(team, 'nobody') || '">>]>,"tags":<"tags":[<"tag":<"urn":"urn:li:tag:'
               || coalesce(tier, 'untiered') || '">>]>>'
        from {lin_assets} where kind = 'dataset'
        union all
        select 'urn:li:' || kind || ':(bi,' || asset || ')',
               '<"properties":<"name":"' || split_part(asset, ':', 2) || '">>'
        from {lin_assets} where kind <> 'dataset'""",
    "cat_records": """
        select urn, replace(replace(body, '<', chr(123)), '>', chr(125)) as body
        from {cat_record_text}""",
    "cat_keys": """
        select 'urn:li:dataset:(urn:li:dataPlatform:postgres,warehouse.' || asset || ',PROD)' as urn,
               asset
        from {lin_assets} where kind = 'dataset'
        union all
        select 'urn:li:dataset:(urn:li:dataPlatform:dbt,warehouse.' || asset || ',PROD)', asset
        from {lin_assets} where kind = 'dataset'
        union all
        select 'urn:li:' || kind || ':(bi,' || asset || ')', asset
        from {lin_assets} where kind <> 'dataset'""",
    # Lineage crosses between siblings, points at a sibling of its own, and at unknown tables.
    "cat_upstreams": """
        select t.urn, s.urn as upstream_urn
        from {lin_edges} join {cat_keys} as s on s.asset = source
             join {cat_keys} as t on t.asset = target
        union all
        select a.urn, b.urn from {cat_keys} as a join {cat_keys} as b on a.asset = b.asset
        union all
        select urn, 'urn:li:dataset:(urn:li:dataPlatform:s3,' || asset || ',PROD)' from {cat_keys}""",
    "cat_groups": """
        select s.urn, '["' || t.urn || '","urn:li:mlFeature:(lost,one)","' || s.urn || '"]' as members
        from {lin_edges} join {cat_keys} as s on s.asset = source
             join {cat_keys} as t on t.asset = target""",
    "cat_probes": """
        select distinct source, source_column, target from {lin_column_edges}""",
    "cat_paths": """
        select @asset(s) as source, 'c' || cast(j as string) as source_column, @asset(t) as target,
               column_name as target_column,
               case when (s + j) % 10 <> 9
                    then column_name = 'c' || cast((j + t) % 4 as string) end as connected
        from (select s, t, j, @each('c0', 'c1', 'c2', 'c3') as column_name
              from {lin_column_link_ids}) as pairs""",
    "cat_declared": """
        select @asset(p_partkey) as asset, 'c0' as column_name from {part} where p_size > 5""",
    "sim_faults": """
        select 'fault on ' || origin as scenario, kind, origin,
               case when kind <> 'drop_asset' then column_name end as column_name, at_minute
        from (select @asset(p_partkey) as origin,
                     case (p_partkey * 7 + p_size) % 5 when 0 then 'drop_column'
                          when 1 then 'drop_asset' when 2 then 'change_column_type'
                          when 3 then 'stop_new_rows' else 'null_out_column' end as kind,
                     'c' || cast(p_partkey % 4 as string) as column_name,
                     cast(p_partkey * 37 % 1440 as int) as at_minute
              from {part}) as faults""",
    # One experiment per order, most of them on an earlier state of the estate.
    "led_evidence": """
        select 'state ' || o_orderstatus as fingerprint,
               'fault on ' || asset as scenario, asset as fault_asset
        from (select o_orderstatus, @asset(part_no) as asset
              from (select o_orderstatus,
                           o_orderkey * 29 % (select count(*) from {part}) as part_no
                    from {orders} where o_orderpriority = '2-HIGH') as picks) as runs""",
    "led_times": """
        select o_orderkey as line_no, o_custkey % (select count(*) from {supplier}) as target_no,
               o_orderstatus, o_orderpriority, o_totalprice, o_orderdate,
               o_orderdate + (o_orderkey * 7919 % 86400) * interval '1' second as at_ts
        from {orders}""",
    "led_stamps": """
        select line_no, target_no, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, at_ts,
               substr(cast(at_ts as string), 1, 10) || 'T' || substr(cast(at_ts as string), 12, 8)
                   || case when line_no % 2 = 0 then 'Z' else '+02:00' end as stamp
        from {led_times}""",
    "led_attempts": """
        select line_no, case when o_totalprice < 2000 then 'last night' else stamp end as attempted_at,
               case when o_orderstatus = 'F' then 'succeeded' when o_orderstatus = 'O' then 'failed'
                    when o_totalprice > 300000 then 'crashed' else 'failed' end as status,
               case when o_orderpriority = '5-LOW' and o_totalprice > 400000 then ' '
                    else lower(o_orderpriority) end as stage,
               case when o_orderpriority <> '4-NOT SPECIFIED' or o_orderstatus = 'F'
                    then 'target ' || cast(target_no as string) end as target
        from {led_stamps}""",
    "led_reads": """
        select line_no, stamp as read_at, 'target ' || cast(target_no as string) as target,
               'fp' || cast(line_no % 3 as string) as fingerprint, cast(line_no % 90 as int) as assets,
               case when line_no % 5 = 0 then 'capture ' || cast(line_no as string)
                    when line_no % 50 = 1 then 'capture lost' end as verification_artifact
        from {led_stamps} where o_orderstatus = 'F'""",
    "led_captures": """
        select 'capture ' || cast(line_no as string) as path,
               'target ' || cast(target_no as string) as target, at_ts as generated_at
        from {led_times} where o_orderstatus = 'F' or o_totalprice > 200000""",
    # What scoring runs recorded as most fragile: records, in some older lines names alone, or nothing.
    "led_scores": """
        select line_no, stamp as scored_at, 'target ' || cast(target_no as string) as target,
               cast(o_totalprice as decimal(12,2)) as mean_score,
               case when line_no % 7 = 0 then '[]'
                    when line_no % 3 = 0 then '["asset ' || cast(line_no % 40 as string) || '","asset x"]'
                    else '[' || chr(123) || '"origin":"asset ' || cast(line_no % 40 as string) || '","score":'
                         || cast(line_no % 90 as string) || '.25,"cost":100.0' || chr(125) || ','
                         || chr(123) || '"origin":"asset x","score":0.5,"cost":0' || chr(125) || ']' end as top
        from {led_stamps} where o_orderstatus = 'F'""",
    # The attempts as the lines of a file, some of them blank or cut short.
    "led_lines": """
        select line_no,
               case when line_no % 31 = 0 then '  '
                    when line_no % 17 = 0 then chr(123) || '"attempted_at":"' || attempted_at
                    else chr(123) || '"attempted_at":"' || attempted_at || '","status":"' || status
                         || '","line":' || cast(line_no as string) || chr(125) end as text
        from {led_attempts}""",
    # What an execution of each scenario found: consumers within two steps, where a tier is known.
    "sim_observed": """
        select distinct scenario, l.target as asset,
               case when tier = 'tier1' then 'unavailable' else 'degraded' end as impact
        from {sim_faults} join {lin_edges} as l on l.source = origin
             join {lin_assets} on asset = l.target
        where tier is not null
        union
        select distinct scenario, m.target, 'degraded'
        from {sim_faults} join {lin_edges} as l on l.source = origin
             join {lin_edges} as m on m.source = l.target
             join {lin_assets} on asset = m.target
        where tier = 'tier2'""",
    "pub_values": """
        select asset, property, value
        from (select @asset(p_partkey) as asset, p_partkey, p_size,
                     @each('undertow_fragility_rank', 'undertow_score', 'owner_note') as property,
                     p_brand as value
              from {part}) as props
        where property <> 'owner_note' or p_size > 25""",
    "pub_ranks": """
        select 'marts.mart_' || cast(p_partkey as string) as asset,
               case when p_size > 3 then p_partkey * 7919 % 100003 end as rank,
               cast(p_retailprice as decimal(12,2)) as score
        from {part}""",
    "pub_fresh": """
        select @asset(p_partkey) as asset, 'undertow_fragility_rank' as property,
               cast(p_size as string) as value
        from {part} where p_size <= 30""",
    "pub_incidents": """
        select case when o_orderstatus = 'F' then 'urn:li:incident:other_'
                    else 'urn:li:incident:undertow_' end || cast(o_orderkey as string) as incident,
               case when o_orderpriority = '1-URGENT' then 'RESOLVED' else 'ACTIVE' end as state,
               'day ' || cast(o_orderdate as string) as updated_at
        from {orders}""",
    "led_runs": """
        select 'run ' || cast(o_custkey as string) as run_id,
               'target ' || cast(o_custkey % (select count(*) from {supplier}) as string) as target,
               o_orderkey as line_no
        from {orders}""",
}

_MACRO = re.compile(r"@(\w+)\(((?:[^()]|\([^()]*\))*)\)")
_NAME = re.compile(r"\{(\w+)\}")


def spell(template: str, spelling: dict[str, str]) -> str:
    """Write the engine's own form of every ``@name(...)`` in ``template``."""

    def one(match: re.Match) -> str:
        args = [a.strip() for a in match[2].split(",")]
        return spelling[match[1]].format(*args, args=match[2])

    return _MACRO.sub(one, template)


def names_in(template: str) -> list[str]:
    """The roles and landed tables a template reads, in order of first use."""
    return list(dict.fromkeys(_NAME.findall(template)))


def bind(role: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """The DataFrame that plays ``role``; ``read`` resolves the names it is built from."""
    template = BINDINGS[role]
    inputs = {name: read(name) for name in names_in(template)}
    spark = next(iter(inputs.values())).sparkSession if inputs else _active()
    df = spark.sql(spell(template, SPARK_SPELLING), **inputs)
    return conform(df, contract(role)) if role in CONTRACTS else df


def _active():
    from pyspark.sql import SparkSession

    return SparkSession.active()
