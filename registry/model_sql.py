"""The models once more as SQL, for checking only: each is written from its meaning."""

_RATE = """left join (select rate_date, quote_currency, rate::double as r from {stg_fx_rates}
            where base_currency = 'USD') as fx on fx.rate_date = %s and fx.quote_currency = %s"""

MODEL_SQL = {
    "stg_addresses": """
        from {raw_addresses}
        select * replace (upper(country_code) as country_code),
               address_type = 'shipping' and is_default as is_default_shipping""",
    "stg_app_sessions": """
        from {ev_app_sessions}
        select * exclude (started_ts_ms, ended_ts_ms), make_timestamp(started_ts_ms * 1000) as started_ts,
               make_timestamp(ended_ts_ms * 1000) as ended_ts,
               (ended_ts_ms - started_ts_ms)::double / 1000 as duration_seconds,
               ended_ts_ms is null as is_unterminated, customer_id is null as is_anonymous""",
    "stg_auth_events": """
        from {ev_auth_events}
        select * exclude (event_ts_ms), make_timestamp(event_ts_ms * 1000) as event_ts,
               event_type = 'login' and not succeeded as is_failed_login,
               event_type = 'mfa_challenge' and not succeeded as is_failed_mfa""",
    "stg_chargebacks": """
        from {raw_chargebacks}
        select * replace (upper(currency_code) as currency_code), resolved_ts is null as is_open,
               reason_code = 'fraud' as is_fraud_dispute""",
    "stg_customers": """
        from {raw_customers}
        select * exclude (deleted_at) replace (lower(email) as email,
               upper(country_code) as country_code, ifnull(lifetime_tier, 'none') as lifetime_tier),
               account_status = 'active' as is_active
        where deleted_at is null""",
    "stg_device_fingerprints": """
        from {ev_device_fingerprints}
        select device_id, make_timestamp(first_seen_ms * 1000) as first_seen_ts,
               make_timestamp(last_seen_ms * 1000) as last_seen_ts, os_family, is_emulator,
               trust_score, is_emulator or trust_score < 0.4 as is_low_trust""",
    "stg_fx_rates": """
        select rate_date, upper(base_currency) as base_currency,
               upper(quote_currency) as quote_currency, rate, source from {raw_fx_rates}
        union all
        select rate_date, 'USD', 'USD', 1, 'identity' from {raw_fx_rates} group by rate_date""",
    "stg_merchants": """
        from {raw_merchants}
        select * replace (upper(country_code) as country_code,
               upper(settlement_currency) as settlement_currency),
               is_suspended or risk_band = 'high' as needs_review""",
    "stg_order_items": """
        from {raw_order_items}
        select * replace (upper(currency_code) as currency_code),
               unit_price * quantity as line_amount""",
    "stg_orders": """
        from {raw_orders}
        select * replace (upper(currency_code) as currency_code), order_ts::date as order_date,
               gross_amount + shipping_amount - discount_amount as net_amount,
               status = 'completed' as is_completed""",
    "stg_page_views": """
        from {ev_page_views}
        select * exclude (event_ts_ms) replace (case when utm_source is null or utm_source = ''
               then 'direct' else utm_source end as utm_source),
               make_timestamp(event_ts_ms * 1000) as event_ts""",
    "stg_payments": """
        from {raw_payments}
        select * replace (upper(currency_code) as currency_code), status = 'settled' as is_settled,
               epoch(settled_ts - attempted_ts) as settle_latency_seconds""",
    "stg_product_views": """
        from {ev_product_views}
        select * exclude (event_ts_ms), make_timestamp(event_ts_ms * 1000) as event_ts,
               dwell_ms >= 30000 as is_engaged_view""",
    "stg_products": """
        from {raw_products} select * replace (upper(currency_code) as currency_code)""",
    "stg_promotions": """
        from {raw_promotions} select *, epoch(ends_ts - starts_ts) / 86400 as window_days""",
    "stg_refunds": """
        from {raw_refunds}
        select * replace (upper(currency_code) as currency_code), refunded_ts::date as refund_date""",
    "stg_search_queries": """
        from {ev_search_queries}
        select * exclude (event_ts_ms), make_timestamp(event_ts_ms * 1000) as event_ts,
               result_count = 0 as is_zero_result""",
    "stg_shipments": """
        from {raw_shipments}
        select *, status = 'delivered' as is_delivered,
               epoch(delivered_ts - shipped_ts) / 86400 as transit_days""",
    "stg_subscriptions": """
        from {raw_subscriptions}
        select * replace (upper(currency_code) as currency_code),
               mrr_amount::double / if(billing_interval = 'annual', 12, 1) as normalised_mrr,
               cancelled_ts is null as is_active""",
    "int_orders_enriched": """
        select order_id, customer_id, merchant_id, order_ts, order_date, status, channel,
               is_completed, currency_code, gross_amount, discount_amount, shipping_amount,
               net_amount, ifnull(lines, 0) as item_count, ifnull(units, 0)::bigint as unit_count,
               ifnull(goods, 0) as items_amount, r as fx_rate_to_usd,
               net_amount / r as net_amount_usd, gross_amount / r as gross_amount_usd,
               discount_amount / r as discount_amount_usd
        from {stg_orders}
        left join (from {stg_order_items} select order_id, count(*) as lines, sum(quantity) as units,
                   sum(line_amount) as goods group by all) as basket using (order_id)
        """ + _RATE % ("order_date", "currency_code"),
    "int_customer_lifetime": """
        select c.customer_id, any_value(email) as email, any_value(country_code) as country_code,
               any_value(signup_ts) as signup_ts, any_value(account_status) as account_status,
               any_value(lifetime_tier) as lifetime_tier, any_value(is_active) as is_active,
               count(order_id) as order_count, count(*) filter (is_completed) as completed_order_count,
               ifnull(sum(net_amount_usd) filter (is_completed), 0) as lifetime_net_usd,
               count(distinct merchant_id) as distinct_merchants,
               min(order_ts) as first_order_ts, max(order_ts) as last_order_ts,
               epoch(timestamp '2001-12-31' - max(order_ts)) / 86400 as days_since_last_order,
               count(order_id) = 0 as is_never_ordered
        from {stg_customers} as c
        left join {int_orders_enriched} as o on o.customer_id = c.customer_id
        group by c.customer_id""",
    "int_customer_support_load": """
        select customer_id, country_code, lifetime_tier, count(ticket_id) as ticket_count,
               count(*) filter (ticket_id is not null and closed_ts is null) as open_ticket_count,
               count(*) filter (priority in ('urgent', 'high')) as escalated_ticket_count,
               count(distinct order_id) as orders_with_tickets,
               avg(epoch(closed_ts - opened_ts)) / 3600 as avg_resolution_hours,
               avg(csat_score) as avg_csat_score, max(opened_ts) as last_ticket_ts
        from {stg_customers} left join {raw_support_tickets} using (customer_id) group by all""",
    "int_funnel_steps": """
        select s.session_id, s.customer_id, s.started_ts, s.started_ts::date as session_date,
               s.is_anonymous, ifnull(pages, 0) as page_view_count,
               ifnull(looks, 0) as product_view_count, ifnull(kinds, 0) as distinct_products_viewed,
               ifnull(adds, 0) as add_to_cart_count, ifnull(units, 0)::bigint as cart_units,
               ifnull(steps, 0) as checkout_step_count, furthest as furthest_step_index,
               ifnull(gave_up, false) as any_abandoned, looks is not null as reached_product,
               adds is not null as reached_cart, furthest is not null as reached_checkout,
               furthest = 3 as reached_confirm
        from {stg_app_sessions} as s
        left join (select session_id, count(*) as pages from {stg_page_views} group by 1) as a
               on a.session_id = s.session_id
        left join (select session_id, count(*) as looks, count(distinct product_id) as kinds
                   from {stg_product_views} group by 1) as b on b.session_id = s.session_id
        left join (select session_id, count(*) as adds, sum(quantity) as units
                   from {ev_add_to_cart} group by 1) as c on c.session_id = s.session_id
        left join (select session_id, count(*) as steps, max(step_index) as furthest,
                   bool_or(abandoned) as gave_up from {ev_checkout_steps} group by 1) as d
               on d.session_id = s.session_id""",
    "int_merchant_daily": """
        select merchant_id, order_date, merchant_name, country_code, risk_band,
               settlement_currency, is_suspended, count(*) as order_count,
               count(*) filter (is_completed) as completed_order_count,
               count(distinct customer_id) as distinct_customers,
               sum(net_amount_usd) as net_amount_usd,
               sum(net_amount_usd) filter (is_completed) as completed_net_amount_usd,
               sum(discount_amount_usd) as discount_amount_usd,
               sum(unit_count)::bigint as unit_count
        from {int_orders_enriched} join {stg_merchants} using (merchant_id) group by all""",
    "int_payment_attempts": """
        select p.payment_id, order_id, payment_method_id, attempted_ts,
               attempted_ts::date as attempted_date, settled_ts, status, processor,
               decline_reason, is_settled, settle_latency_seconds, currency_code, amount,
               r as fx_rate_to_usd, amount / r as amount_usd,
               ifnull(back, 0) / r as refunded_amount_usd,
               ifnull(fought, 0) / r as disputed_amount_usd, ifnull(backs, 0) as refund_count,
               ifnull(fights, 0) as dispute_count, ifnull(fraud, false) as has_fraud_dispute,
               ifnull(unresolved, false) as has_open_dispute,
               if(is_settled, (amount - ifnull(back, 0) - ifnull(fought, 0)) / r, 0)
                   as net_settled_usd
        from {stg_payments} as p
        left join (from {stg_refunds} select payment_id, sum(amount) as back, count(*) as backs
                   group by all) as b on b.payment_id = p.payment_id
        left join (from {stg_chargebacks} select payment_id, sum(amount) as fought,
                   count(*) as fights, bool_or(is_fraud_dispute) as fraud,
                   bool_or(is_open) as unresolved group by all) as d on d.payment_id = p.payment_id
        """ + _RATE % ("attempted_ts::date", "p.currency_code"),
    "int_promotion_impact": """
        select promotion_id, promo_code, discount_type, discount_value, budget_amount, starts_ts,
               ends_ts, window_days, count(redemption_id) as redemption_count,
               count(distinct r.customer_id) as distinct_redeemers,
               sum(discount_applied) as discount_applied_local,
               sum(discount_amount_usd) as discount_applied_usd,
               sum(net_amount_usd) as attributed_net_usd,
               sum(discount_amount_usd) / nullif(budget_amount, 0)
                   as budget_consumed_ratio
        from {stg_promotions} left join {raw_promotion_redemptions} as r using (promotion_id)
        left join {int_orders_enriched} using (order_id)
        group by promotion_id, promo_code, discount_type, discount_value, budget_amount, starts_ts,
                 ends_ts, window_days""",
    "int_session_device": """
        select s.session_id, s.customer_id, s.device_id, started_ts, ended_ts, duration_seconds,
               app_version, s.ip_country, is_unterminated, is_anonymous, os_family, is_emulator,
               trust_score, is_low_trust, first_seen_ts as device_first_seen_ts,
               ifnull(n, 0) as auth_event_count, ifnull(logins, 0) as failed_login_count,
               ifnull(mfas, 0) as failed_mfa_count, ifnull(people, 0) as distinct_customers_on_device,
               ifnull(places, 0) as distinct_countries
        from {stg_app_sessions} as s
        left join {stg_device_fingerprints} as d on d.device_id = s.device_id
        left join (from {stg_auth_events} select device_id, count(*) as n,
                   count(*) filter (is_failed_login) as logins, count(*) filter (is_failed_mfa) as mfas,
                   count(distinct customer_id) as people, count(distinct ip_country) as places
                   group by all) as a on a.device_id = s.device_id""",
    "int_shipment_performance": """
        select shipment_id, s.order_id, carrier_id, carrier_name, service_level, promised_days,
               shipped_ts, delivered_ts, s.status, is_delivered, transit_days, order_date,
               merchant_id, if(is_delivered, transit_days <= promised_days, null) as met_promise,
               if(is_delivered, greatest(transit_days - promised_days, 0), null) as days_late
        from {stg_shipments} as s join {raw_carriers} using (carrier_id)
        left join {stg_orders} as o on o.order_id = s.order_id""",
    "mart_customer_360": """
        select l.*, ifnull(ticket_count, 0) as ticket_count,
               ifnull(open_ticket_count, 0) as open_ticket_count,
               ifnull(escalated_ticket_count, 0) as escalated_ticket_count,
               avg_resolution_hours, avg_csat_score, ifnull(plans, 0) as subscription_count,
               ifnull(live, 0) as active_subscription_count, ifnull(mrr, 0) as active_mrr,
               ifnull(live, 0) > 0 as is_subscriber
        from {int_customer_lifetime} as l
        left join {int_customer_support_load} as s on s.customer_id = l.customer_id
        left join (from {stg_subscriptions} select customer_id, count(*) as plans,
                   count(*) filter (is_active) as live, sum(normalised_mrr) filter (is_active) as mrr
                   group by all) as b on b.customer_id = l.customer_id""",
    "mart_finance_reconciliation": """
        select p.*, ordered_net_usd, ordered_net_usd - settled_net_usd as unreconciled_usd,
               if(ordered_net_usd <> 0, (ordered_net_usd - settled_net_usd) / ordered_net_usd, null)
                   as unreconciled_ratio,
               settled_count / attempt_count as authorisation_rate
        from (from {int_payment_attempts} select attempted_date, processor, count(*) as attempt_count,
                   count(*) filter (is_settled) as settled_count,
                   sum(amount_usd) filter (is_settled) as settled_gross_usd,
                   sum(net_settled_usd) as settled_net_usd,
                   sum(refunded_amount_usd) as refunded_usd,
                   sum(disputed_amount_usd) as disputed_usd group by all) as p
        left join (from {int_orders_enriched} select order_date,
                   sum(net_amount_usd) filter (is_completed) as ordered_net_usd group by all) as o
               on o.order_date = p.attempted_date""",
    "mart_logistics_sla": """
        from {int_shipment_performance}
        select carrier_id, carrier_name, service_level, promised_days, count(*) as shipment_count,
               count(*) filter (is_delivered) as delivered_count, count(*) filter (met_promise) as on_time_count,
               count(*) filter (not met_promise) as late_count,
               count(*) filter (met_promise) / nullif(count(*) filter (is_delivered), 0) as on_time_rate,
               avg(transit_days) as avg_transit_days,
               quantile_cont(transit_days, 0.95) as p95_transit_days,
               avg(days_late) filter (days_late > 0) as avg_days_late_when_late,
               max(order_date) as last_order_date
        group by all""",
    "mart_marketing_funnel": """
        select session_date, count(*) as session_count,
               count(*) filter (is_anonymous) as anonymous_session_count,
               count(*) filter (reached_product) as reached_product_count,
               count(*) filter (reached_cart) as reached_cart_count,
               count(*) filter (reached_checkout) as reached_checkout_count,
               count(*) filter (reached_confirm) as reached_confirm_count,
               count(*) filter (any_abandoned) as abandoned_count,
               sum(page_view_count)::bigint as page_view_count,
               sum(product_view_count)::bigint as product_view_count,
               sum(ifnull(n, 0))::bigint as search_count,
               sum(ifnull(z, 0))::bigint as zero_result_count,
               count(*) filter (reached_cart) / nullif(count(*) filter (reached_product), 0) as product_to_cart_rate,
               count(*) filter (reached_confirm) / nullif(count(*) filter (reached_cart), 0) as cart_to_confirm_rate
        from {int_funnel_steps}
        left join (from {stg_search_queries} select session_id, count(*) as n,
                   count(*) filter (is_zero_result) as z group by all) as q using (session_id)
        group by session_date""",
    "mart_merchant_scorecard": """
        select r.*, ifnull(n, 0) as shipment_count, ifnull(good, 0) as on_time_count,
               good / nullif(n, 0) as on_time_rate, avg_transit_days, avg_days_late,
               discount_amount_usd / nullif(net_amount_usd, 0) as discount_intensity
        from (from {int_merchant_daily} select merchant_id, merchant_name, country_code, risk_band,
                   is_suspended, count(distinct order_date) as active_days,
                   sum(order_count)::bigint as order_count,
                   sum(completed_order_count)::bigint as completed_order_count,
                   sum(net_amount_usd) as net_amount_usd,
                   sum(completed_net_amount_usd) as completed_net_amount_usd,
                   sum(discount_amount_usd) as discount_amount_usd,
                   max(order_date) as last_order_date group by all) as r
        left join (from {int_shipment_performance} select merchant_id, count(*) as n,
                   count(*) filter (met_promise) as good, avg(transit_days) as avg_transit_days,
                   avg(days_late) as avg_days_late group by all) as f
               on f.merchant_id = r.merchant_id""",
    "mart_revenue_daily": """
        from (select order_date as day, 1 as o, is_completed::int as done, customer_id, merchant_id,
                     gross_amount_usd as g, net_amount_usd as n, discount_amount_usd as d,
                     null::double as sn, null::double as rf, null::double as ds, null::int as p,
                     null::boolean as st from {int_orders_enriched}
              union all
              select attempted_date, null, null, null, null, null, null, null, net_settled_usd,
                     refunded_amount_usd, disputed_amount_usd, 1, is_settled
              from {int_payment_attempts}) as both_sides
        select day as activity_date, count(o) as order_count,
               ifnull(sum(done), 0)::bigint as completed_order_count,
               count(distinct customer_id) as distinct_customers,
               count(distinct merchant_id) as distinct_merchants,
               ifnull(sum(g), 0) as gross_usd, ifnull(sum(n), 0) as net_usd,
               ifnull(sum(d), 0) as discount_usd, ifnull(sum(sn), 0) as settled_net_usd,
               ifnull(sum(rf), 0) as refunded_usd, ifnull(sum(ds), 0) as disputed_usd,
               count(p) as payment_attempt_count, count(*) filter (st) as settled_payment_count,
               count(*) filter (st) / nullif(count(p), 0) as authorisation_rate
        group by day""",
    "mart_subscription_health": """
        select plan_code, billing_interval, count(*) as subscription_count,
               count(*) filter (s.is_active) as active_count, count(*) filter (not s.is_active) as cancelled_count,
               count(*) filter (not s.is_active) / count(*) as churn_rate,
               sum(normalised_mrr / r) as mrr_usd,
               sum(normalised_mrr / r) filter (s.is_active) as active_mrr_usd,
               avg(normalised_mrr / r) as avg_mrr_usd,
               avg(lifetime_net_usd) as avg_subscriber_lifetime_usd,
               count(distinct s.customer_id) as distinct_subscribers
        from {stg_subscriptions} as s
        left join {int_customer_lifetime} as l on l.customer_id = s.customer_id
        """ + _RATE % ("s.started_ts::date", "s.currency_code") + " group by all",
    "mart_transaction_enriched": """
        select payment_id, p.order_id, attempted_ts, attempted_date, p.status, processor,
               decline_reason, is_settled, settle_latency_seconds, p.currency_code, amount_usd,
               net_settled_usd, refunded_amount_usd, disputed_amount_usd, has_fraud_dispute,
               has_open_dispute, o.customer_id, merchant_id, channel, item_count, unit_count,
               o.net_amount_usd as order_net_amount_usd,
               ifnull(devices, 0) as distinct_devices, ifnull(visits, 0) as session_count,
               ifnull(logins, 0)::bigint as failed_login_count,
               ifnull(mfas, 0)::bigint as failed_mfa_count, worst as min_device_trust,
               mean as avg_device_trust, ifnull(fake, false) as any_emulator,
               ifnull(places, 0) as max_countries_per_device
        from {int_payment_attempts} as p
        left join {int_orders_enriched} as o on o.order_id = p.order_id
        left join (from {int_session_device} select customer_id, count(distinct device_id) as devices,
                   count(distinct session_id) as visits, sum(failed_login_count) as logins,
                   sum(failed_mfa_count) as mfas, min(trust_score) as worst,
                   avg(trust_score) as mean, bool_or(is_emulator) as fake,
                   max(distinct_countries) as places group by all) as d
               on d.customer_id = o.customer_id""",
    "feature_customer_risk": """
        select l.customer_id, l.country_code, order_count, lifetime_net_usd, days_since_last_order,
               is_never_ordered,
               epoch(timestamp '2001-12-31' - l.signup_ts) / 86400 as account_age_days,
               count(distinct device_id) as device_count,
               count(distinct session_id) as session_count,
               count(*) filter (is_low_trust) as low_trust_session_count,
               ifnull(sum(failed_login_count), 0)::bigint as failed_login_count,
               ifnull(sum(failed_mfa_count), 0)::bigint as failed_mfa_count,
               ifnull(max(distinct_customers_on_device), 0) as max_customers_sharing_device,
               ifnull(max(distinct_countries), 0) as max_countries_per_device,
               min(trust_score) as min_device_trust,
               avg(if(session_id is null, null, ifnull(duration_seconds, 0)))
                   as avg_session_seconds,
               count(*) filter (is_unterminated) as unterminated_session_count,
               ifnull(sum(failed_login_count), 0) / nullif(count(distinct session_id), 0)
                   as failed_login_rate,
               count(distinct device_id) / nullif(order_count, 0) as devices_per_order
        from {int_customer_lifetime} as l
        left join {int_session_device} as s on s.customer_id = l.customer_id
        group by l.customer_id, l.country_code, order_count, lifetime_net_usd,
                 days_since_last_order, is_never_ordered, l.signup_ts""",
    "feature_merchant_risk": """
        select v.*, ifnull(n, 0) as payment_count, ifnull(bad, 0) as declined_payment_count,
               ifnull(fights, 0) as dispute_count, ifnull(frauds, 0) as fraud_dispute_count,
               ifnull(backs, 0) as refunded_payment_count, ifnull(fought, 0) as disputed_usd,
               ifnull(back, 0) as refunded_usd, bad / n as decline_rate,
               fights / n as dispute_rate,
               ifnull(fought, 0) / nullif(net_amount_usd, 0) as disputed_value_share
        from (from {int_merchant_daily} select merchant_id, merchant_name, risk_band, is_suspended,
                   count(distinct order_date) as active_days,
                   sum(order_count)::bigint as order_count,
                   sum(distinct_customers)::bigint as customer_touches,
                   sum(net_amount_usd) as net_amount_usd group by all) as v
        left join (select merchant_id, count(*) as n, count(*) filter (not is_settled) as bad,
                   count(*) filter (dispute_count > 0) as fights, count(*) filter (has_fraud_dispute) as frauds,
                   count(*) filter (refund_count > 0) as backs, sum(disputed_amount_usd) as fought,
                   sum(refunded_amount_usd) as back
                   from {int_payment_attempts} join {int_orders_enriched} using (order_id)
                   group by all) as d on d.merchant_id = v.merchant_id""",
    "feature_txn_velocity": """
        from (from {mart_transaction_enriched} select customer_id, attempted_date, count(*) as n,
                   count(*) filter (not is_settled) as bad, sum(amount_usd) as usd,
                   count(distinct merchant_id) as sellers
              where customer_id is not null group by all) as per_day
        select customer_id, count(*) as active_days, sum(n)::bigint as total_attempts,
               sum(bad)::bigint as total_declines, sum(usd) as total_amount_usd,
               avg(n) as avg_daily_attempts, max(n) as max_daily_attempts,
               stddev_pop(n) as stddev_daily_attempts, max(n) / avg(n) as peak_to_mean_attempts,
               avg(usd) as avg_daily_amount_usd, max(usd) as max_daily_amount_usd,
               max(sellers) as max_daily_merchants, sum(bad) / sum(n) as decline_rate,
               max(attempted_date) as last_attempt_date
        group by customer_id""",
    "o_stg_carriers": "from {ops_carriers}",
    "o_stg_facilities": "from {ops_facilities}",
    "o_stg_inventory_snapshots": """
        from {ops_inventory_snapshots} select *, units_reserved + units_on_hand as units_committed""",
    "o_stg_scan_events": """
        from {ops_scan_events} select *, exception_code is not null as is_exception""",
    "o_stg_shipments": """
        from {ops_shipments}
        select *, epoch(delivered_at - dispatched_at) / 3600 as transit_hours,
               ifnull(delivered_at <= promised_at, false) as on_time""",
    "o_stg_temperature_readings": """
        from {ops_temperature_readings} select *, sensor_status = 'alert' as is_alert""",
    "o_stg_work_orders": """
        from {ops_work_orders}
        select *, epoch(ifnull(closed_at, timestamp '2001-12-31') - opened_at) / 3600 as open_hours""",
    "o_int_carrier_reliability": """
        from {o_stg_shipments}
        select carrier_id, count(*) as shipment_count, count(*) filter (on_time) as on_time_shipments,
               round(cast(count(*) filter (on_time) / count(*) as decimal(20,12)), 4) as on_time_rate,
               avg(transit_hours) as mean_transit_hours group by all""",
    "o_int_exception_events": """
        select event_id, shipment_id, e.facility_id, event_ts, exception_code, route_code, priority
        from {o_stg_scan_events} as e join {o_stg_shipments} using (shipment_id)
        where is_exception""",
    "o_int_facility_conditions": """
        from {o_stg_temperature_readings}
        select facility_id, recorded_at::date as condition_date, avg(celsius) as mean_temperature,
               count(*) filter (is_alert) as temperature_alerts group by all""",
    "o_int_facility_day": """
        from {o_stg_shipments}
        select facility_id, dispatched_at::date as operation_date, count(*) as shipments_dispatched,
               sum(package_count)::bigint as packages_dispatched,
               count(*) filter (priority <> 'standard') as priority_shipments group by all""",
    "o_int_shipment_milestones": """
        select shipment_id, s.facility_id, carrier_id, promised_at, delivered_at, on_time,
               count(event_id) as scan_count, count(*) filter (is_exception) as exception_scan_count,
               max(event_ts) as last_scan_at
        from {o_stg_shipments} as s left join {o_stg_scan_events} as e using (shipment_id)
        group by all""",
    "o_mart_capacity_risk": """
        select d.facility_id, operation_date, facility_code, region, capacity_units,
               packages_dispatched, units_committed,
               round(cast((packages_dispatched + units_committed) / capacity_units
                     as decimal(20,12)), 4) as load_ratio,
               ifnull(temperature_alerts, 0) as temperature_alerts
        from {o_int_facility_day} as d join {o_stg_facilities} as f on f.facility_id = d.facility_id
        left join {o_stg_inventory_snapshots} as i
               on i.facility_id = d.facility_id and snapshot_date = operation_date
        left join {o_int_facility_conditions} as c
               on c.facility_id = d.facility_id and condition_date = operation_date""",
    "o_mart_carrier_network": """
        select * from {o_stg_carriers} join {o_int_carrier_reliability} using (carrier_id)""",
    "o_mart_delivery_sla": """
        select shipment_id, facility_id, carrier_id, carrier_name, service_tier, on_time, scan_count,
               exception_scan_count,
               if(delivered_at is null, 'open', if(on_time, 'on_time', 'late')) as sla_state
        from {o_int_shipment_milestones} join {o_stg_carriers} using (carrier_id)""",
    "o_mart_exception_queue": """
        select event_id, e.facility_id, shipment_id, event_ts, exception_code, route_code,
               work_order_id, severity, w.status as work_order_status
        from {o_int_exception_events} as e
        left join {o_stg_work_orders} as w on w.facility_id = e.facility_id""",
    "o_feature_delivery_risk": """
        from {o_mart_delivery_sla}
        select shipment_id, facility_id, carrier_id, (sla_state = 'late')::double as observed_late,
               exception_scan_count, scan_count,
               exception_scan_count / nullif(scan_count, 0) as exception_scan_ratio""",
    "o_feature_facility_congestion": """
        from {o_mart_capacity_risk}
        select facility_id, operation_date, facility_code, region, load_ratio, temperature_alerts,
               if(temperature_alerts > 0 or load_ratio >= 0.85, 1, 0) as needs_attention""",
}

CONSUMER_SQL = {
    "authorisation_rate": """
        from {mart_revenue_daily} select activity_date, authorisation_rate, payment_attempt_count,
             settled_payment_count where payment_attempt_count <> 0
        order by activity_date desc limit 90""",
    "carrier_on_time": """
        from {mart_logistics_sla} select carrier_name, service_level, promised_days, shipment_count,
             on_time_rate, p95_transit_days""",
    "customer_value": """
        from {mart_customer_360} select lifetime_tier, count(*) as customer_count,
             avg(lifetime_net_usd) as avg_lifetime_usd,
             quantile_cont(lifetime_net_usd, 0.5) as median_lifetime_usd group by all""",
    "dispute_exposure": """
        from {mart_transaction_enriched} select attempted_date,
             sum(disputed_amount_usd) as disputed_usd, count(*) as open_dispute_count
        where has_open_dispute group by all order by attempted_date desc limit 60""",
    "fraud_feature_freshness": """
        from {feature_customer_risk} select count(*) as rows,
             count(*) filter (failed_login_rate > 0) as with_failed_logins,
             avg(min_device_trust) as avg_min_device_trust,
             max(max_customers_sharing_device) as max_shared_device""",
    "funnel_conversion": """
        from {mart_marketing_funnel} select session_date, session_count, reached_product_count,
             reached_cart_count, reached_confirm_count, product_to_cart_rate, cart_to_confirm_rate
        order by session_date desc limit 60""",
    "merchant_revenue": """
        from {mart_merchant_scorecard} select merchant_id, merchant_name, net_amount_usd,
             completed_order_count, on_time_rate
        order by net_amount_usd desc nulls last, merchant_id limit 50""",
    "merchant_risk_review": """
        from {feature_merchant_risk} select merchant_id, merchant_name, risk_band, payment_count,
             dispute_rate, disputed_value_share where payment_count > 20
        order by disputed_value_share desc nulls last, merchant_id limit 40""",
    "mrr_by_plan": """
        from {mart_subscription_health} select plan_code, billing_interval, active_count,
             active_mrr_usd, churn_rate""",
    "order_investigation": """
        from {int_orders_enriched} select order_id, order_date, currency_code, net_amount,
             fx_rate_to_usd, net_amount_usd where currency_code <> 'USD'
        order by order_date desc, order_id limit 100""",
    "reconciliation_gap": """
        from {mart_finance_reconciliation} select processor,
             sum(unreconciled_usd) as unreconciled_usd,
             avg(unreconciled_ratio) as avg_unreconciled_ratio,
             avg(authorisation_rate) as avg_authorisation_rate group by all""",
    "revenue_trend": """
        from {mart_revenue_daily} select activity_date, net_usd, gross_usd, settled_net_usd
        order by activity_date desc limit 90""",
    "support_load_review": """
        from {int_customer_support_load} select customer_id, ticket_count, escalated_ticket_count,
             avg_resolution_hours, avg_csat_score where escalated_ticket_count > 0
        order by escalated_ticket_count desc, customer_id limit 50""",
    "velocity_outliers": """
        from {feature_txn_velocity} select customer_id, total_attempts, max_daily_attempts,
             peak_to_mean_attempts, decline_rate where peak_to_mean_attempts is not null
        order by peak_to_mean_attempts desc, customer_id limit 200""",
    "zero_result_search": """
        from {mart_marketing_funnel} select session_date, search_count, zero_result_count,
             zero_result_count / nullif(search_count, 0) as zero_result_rate
        order by session_date desc limit 60""",
    "capacity_watch": """
        from {o_mart_capacity_risk} select facility_code, region, operation_date, load_ratio,
             temperature_alerts where load_ratio >= 0.55 or temperature_alerts > 0
        order by operation_date desc, load_ratio desc nulls first, facility_code limit 100""",
    "carrier_score": """
        from {o_mart_carrier_network} select carrier_name, service_tier, on_time_rate,
             mean_transit_hours""",
    "delivery_features": """
        from {o_feature_delivery_risk} select carrier_id,
             avg(exception_scan_ratio) as exception_ratio, avg(observed_late) as late_rate
        group by all""",
    "exception_queue": """
        select facility_id, exception_code, severity, work_order_status from (
             from {o_mart_exception_queue} order by event_ts desc, event_id, work_order_id limit 100)""",
    "network_sla": """
        from {o_mart_delivery_sla} select facility_id, carrier_id, sla_state, count(*) as shipments
        group by all""",
}
