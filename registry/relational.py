"""Scans, projections, joins, aggregates, sorts, sets and scalar functions, one query each."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.functions import scalars as fn
from undertow.functions.ordered import numbered
from undertow.functions.summaries import contents, percentile_cont
from undertow.operators import history, quality
from undertow.operators.lineage import Graph
from undertow.plans import MODELS
from undertow.plans.intermediate import with_usd_rate
from undertow.session import checkpoint_root
from undertow.sources import ledgers, scopes, sinks

from .core import query
from .graph import parts, used

c = F.col


# ------------------------------------------------------------------ scans


@query("src_scan", "select * from {lineitem}")
def src_scan(w):
    return w["lineitem"]


@query("src_ledger", """
    select part, line_no, good, status, named from (
        select line_no // 500 as part, row_number() over (partition by line_no // 500 order by line_no) as line_no,
               text like '%}' as good, text,
               case when text like '%}' then regexp_extract(text, '"status":"(\\w+)"', 1) end as status,
               if(text like '%}', null, 'part=' || line_no // 500) as named
        from {led_lines})
    where trim(text) <> ''""".replace("'%}'", "'%' || chr(125)"))
def src_ledger(w):
    """The lines as files of a ledger folder, read back with the file and the line of every bad one."""
    folder = f"{checkpoint_root(w.spark)}/ledger-{uuid.uuid4().hex}"
    lines = w["led_lines"].select(F.floor(c("line_no") / 500).alias("part"), "line_no", "text")
    dealt = lines.repartition("part").sortWithinPartitions("part", "line_no")
    dealt.select("part", "text").write.partitionBy("part").text(folder)
    parsed = ledgers.parse_lines(ledgers.numbered_lines(w.spark, folder), "attempted_at string, status string, line bigint")
    bad = ledgers.complaints(parsed).select("file", "line_no", F.regexp_extract("file", "part=[0-9]+", 0).alias("named"))
    return parsed.join(bad, ["file", "line_no"], "left").select(
        c("part").cast("bigint").alias("part"), "line_no", c("record").isNotNull().alias("good"), "record.status", "named"
    )


@query("src_latest_snapshot", """
    select arg_max(fingerprint, struct_pack(t := timezone('UTC', read_at::timestamptz),
                                            f := fingerprint)) as fingerprint from {led_reads}""")
def src_latest_snapshot(w):
    return sinks.latest_fingerprint(w["led_reads"])


# ------------------------------------------------------------------ projections and filters


@query("prj_compute", """
    select order_item_id, order_id, quantity * unit_price as line_amount from {raw_order_items}""")
def prj_compute(w):
    return w["raw_order_items"].select(
        "order_item_id", "order_id", (c("quantity") * c("unit_price")).alias("line_amount")
    )


@query("fil_soft_delete", """
    select customer_id, deleted_at from {raw_customers} where deleted_at is null""")
def fil_soft_delete(w):
    return w["raw_customers"].where(c("deleted_at").isNull()).select("customer_id", "deleted_at")


@query("fil_predicates", """
    select ticket_id, priority, category, csat_score from {raw_support_tickets}
    where priority in ('high', 'urgent') and category <> 'billing'
      and (csat_score >= 3 or order_id is null)""")
def fil_predicates(w):
    return (
        w["raw_support_tickets"]
        .where(c("priority").isin("high", "urgent") & (c("category") != "billing"))
        .where((c("csat_score") >= 3) | c("order_id").isNull())
        .select("ticket_id", "priority", "category", "csat_score")
    )


@query("fil_bool", "select chargeback_id, amount from {stg_chargebacks} where is_open")
def fil_bool(w):
    return w["stg_chargebacks"].where("is_open").select("chargeback_id", "amount")


@query("fil_is_false", """
    select shipment_id, days_late from {int_shipment_performance} where met_promise is false""")
def fil_is_false(w):
    late = w["int_shipment_performance"].where(fn.is_false(c("met_promise")))
    return late.select("shipment_id", "days_late")


@query("fil_scope", """
    select urn, false as with_instance from {cat_keys}
    where case when urn like '%:li:dataset:(%'
               then split_part(urn, ',', 2) like 'warehouse.core.%' and length(asset) % 3 <> 0
               else urn like 'urn:li:chart:%' end
    union all
    select urn, true from {cat_keys}
    where case when urn like '%:li:dataset:(%' then split_part(urn, ',', 2) like 'warehouse.core.%'
               else urn like 'urn:li:chart:%' end""")
def fil_scope(w):
    """Every third dataset names the instance ``warehouse``: refused unless that is declared."""
    instance = F.regexp_replace(
        "urn", r"urn:li:dataPlatform:(\w+)", r"urn:li:dataPlatformInstance:(urn:li:dataPlatform:$1,warehouse)"
    )
    named = F.when((F.length("asset") % 3 == 0) & c("urn").contains(":dataset:"), instance).otherwise(c("urn"))
    keys = w["cat_keys"].withColumn("named", named)
    plain = scopes.accepts(c("named"), "warehouse.core.", None, ("urn:li:chart:",))
    inside = scopes.accepts(c("named"), "warehouse.core.", "warehouse", ("urn:li:chart:",))
    return keys.where(plain).select("urn", F.lit(False).alias("with_instance")).unionByName(
        keys.where(inside).select("urn", F.lit(True).alias("with_instance"))
    )


# ------------------------------------------------------------------ joins


@query("jn_inner", """
    select order_id, merchant_name from {raw_orders} join {raw_merchants} using (merchant_id)""")
def jn_inner(w):
    return w["raw_orders"].join(w["raw_merchants"], "merchant_id").select("order_id", "merchant_name")


@query("jn_left", """
    select customer_id, order_id from {stg_customers} left join {raw_orders} using (customer_id)""")
def jn_left(w):
    return w["stg_customers"].join(w["raw_orders"], "customer_id", "left").select("customer_id", "order_id")


@query("jn_left_chain", """
    select s.session_id, (select count(*) from {ev_page_views} as p where p.session_id = s.session_id)
               as pages,
           (select count(*) from {ev_product_views} as p where p.session_id = s.session_id)
               as products,
           (select count(*) from {ev_add_to_cart} as p where p.session_id = s.session_id) as carts
    from {ev_app_sessions} as s""")
def jn_left_chain(w):
    joined = w["ev_app_sessions"].select("session_id")
    for role, name in (("ev_page_views", "pages"), ("ev_product_views", "products"), ("ev_add_to_cart", "carts")):
        side = w[role].groupBy("session_id").agg(F.count("*").alias(name))
        joined = joined.join(side, "session_id", "left")
    return joined.fillna(0)


@query("jn_as_of_date_rate", """
    select order_id, (select rate from {stg_fx_rates} where base_currency = 'USD'
                      and rate_date = order_date and quote_currency = currency_code) as rate
    from {stg_orders}""")
def jn_as_of_date_rate(w):
    priced = with_usd_rate(w["stg_orders"], w["stg_fx_rates"], c("order_date"), "rate")
    return priced.select("order_id", "rate")


@query("jn_full", """
    select coalesce(o.day, p.day) as day, orders, payments
    from (select order_ts::date as day, count(*) as orders from {raw_orders} group by all) as o
    full join (select attempted_ts::date as day, count(*) as payments from {raw_payments}
               group by all) as p on o.day = p.day""")
def jn_full(w):
    a = w["raw_orders"].groupBy(F.to_date("order_ts").alias("day")).agg(F.count("*").alias("orders"))
    b = w["raw_payments"].groupBy(F.to_date("attempted_ts").alias("day")).agg(
        F.count("*").alias("payments")
    )
    return a.join(b, "day", "full")


@query("jn_using", """
    select event_id, shipment_id, route_code from {ops_scan_events}
    join {ops_shipments} using (shipment_id)""")
def jn_using(w):
    routes = w["ops_shipments"].select("shipment_id", "route_code")
    return w["ops_scan_events"].select("event_id", "shipment_id").join(routes, "shipment_id")


@query("jn_preagg", """
    select payment_id, ifnull(sum(r.amount), 0) as amount, count(r.refund_id) as refunds
    from {raw_payments} as p left join {raw_refunds} as r using (payment_id) group by all""")
def jn_preagg(w):
    back = w["raw_refunds"].groupBy("payment_id").agg(
        F.sum("amount").alias("amount"), F.count("*").alias("refunds")
    )
    return w["raw_payments"].select("payment_id").join(back, "payment_id", "left").select(
        "payment_id",
        fn.or_zero(c("amount")).alias("amount"),
        fn.or_zero(c("refunds")).alias("refunds"),
    )


@query("jn_derived_key", """
    select shipment_id, units_committed
    from {ops_shipments} as s left join {o_stg_inventory_snapshots} as i
         on i.facility_id = s.facility_id and i.snapshot_date = date_trunc('day', dispatched_at)""")
def jn_derived_key(w):
    stock = w["o_stg_inventory_snapshots"].select(
        "facility_id", c("snapshot_date").alias("day"), "units_committed"
    )
    days = w["ops_shipments"].withColumn("day", F.to_date(F.date_trunc("day", "dispatched_at")))
    return days.join(stock, ["facility_id", "day"], "left").select("shipment_id", "units_committed")


_MISSED = """
    (select a.*, timezone('UTC', try_cast(attempted_at as timestamptz)) as attempted_ts
     from {led_attempts} as a
     left join (select target, max(timezone('UTC', read_at::timestamptz)) as own from {led_reads}
                group by all) as g on g.target = a.target
     where status <> 'succeeded' and timezone('UTC', try_cast(attempted_at as timestamptz))
           > coalesce(own, (select max(timezone('UTC', read_at::timestamptz)) from {led_reads})))"""


@query("jn_cutoff", f"select line_no, attempted_ts from {_MISSED}")
def jn_cutoff(w):
    return history.missed(w["led_attempts"], w["led_reads"]).select("line_no", "attempted_ts")


@query("jn_scalar", """
    select order_id, gross_amount / (select sum(gross_amount) from {raw_orders}) * 1000000 as share
    from {raw_orders}""")
def jn_scalar(w):
    total = w["raw_orders"].agg(F.sum("gross_amount").cast("double")).scalar()
    part = c("gross_amount").cast("double") / total * 1_000_000
    return w["raw_orders"].select("order_id", part.alias("share"))


# ------------------------------------------------------------------ aggregates


@query("ag_basic", """
    select customer_id, count(*) as n, sum(gross_amount) as amount, min(order_ts) as first_order_ts,
           max(order_ts) as last_order_ts, avg(net_amount) as share from {stg_orders} group by all""")
def ag_basic(w):
    return w["stg_orders"].groupBy("customer_id").agg(
        F.count("*").alias("n"),
        F.sum("gross_amount").alias("amount"),
        F.min("order_ts").alias("first_order_ts"),
        F.max("order_ts").alias("last_order_ts"),
        F.avg("net_amount").alias("share"),
    )


@query("ag_filter", """
    select merchant_id, count(*) filter (status = 'returned') as returned,
           sum(gross_amount) filter (status = 'returned') as amount,
           avg(gross_amount) filter (status = 'pending') as share from {raw_orders} group by all""")
def ag_filter(w):
    returned = c("status") == "returned"
    return w["raw_orders"].groupBy("merchant_id").agg(
        F.count_if(returned).alias("returned"),
        fn.sum_where(c("gross_amount"), returned).alias("amount"),
        fn.avg_where(c("gross_amount"), c("status") == "pending").alias("share"),
    )


@query("ag_distinct", """
    select order_ts::date as day, count(distinct customer_id) as customers,
           count(distinct merchant_id) as merchants from {raw_orders} group by all""")
def ag_distinct(w):
    return w["raw_orders"].groupBy(F.to_date("order_ts").alias("day")).agg(
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("merchant_id").alias("merchants"),
    )


@query("ag_count_nulls", """
    select category, count(*) as all_rows, count(order_id) as with_order, count(csat_score) as scored
    from {raw_support_tickets} group by all""")
def ag_count_nulls(w):
    return w["raw_support_tickets"].groupBy("category").agg(
        F.count("*").alias("all_rows"),
        F.count("order_id").alias("with_order"),
        F.count("csat_score").alias("scored"),
    )


@query("ag_bool_or", """
    select payment_id, bool_or(is_open) as any_open, bool_or(is_fraud_dispute) as any_fraud
    from {stg_chargebacks} group by all""")
def ag_bool_or(w):
    return w["stg_chargebacks"].groupBy("payment_id").agg(
        F.bool_or("is_open").alias("any_open"), F.bool_or("is_fraud_dispute").alias("any_fraud")
    )


@query("ag_percentile", """
    select carrier_id, quantile_cont(transit_days, 0.95) as p95_transit_days
    from {stg_shipments} where transit_days is not null group by all""")
def ag_percentile(w):
    return percentile_cont(w["stg_shipments"], ["carrier_id"], "transit_days", 0.95, "p95_transit_days")


@query("ag_stddev", """
    select processor, stddev_pop(amount) as share from {raw_payments} group by all""")
def ag_stddev(w):
    return w["raw_payments"].groupBy("processor").agg(
        F.stddev_pop(c("amount").cast("double")).alias("share")
    )


@query("ag_two_level", """
    select customer_id, max(n) as busiest, avg(n) as share
    from (select customer_id, order_ts::date as d, count(*) as n from {raw_orders} group by all)
    group by all""")
def ag_two_level(w):
    days = w["raw_orders"].groupBy("customer_id", F.to_date("order_ts").alias("d")).agg(
        F.count("*").alias("n")
    )
    return days.groupBy("customer_id").agg(F.max("n").alias("busiest"), F.avg("n").alias("share"))


@query("ag_global", "select count(*) as n, sum(gross_amount) as amount from {raw_orders}")
def ag_global(w):
    return w["raw_orders"].agg(F.count("*").alias("n"), F.sum("gross_amount").alias("amount"))


@query("ag_wide_key", """
    select merchant_id, merchant_name, country_code, risk_band, count(*) as n
    from {stg_merchants} join {stg_orders} using (merchant_id) group by all""")
def ag_wide_key(w):
    counts = w["stg_orders"].groupBy("merchant_id").agg(F.count("*").alias("n"))
    who = w["stg_merchants"].select("merchant_id", "merchant_name", "country_code", "risk_band")
    return who.join(counts, "merchant_id")


@query("ag_safe_ratio", """
    select promotion_id, discount_value / nullif(budget_amount, 0) as share from {raw_promotions}""")
def ag_safe_ratio(w):
    share = fn.ratio(c("discount_value"), c("budget_amount"))
    return w["raw_promotions"].select("promotion_id", share.alias("share"))


@query("ag_expr", """
    select plan_code, sum(mrr_amount::double / rate::double) as mrr_usd
    from {stg_subscriptions} left join {stg_fx_rates} on base_currency = 'USD'
         and quote_currency = currency_code and rate_date = started_ts::date group by all""")
def ag_expr(w):
    priced = with_usd_rate(w["stg_subscriptions"], w["stg_fx_rates"], F.to_date("started_ts"), "rate")
    return priced.groupBy("plan_code").agg(F.sum(c("mrr_amount") / c("rate")).alias("mrr_usd"))


@query("ag_select_distinct", "select distinct rate_date, base_currency from {raw_fx_rates}")
def ag_select_distinct(w):
    return w["raw_fx_rates"].select("rate_date", "base_currency").distinct()


@query("ag_ratio_forms", """
    select processor, sum(settled_count) / sum(attempt_count) as share,
           avg(settled_count / attempt_count) as authorisation_rate
    from {mart_finance_reconciliation} group by all""")
def ag_ratio_forms(w):
    return w["mart_finance_reconciliation"].groupBy("processor").agg(
        fn.ratio(F.sum("settled_count"), F.sum("attempt_count")).alias("share"),
        F.avg("authorisation_rate").alias("authorisation_rate"),
    )


@query("ag_argmax", """
    select target, arg_max(line_no, struct_pack(
               t := coalesce(timezone('UTC', try_cast(attempted_at as timestamptz)),
                             timestamp '0001-01-01'), n := line_no)) as line_no
    from {led_attempts} group by all""")
def ag_argmax(w):
    newest = history.latest(w["led_attempts"], ["target"], "attempted_at", "line_no")
    return newest.select("target", "line_no")


# Copies of the orders: the same rows, one value changed, a row gone, a row twice, a null moved
# from one column to another.
_COPIES = {
    "same": "select * from {raw_orders}",
    "one value": "select * replace (if(order_id = (select min(order_id) from {raw_orders}), 'x', channel) as channel) from {raw_orders}",
    "row gone": "select * from {raw_orders} where order_id <> (select max(order_id) from {raw_orders})",
    "row twice": "select * from {raw_orders} union all select * from {raw_orders} where order_id = (select max(order_id) from {raw_orders})",
    "null in channel": "select * replace (null::varchar as channel) from {raw_orders}",
    "null in status": "select * replace (null::varchar as status) from {raw_orders}",
}
_EXCEPT = "((select * from ({a})) except all (select * from ({b})))"


@query("ag_checksum", " union all ".join(
    f"""select '{name}' as copy, (select count(*) from ({copy})) as row_count,
        exists (select * from {_EXCEPT.format(a=copy, b=base)} union all select * from {_EXCEPT.format(a=base, b=copy)}) as differs"""
    for name, copy in _COPIES.items()
    for base in [_COPIES["null in channel" if name == "null in status" else "same"]]))
def ag_checksum(w):
    orders = w["raw_orders"]
    least, most = orders.agg(F.min("order_id")).scalar(), orders.agg(F.max("order_id")).scalar()
    none = F.lit(None).cast("string")
    copies = {
        "same": orders.repartition("merchant_id"),
        "one value": orders.withColumn("channel", F.when(c("order_id") == least, "x").otherwise(c("channel"))),
        "row gone": orders.where(c("order_id") != most),
        "row twice": orders.union(orders.where(c("order_id") == most)),
        "null in channel": orders.withColumn("channel", none),
        "null in status": orders.withColumn("status", none),
    }
    found = [contents(df).select(F.lit(name).alias("copy"), "row_count", "checksum") for name, df in copies.items()]
    base = {n: contents(df).agg(F.max("checksum")).scalar() for n, df in (("same", orders), ("null in channel", copies["null in channel"]))}
    against = F.when(c("copy") == "null in status", base["null in channel"]).otherwise(base["same"])
    return reduce(DataFrame.unionByName, found).select("copy", "row_count", (c("checksum") != against).alias("differs"))


@query("ag_even_split", """
    select order_id, user_name, total // 3 + (pos < total % 3)::int as part
    from (select order_id, 7 + order_id % 11 as total,
                 unnest(['ann', 'bo', 'cy']) as user_name, unnest([0, 1, 2]) as pos
          from {raw_orders})""")
def ag_even_split(w):
    users = F.array(F.lit("ann"), F.lit("bo"), F.lit("cy"))
    total = 7 + c("order_id") % 11
    rows = w["raw_orders"].select("order_id", total.alias("total"), F.posexplode(users).alias("pos", "user_name"))
    part = F.floor(c("total") / 3) + (c("pos") < c("total") % 3).cast("bigint")
    return rows.select("order_id", "user_name", part.alias("part"))


# ------------------------------------------------------------------ windows, sorts, sets


@query("wn_change", """
    select line_no, case when lag(fingerprint) over t is null then 'first'
           when lag(fingerprint) over t = fingerprint then 'same' else 'changed' end as change
    from {led_reads}
    window t as (partition by target order by timezone('UTC', read_at::timestamptz), line_no)""")
def wn_change(w):
    return history.changes(w["led_reads"]).select("line_no", "change")


@query("so_multi", """
    select facility_id, operation_date, packages_dispatched from {o_int_facility_day}""")
def so_multi(w):
    days = w["o_int_facility_day"].select("facility_id", "operation_date", "packages_dispatched")
    return days.orderBy(F.desc("operation_date"), F.desc("packages_dispatched"), "facility_id")


@query("so_nulls", """
    select shipment_id, transit_days,
           row_number() over (order by transit_days nulls first, shipment_id) as nulls_first,
           row_number() over (order by transit_days desc nulls last, shipment_id) as nulls_last
    from {stg_shipments}""")
def so_nulls(w):
    rows = w["stg_shipments"].select("shipment_id", "transit_days")
    rows = numbered(rows, [], [F.asc_nulls_first("transit_days"), c("shipment_id")], "nulls_first")
    return numbered(rows, [], [F.desc_nulls_last("transit_days"), c("shipment_id")], "nulls_last")


@query("so_topk", """
    select order_id, gross_amount from {raw_orders} order by gross_amount desc, order_id limit 200""")
def so_topk(w):
    return w["raw_orders"].select("order_id", "gross_amount").orderBy(
        F.desc("gross_amount"), "order_id"
    ).limit(200)


@query("se_dedup", """
    select asset, case substr(asset, 1, 1) when 'b' then 'b,a' else 'b,a,' || substr(asset, 1, 1) end
           as once from {lin_assets}""")
def se_dedup(w):
    listed = F.split(F.concat(F.lit("b,a,"), F.substring("asset", 1, 1), F.lit(",a")), ",")
    return w["lin_assets"].select("asset", F.array_join(F.array_distinct(listed), ",").alias("once"))


# ------------------------------------------------------------------ scalar functions


@query("fn_case", "select customer_id, lower(email) as email, upper(country_code) as code from {raw_customers}")
def fn_case(w):
    return w["raw_customers"].select(
        "customer_id", F.lower("email").alias("email"), F.upper("country_code").alias("code")
    )


@query("fn_default_blank", """
    select event_id, if(ifnull(utm_source, '') = '', 'direct', utm_source) as utm_source
    from {ev_page_views}""")
def fn_default_blank(w):
    return w["ev_page_views"].select("event_id", fn.blank_to(c("utm_source"), "direct").alias("utm_source"))


@query("fn_greatest", """
    select shipment_id, greatest(transit_days - 4, 0) as days_late from {stg_shipments}""")
def fn_greatest(w):
    late = F.greatest(c("transit_days") - 4, F.lit(0.0))
    return w["stg_shipments"].select("shipment_id", late.alias("days_late"))


@query("fn_epoch_ms", """
    select event_id, make_timestamp(event_ts_ms * 1000) as event_ts from {ev_auth_events}""")
def fn_epoch_ms(w):
    return w["ev_auth_events"].select("event_id", F.timestamp_millis("event_ts_ms").alias("event_ts"))


@query("fn_elapsed", """
    select work_order_id, epoch(closed_at - opened_at) / 3600 as elapsed_hours
    from {ops_work_orders}""")
def fn_elapsed(w):
    hours = fn.elapsed(c("closed_at"), c("opened_at"), 3600)
    return w["ops_work_orders"].select("work_order_id", hours.alias("elapsed_hours"))


@query("fn_age_days", """
    select customer_id, date_diff('second', signup_ts, timestamp '2001-12-31') / 86400
           as account_age_days from {raw_customers}""")
def fn_age_days(w):
    from undertow.plans.intermediate import days_before_end

    return w["raw_customers"].select(
        "customer_id", days_before_end(c("signup_ts")).alias("account_age_days")
    )


@query("fn_day", """
    select order_id, order_ts::date as day, date_trunc('month', order_ts)::date as month
    from {raw_orders}""")
def fn_day(w):
    return w["raw_orders"].select(
        "order_id",
        F.to_date("order_ts").alias("day"),
        F.to_date(F.date_trunc("month", "order_ts")).alias("month"),
    )


@query("fn_round", """
    select order_item_id, round(unit_price, 1) as share, round(-unit_price, 0) as unit_price
    from {raw_order_items}""")
def fn_round(w):
    return w["raw_order_items"].select(
        "order_item_id",
        F.round("unit_price", 1).alias("share"),
        F.round(-c("unit_price"), 0).alias("unit_price"),
    )


@query("fn_decimal_div", """
    select order_id, gross_amount::double / 148.5 as share from {raw_orders}""")
def fn_decimal_div(w):
    share = c("gross_amount") / F.lit(148.5).cast("decimal(18,8)")
    return w["raw_orders"].select("order_id", share.alias("share"))


@query("fn_bool3", """
    select asset, replicated and tier = 'tier1' as both_true, replicated or tier = 'tier1' as any_true,
           not replicated as negated from {lin_assets}""")
def fn_bool3(w):
    top = c("tier") == "tier1"
    return w["lin_assets"].select(
        "asset",
        (c("replicated") & top).alias("both_true"),
        (c("replicated") | top).alias("any_true"),
        (~c("replicated")).alias("negated"),
    )


@query("fn_try_parse", """
    select urn, try_cast(body->>'$.properties.customProperties[1].value' as int) as sla_hours,
           lower(trim(body->>'$.properties.customProperties[2].value')) = 'true' as replicated
    from {cat_records}""")
def fn_try_parse(w):
    def at(i):
        return F.get_json_object("body", f"$.properties.customProperties[{i}].value")

    return w["cat_records"].select(
        "urn",
        fn.tolerant_int(at(1)).alias("sla_hours"),
        fn.tolerant_bool(at(2)).alias("replicated"),
    )


@query("fn_json", """
    select urn, ifnull(body->>'$.properties.name', 'unnamed') as name from {cat_records}""")
def fn_json(w):
    name = F.coalesce(F.get_json_object("body", "$.properties.name"), F.lit("unnamed"))
    return w["cat_records"].select("urn", name.alias("name"))


@query("fn_iso_instant", """
    select line_no, timezone('UTC', try_cast(attempted_at as timestamptz)) as at from {led_attempts}""")
def fn_iso_instant(w):
    return w["led_attempts"].select("line_no", fn.instant(c("attempted_at")).alias("at"))


@query("fn_stable_id", """
    select order_id, substr(sha256(order_id || chr(31) || merchant_id || chr(31) || channel), 1, 16)
           as stable_id from {raw_orders}""")
def fn_stable_id(w):
    return w["raw_orders"].select(
        "order_id", fn.stable_id(c("order_id"), c("merchant_id"), c("channel")).alias("stable_id")
    )


@query("fn_regex_metric", """
    select target, arg_max(mean_score / 1000000, line_no) as precision,
           arg_max(mean_score / 2000000, line_no) as recall, true as found
    from {led_scores} group by all""")
def fn_regex_metric(w):
    lines = w["led_scores"].select(
        "target",
        "line_no",
        F.concat(
            F.lit("  cascade  precision "),
            (c("mean_score").cast("double") / 1_000_000).cast("string"),
            F.lit("  recall "),
            (c("mean_score").cast("double") / 2_000_000).cast("string"),
        ).alias("text"),
    )
    return history.captured_metrics(lines, ["target"])


# ------------------------------------------------------------------ data tests


_TESTED = [name for name, m in MODELS.items() if m.checks]


def _checks(kind, count):
    rows = []
    for name in _TESTED:
        for k in MODELS[name].checks:
            if k.kind == kind:
                test = count.format(c=k.column, t=name, v=", ".join(f"'{v}'" for v in k.values))
                rows.append(
                    f"select '{name}' as model, '{k.column}' as column_name, ({test}) as failures"
                )
    return " union all ".join(rows)


_COUNT = {
    "unique": "select count(*) from (select {c} from {{{t}}} where {c} is not null group by {c} "
    "having count(*) > 1)",
    "not_null": "select count(*) - count({c}) from {{{t}}}",
    "accepted": "select count(*) from {{{t}}} where {c} not in ({v})",
}


def _report(w, kind):
    """Every check of one kind, on the models that have one."""
    tested = [n for n in _TESTED if any(k.kind == kind for k in MODELS[n].checks)]
    return quality.report({n: w[n] for n in tested}, [MODELS[n] for n in tested], kind)


for _kind, _count in _COUNT.items():
    query(f"dq_{_kind}", _checks(_kind, _count))(
        lambda w, k=_kind: _report(w, k)
    )


# name, one-row query of one number, least, most.
_EXPECTED = (
    ("datasets (postgres)", "select count(*) as n from {cat_keys} where urn like '%dataPlatform:postgres%'", 100, None),
    ("datasets (dbt siblings)", "select count(*) as n from {cat_keys} where urn like '%dataPlatform:dbt%'", 100, None),
    ("dashboards", "select count(*) as n from {lin_assets} where kind = 'dashboard'", 5, None),
    ("charts", "select count(*) as n from {lin_assets} where kind = 'chart'", 5, None),
    ("features", "select count(*) as n from {lin_assets} where kind = 'mlFeature'", 0, 0),
    ("table edges", "select count(*) as n from {lin_edges}", 100, None),
    ("datasets with column lineage", "select count(distinct target) as n from {lin_column_edges}", 60, None),
    ("datasets with usage", "select count(distinct asset) as n from {lin_usage} where runs > 0", 60, None),
    ("recorded executions", "select coalesce(sum(runs), 0) as n from {lin_usage}", 1, None),
    ("distinct owners", "select count(distinct owner) as n from {lin_owners}", 10, None),
    ("top owner share", """
        select max(n) / (select count(*) from {lin_assets} where kind = 'dataset') as n
        from (select count(distinct asset) as n from {lin_owners} group by owner) as owned""", 0.001, 0.5),
    ("unowned datasets", """
        select count(*) as n from {lin_assets}
        where kind = 'dataset' and asset not in (select asset from {lin_owners})""", 1, None),
    ("feature to deployment", """
        select count(*) as n from {lin_column_edges} as f join {lin_column_edges} as m
        on f.target = m.source and f.target_column = m.source_column""", 1, None),
)


@query("dq_expectations", " union all ".join(
    f"select '{name}' as expectation, n::double as share, coalesce(n >= {least}" + (f" and n <= {most}" if most is not None else "")
    + f", false) as passed from ({sql})" for name, sql, least, most in _EXPECTED))
def dq_expectations(w):
    owners, datasets = w["lin_owners"], w["lin_assets"].where("kind = 'dataset'")
    keys, columns, usage = w["cat_keys"], w["lin_column_edges"], w["lin_usage"]
    kinds = w["lin_assets"].groupBy("kind").agg(F.count("*").alias("n"))
    total = datasets.agg(F.count("*")).scalar()
    joined = columns.select(c("target").alias("a"), c("target_column").alias("b")).join(
        columns.select(c("source").alias("a"), c("source_column").alias("b")), ["a", "b"]
    )
    counted = {
        "datasets (postgres)": keys.agg(F.count_if(c("urn").contains("dataPlatform:postgres"))),
        "datasets (dbt siblings)": keys.agg(F.count_if(c("urn").contains("dataPlatform:dbt"))),
        "dashboards": kinds.agg(F.coalesce(F.sum(F.when(c("kind") == "dashboard", c("n"))), F.lit(0))),
        "charts": kinds.agg(F.coalesce(F.sum(F.when(c("kind") == "chart", c("n"))), F.lit(0))),
        "features": kinds.agg(F.coalesce(F.sum(F.when(c("kind") == "mlFeature", c("n"))), F.lit(0))),
        "table edges": w["lin_edges"].agg(F.count("*")),
        "datasets with column lineage": columns.agg(F.count_distinct("target")),
        "datasets with usage": usage.where("runs > 0").agg(F.count_distinct("asset")),
        "recorded executions": usage.agg(F.coalesce(F.sum("runs"), F.lit(0))),
        "distinct owners": owners.agg(F.count_distinct("owner")),
        "top owner share": owners.distinct().groupBy("owner").count().agg(F.max("count") / total),
        "unowned datasets": datasets.join(owners, "asset", "left_anti").agg(F.count("*")),
        "feature to deployment": joined.agg(F.count("*")),
    }
    return quality.expectations(
        [quality.expectation(name, counted[name], least, most) for name, _, least, most in _EXPECTED]
    )


@query("dq_ownership", """
    select ifnull(owner, '(no owner)') as owner, count(*) as datasets,
           count(*) / (select count(*) from {lin_assets} where kind = 'dataset') as share
    from {lin_assets} left join {x_owners} using (asset) where kind = 'dataset' group by all""")
def dq_ownership(w):
    return quality.ownership(Graph.of(w))


@query("dq_coverage", """
    with d as (
        select a.asset, tier, a.asset in (select asset from {x_usage}) as busy,
               a.asset in (select asset from {x_owners}) as owned,
               replicated is not null or a.asset in (
                   select c.asset from {x_closure} as c join {x_risk} as r on r.asset = c.origin)
                   as known
        from {lin_assets} as a where kind = 'dataset')
    select 'replication' as metadata, avg(known::int) as share from d
    union all select 'usage', avg(busy::int) from d
    union all select 'ownership', avg(owned::int) from d
    union all select 'tiers', avg((tier is not null)::int) from d""")
def dq_coverage(w):
    from undertow.operators import knockout

    g = Graph.of(w)
    return quality.coverage(g, used(w), knockout.recovery(g))


@query("dq_append_once", """
    select target, count(*) as rows_added, count(*) = 1 as once from {led_runs}
    where run_id = 'run 7' group by all""")
def dq_append_once(w):
    return quality.appended_once(w["led_runs"], "run 7")


# ------------------------------------------------------------------ history


@query("hi_latest", """
    select target, max_by(fingerprint, struct_pack(t := timezone('UTC', read_at::timestamptz),
           n := line_no)) as fingerprint from {led_reads} group by all""")
def hi_latest(w):
    return history.latest(w["led_reads"], ["target"], "read_at", "line_no").select("target", "fingerprint")


@query("hi_missed", f"""
    select ifnull(target, '(none)') as target, count(*) as missed_runs,
           max(attempted_ts) as newest_miss from {_MISSED} group by all""")
def hi_missed(w):
    return history.missed_per_target(history.missed(w["led_attempts"], w["led_reads"]))


@query("hi_evidence", """
    with r as (select *, timezone('UTC', read_at::timestamptz) as t from {led_reads}),
         p as (
        select r.line_no, r.target, verification_artifact as va,
               (select path from {led_captures} as k where k.target = r.target
                and k.path = r.verification_artifact) as named,
               (select arg_max(path, struct_pack(g := generated_at, p := path))
                from {led_captures} as k where k.target = r.target and generated_at <= t
                and generated_at::date = t::date) as same_day,
               (select arg_max(path, struct_pack(g := generated_at, p := path))
                from {led_captures} as k where k.target = r.target
                and generated_at::date < t::date) as earlier,
               if(length(r.target) % 2 = 0, 'example of ' || r.target, null) as standing
        from r)
    select line_no, target,
           if(va is not null, named, coalesce(same_day, earlier, standing)) as evidence,
           case when va is not null then if(named is null, 'named capture is missing', 'named')
                when same_day is not null then 'same day' when earlier is not null then 'earlier'
                when standing is not null then 'standing example'
                else 'none' end as how
    from p""")
def hi_evidence(w):
    captures = w["led_captures"].withColumn("generated_at", c("generated_at").cast("timestamp"))
    targets = w["led_reads"].select("target").distinct().where(F.length("target") % 2 == 0)
    standing = targets.withColumn("example", F.concat(F.lit("example of "), "target"))
    return history.evidence(w["led_reads"], captures, standing)


@query("hi_freshness", """
    with a as (select *, timezone('UTC', try_cast(attempted_at as timestamptz)) as t
               from {led_attempts}),
         n as (select arg_max(a, struct_pack(t := t, n := line_no)) as r from a where t is not null)
    select case when age > 25 then 'stale' when r.status <> 'succeeded' then 'last run failed'
                else 'alive' end as verdict, age as age_hours, r.status, r.stage, r.target
    from (select r, epoch(timestamp '2001-08-02 06:00:00' - r.t) / 3600 as age from n)""")
def hi_freshness(w):
    return history.freshness(w["led_attempts"], F.lit("2001-08-02 06:00:00").cast("timestamp"))


@query("hi_attempt_valid", """
    select line_no, reasons from (
        select line_no, concat_ws(',', if(status in ('succeeded', 'failed'), null, 'status'),
               if(trim(stage) = '', 'stage', null),
               if(try_cast(attempted_at as timestamptz) is null, 'attempted_at', null)) as reasons
        from {led_attempts}) where reasons <> ''""")
def hi_attempt_valid(w):
    return history.invalid_attempts(w["led_attempts"]).select("line_no", "reasons")


@query("hi_trend", """
    select target, line_no, scored_at, mean_score,
           ifnull(if(json_type(top, '$[0]') = 'OBJECT', top->>'$[0].origin', top->>'$[0]'), '—') as most_fragile,
           if(json_type(top, '$[0]') = 'OBJECT', (top->>'$[0].score')::double, null) as score
    from {led_scores}""")
def hi_trend(w):
    return history.trend(w["led_scores"])


@query("hi_targets", "select target, count(*) as runs from {led_reads} group by all")
def hi_targets(w):
    return history.targets(w["led_reads"])
