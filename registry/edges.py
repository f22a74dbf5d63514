"""Queries on inputs made awkward: missing values, equal bounds, blanks, ties, mixed types."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.functions.ordered import numbered

from .core import query
from .whatif import faulted_tables


def edited(w, table, **columns):
    """The warehouse with some columns of one table replaced."""
    return w.overlay({table: w[table].withColumns({k: F.expr(v) for k, v in columns.items()})})


# dwell_ms: missing, exactly at the limit, and as it is.
_DWELL = "case product_id % 3 when 0 then cast(null as int) when 1 then 30000 else dwell_ms end"
faulted_tables("ed", "ev_product_views", f"select * replace ({_DWELL} as dwell_ms) from {{ev_product_views}}", ["stg_product_views"])


@query("prj_flags", f"select event_id, {_DWELL} >= 30000 as is_engaged_view from {{ev_product_views}}")
def prj_flags(w):
    views = edited(w, "ev_product_views", dwell_ms=_DWELL)["stg_product_views"]
    return views.select("event_id", "is_engaged_view")


# A blank code is a code; a missing one is none.
_CODE = "case when facility_id % 2 = 0 then '' when shipment_id % 2 = 0 then exception_code end"


@query("prj_null_flags", f"select event_id, {_CODE} is not null as is_exception from {{ops_scan_events}}")
def prj_null_flags(w):
    events = edited(w, "ops_scan_events", exception_code=_CODE)["o_stg_scan_events"]
    return events.select("event_id", "is_exception")


@query("jn_many_many", """
    select order_item_id, payment_id
    from {raw_order_items} as i left join {raw_payments} as p on p.order_id = i.order_id""")
def jn_many_many(w):
    paid = w["raw_payments"].select("order_id", "payment_id")
    return w["raw_order_items"].join(paid, "order_id", "left").select("order_item_id", "payment_id")


@query("se_union_all", """
    select order_id, quantity as amount from {raw_order_items}
    union all select order_id, gross_amount from {raw_orders}
    union all select order_id, null from {raw_orders}""")
def se_union_all(w):
    counted = w["raw_order_items"].select("order_id", F.col("quantity").alias("amount"))
    priced = w["raw_orders"].select("order_id", F.col("gross_amount").alias("amount"))
    nothing = w["raw_orders"].select("order_id", F.lit(None).alias("amount"))
    return counted.unionByName(priced).unionByName(nothing)


_CHANNEL = "case when order_id % 4 <> 0 then channel end"


@query("fn_case_when", f"""
    select order_id, if(channel = 'web', 1, 0) as is_web,
           case when channel is null then 'none' when gross_amount > 1000 then 'large'
                when channel = 'web' then 'web' end as word
    from (select order_id, gross_amount, {_CHANNEL} as channel from {{raw_orders}})""")
def fn_case_when(w):
    orders = w["raw_orders"].withColumn("channel", F.expr(_CHANNEL))
    word = (
        F.when(F.col("channel").isNull(), "none")
        .when(F.col("gross_amount") > 1000, "large")
        .when(F.col("channel") == "web", "web")
    )
    return orders.select("order_id", F.when(F.col("channel") == "web", 1).otherwise(0).alias("is_web"), word.alias("word"))


# Sessions without an end, without length, and as they are.
_ENDED = "case customer_id % 3 when 0 then cast(null as bigint) when 1 then started_ts_ms else ended_ts_ms end"


@query("fn_duration", f"""
    select session_id, ({_ENDED} - started_ts_ms) / 1000 as duration_seconds from {{ev_app_sessions}}""")
def fn_duration(w):
    sessions = edited(w, "ev_app_sessions", ended_ts_ms=_ENDED)["stg_app_sessions"]
    return sessions.select("session_id", "duration_seconds")


# Orders still open, closed as they open, and as they are.
_CLOSED = "case facility_id % 3 when 0 then cast(null as timestamp) when 1 then opened_at else closed_at end"
faulted_tables("ed", "ops_work_orders", f"select * replace ({_CLOSED} as closed_at) from {{ops_work_orders}}", ["o_stg_work_orders"])


@query("fn_open_hours", "select work_order_id, open_hours from {ed_o_stg_work_orders}")
def fn_open_hours(w):
    orders = edited(w, "ops_work_orders", closed_at=_CLOSED)["o_stg_work_orders"]
    return orders.select("work_order_id", "open_hours")


@query("wn_rank", """
    select asset, n, row_number() over (order by n desc, asset) as rank
    from (select asset, count(distinct user_name) as n from {lin_usage} where runs > 0 group by asset)""")
def wn_rank(w):
    """A total rank without gaps over counts that tie."""
    used = w["lin_usage"].where("runs > 0").groupBy("asset").agg(F.count_distinct("user_name").alias("n"))
    return numbered(used, [], [F.desc("n"), F.col("asset")], "rank")
