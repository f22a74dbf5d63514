"""Fault copies, rebuilds, grading, incidents: the what-if queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from undertow.operators import baseline, faults, grading, publishing, rebuild
from undertow.operators.impact import by_name, by_number, with_more
from undertow.plans import CONSUMERS, MODELS, downstream_models
from undertow.session import checkpoint_root
from undertow.sources.keyed import KeyedTable

from .core import TABLE_SQL, on_grid, query
from .graph import broken, damage, named, reach


def faulted_tables(tag: str, origin: str, copy: str, only: list[str] | None = None) -> None:
    """Checking SQL for a rebuilt estate: ``<tag>_<table>`` for the copy and what reads it."""
    affected = {origin, *(only or downstream_models(origin))}
    TABLE_SQL[f"{tag}_{origin}"] = copy
    for name in affected - {origin}:
        TABLE_SQL[f"{tag}_{name}"] = re.sub(
            r"\{(\w+)\}",
            lambda m: f"{{{tag}_{m[1]}}}"
            if m[1] in ({origin} if only else affected)
            else m[0],
            TABLE_SQL[name],
        )


def differs(tag: str, name: str) -> str:
    ours, theirs = on_grid(f"{{{tag}_{name}}}"), on_grid(f"{{{name}}}")
    return f"""
        select '{name}' as asset, case when exists (
            (({ours}) except all ({theirs})) union all (({theirs}) except all ({ours})))
            then 'degraded' end as impact"""


# ------------------------------------------------------------------ fault copies


@query("flt_drop_column", "select * exclude (channel) from {raw_orders}")
def flt_drop_column(w):
    return faults.drop_column(w["raw_orders"], "channel")


@query("flt_type_regression", "select * replace (order_id::varchar as order_id) from {raw_orders}")
def flt_type_regression(w):
    return faults.change_column_type(w["raw_orders"], "order_id")


@query("flt_null_column", "select * replace (null::bigint as merchant_id) from {raw_orders}")
def flt_null_column(w):
    return faults.null_out_column(w["raw_orders"], "merchant_id")


@query("flt_stop_new_rows", """
    from {raw_shipments}
    where shipped_ts <= (select max(shipped_ts) from {raw_shipments}) - interval 90 day""")
def flt_stop_new_rows(w):
    return faults.stop_new_rows(w["raw_shipments"], "shipped_ts", 90)


# ------------------------------------------------------------------ rebuilds

_CLASSIFIED = downstream_models("raw_orders")
faulted_tables("nm", "raw_orders", "select * replace (null::bigint as merchant_id) from {raw_orders}")


@query("wi_classify", " union all ".join(differs("nm", n) for n in _CLASSIFIED))
def wi_classify(w):
    fault = rebuild.Fault("null_out_column", "raw_orders", "merchant_id")
    stored = baseline.Baseline(w, f"{checkpoint_root(w.spark)}/baseline-{uuid.uuid4().hex}")
    production = stored.store(_CLASSIFIED)
    return rebuild.classify(production, fault, _CLASSIFIED, stored).drop("detail")


_BELOW = downstream_models("int_orders_enriched")
_READERS = [n for n in _BELOW if "int_orders_enriched" in MODELS[n].reads]
faulted_tables(
    "nd",
    "int_orders_enriched",
    "select * replace (null::double as discount_amount_usd) from {int_orders_enriched}",
    _READERS,
)


@query("wi_probe", " union all ".join(
    differs("nd", n) if n in _READERS else f"select '{n}', null" for n in _BELOW))
def wi_probe(w):
    fault = rebuild.Fault("null_out_column", "int_orders_enriched", "discount_amount_usd")
    return rebuild.probes(w, fault).drop("detail")


_LINKS = ", ".join(f"('{t}', '{m.name}')" for m in MODELS.values() for t in m.reads)
faulted_tables(
    "nc", "raw_orders", "select * replace (null::bigint as customer_id) from {raw_orders}", ["stg_orders"]
)


@query("wi_cascade", f"""
    with recursive links as (select * from (values {_LINKS}) as l(source, target)),
         -- the not-null test of stg_orders, on the emptied column
         test as (select count(*) filter (customer_id is null) > 0 as failed from {{nc_stg_orders}}),
         changed as (select impact is not null as it_is from ({differs("nc", "stg_orders")})),
         below as (select 'stg_orders' as asset union
                   select target from below join links on source = asset)
    select asset, case when asset = 'stg_orders'
                       then if((select failed from test) or (select it_is from changed), 'degraded', null)
                       when (select failed from test) then 'unavailable' end as impact
    from below""")
def wi_cascade(w):
    fault = rebuild.Fault("null_out_column", "raw_orders", "customer_id")
    return rebuild.cascade(w, fault).drop("detail")


@query("wi_scope", """
    select origin, asset from {x_closure} join {lin_assets} using (asset)
    where kind = 'dataset' and layer <> 'landing'""")
def wi_scope(w):
    built = w["lin_assets"].where((F.col("kind") == "dataset") & (F.col("layer") != "landing"))
    return reach(w).join(built, "asset", "left_semi").select("origin", "asset")


faulted_tables("late", "raw_orders", """
    from {raw_orders}
    where order_ts <= (select max(order_ts) from {raw_orders}) - interval 3 day""")


_LATE, _REAL = on_grid("{late_int_merchant_daily}"), on_grid("{int_merchant_daily}")


@query("wi_differences", f"""
    select (select count(*) from (({_LATE}) except all ({_REAL}))) as only_rebuilt,
           (select count(*) from (({_REAL}) except all ({_LATE}))) as only_real""")
def wi_differences(w):
    fault = rebuild.Fault("stop_new_rows", "raw_orders", "order_ts", 3)
    shadow = rebuild.overlay(w, fault)
    return rebuild.row_differences(shadow["int_merchant_daily"], w["int_merchant_daily"])


# Consumers, the table each reads, and whether it reads the column that is dropped.
_CONSUMERS = ", ".join(
    f"('{c.name}', {c.daily_runs}, '{t}')" for c in CONSUMERS.values() for t in c.reads
)


@query("wi_consumers", f"""
    with reads as (select * from (values {_CONSUMERS}) as r(consumer, daily_runs, source)),
         columns_read as (select * from (values
             ('capacity_watch', 'o_mart_capacity_risk', 'load_ratio'),
             ('carrier_score', 'o_mart_carrier_network', 'on_time_rate')) as u(consumer, source, column_name)),
         dropped as (select 'o_mart_capacity_risk' as source, 'load_ratio' as column_name)
    select consumer, daily_runs,
           coalesce(bool_or(column_name is not null), false) as failed
    from reads left join (columns_read semi join dropped using (source, column_name)) using (consumer, source)
    group by consumer, daily_runs""")
def wi_consumers(w):
    fault = rebuild.Fault("drop_column", "o_mart_capacity_risk", "load_ratio")
    ran = rebuild.consumers(rebuild.overlay(w, fault))
    return ran.select("consumer", "daily_runs", F.col("error").isNotNull().alias("failed"))


# ------------------------------------------------------------------ grading

_GRADED = """
    (select coalesce(p.scenario, o.scenario) as scenario, coalesce(p.asset, o.asset) as asset,
            coalesce(p.impact, o.impact) as impact,
            case when s.asset is null then if(p.asset is not null, 'ungraded', null)
                 when p.asset is null then 'miss' when o.asset is null then 'false_alarm'
                 else 'hit' end as verdict
     from (select distinct scenario, asset, {impact} as impact from {{x_events}}) as p
     full join (select distinct scenario, asset, {impact} as impact from {{sim_observed}}) as o
          on o.scenario = p.scenario and o.asset = p.asset and o.impact = p.impact
     left join (select asset from {{lin_assets}} where kind = 'dataset' and layer <> 'landing') as s
          on s.asset = coalesce(p.asset, o.asset))"""
_CARD = """
    select {by}, count(*) filter (verdict = 'hit') as hits,
           count(*) filter (verdict = 'false_alarm') as false_alarms,
           count(*) filter (verdict = 'miss') as misses,
           count(*) filter (verdict = 'ungraded') as ungraded,
           count(*) filter (verdict = 'hit')
               / nullif(count(*) filter (verdict in ('hit', 'false_alarm')), 0) as precision,
           count(*) filter (verdict = 'hit')
               / nullif(count(*) filter (verdict in ('hit', 'miss')), 0) as recall,
           count(*) filter (verdict = 'hit') > 0
               and count(*) filter (verdict in ('miss', 'false_alarm')) = 0 as suspicious
    from {graded} where verdict is not null group by all"""
_ANY = _GRADED.replace("{impact}", "'any'").replace("{{", "{").replace("}}", "}")
_EACH = _GRADED.replace("{impact}", "impact").replace("{{", "{").replace("}}", "}")


def said_and_seen(w):
    """What is predicted, what was observed, by number, and the names (name, number) of scenarios and assets of both."""
    names, seen = {}, w["sim_observed"]
    for column in ("scenario", "asset"):
        names[column] = with_more(damage(w).names(column), seen, column)
        seen = by_number(seen, column, names[column], "left")
    return broken(w), seen, names


def graded(w, keys):
    built = w["lin_assets"].where((F.col("kind") == "dataset") & (F.col("layer") != "landing"))
    predicted, observed, names = said_and_seen(w)
    inside = by_number(built.select("asset"), "asset", names["asset"])
    return grading.verdicts(predicted, observed, inside, keys), names


@query("wi_scorecard", _CARD.replace("{by}", "scenario").replace("{graded}", _ANY))
def wi_scorecard(w):
    verdicts, names = graded(w, ["scenario", "asset"])
    return by_name(grading.scorecard(verdicts, ["scenario"]), "scenario", names["scenario"])


@query("wi_cards", _CARD.replace("{by}", "impact").replace("{graded}", _EACH))
def wi_cards(w):
    verdicts, _ = graded(w, ["scenario", "asset", "impact"])
    return grading.scorecard(verdicts, ["impact"])


@query("wi_ungraded", f"""
    select kind, count(*) as predictions from {_ANY} join {{lin_assets}} using (asset)
    where verdict = 'ungraded' group by all""")
def wi_ungraded(w):
    verdicts, names = graded(w, ["scenario", "asset"])
    return grading.ungraded_by_kind(verdicts, by_number(w["lin_assets"], "asset", names["asset"]))


@query("jn_semi", """
    select scenario, asset from {sim_observed}
    where (scenario, asset) in (select (scenario, asset) from {x_events})""")
def jn_semi(w):
    seen = w["sim_observed"].select("scenario", "asset", F.col("scenario").alias("_s"), F.col("asset").alias("_a"))
    for column, name in (("_s", "scenario"), ("_a", "asset")):
        seen = by_number(seen, column, damage(w).names(name))
    said = broken(w).select(F.col("scenario").alias("_s"), F.col("asset").alias("_a"))
    return seen.join(said, ["_s", "_a"], "left_semi").select("scenario", "asset")


@query("jn_anti", """
    select scenario, asset from {x_events}
    except select scenario, asset from {sim_observed}""")
def jn_anti(w):
    seen = w["sim_observed"].select("scenario", "asset")
    for column in seen.columns:
        seen = by_number(seen, column, damage(w).names(column))
    left = broken(w).select("scenario", "asset").join(seen, ["scenario", "asset"], "left_anti")
    return named(w, left, "scenario", "asset")


@query("se_key_sets", """
    select scenario, asset, bool_or(said) as said, bool_or(seen) as seen
    from (select scenario, asset, true as said, false as seen from {x_events}
          union all select scenario, asset, false, true from {sim_observed}) group by all""")
def se_key_sets(w):
    said, seen, names = said_and_seen(w)
    said = said.select("scenario", "asset", F.lit(True).alias("said"))
    seen = seen.select("scenario", "asset", F.lit(False).alias("said"))
    sets = said.unionByName(seen).groupBy("scenario", "asset").agg(
        F.bool_or("said").alias("said"), F.bool_or(~F.col("said")).alias("seen")
    )
    return by_name(by_name(sets, "scenario", names["scenario"]), "asset", names["asset"])


# ------------------------------------------------------------------ published values, incidents


@query("wi_incidents", """
    select 'urn:li:incident:undertow_' || replace(scenario || '_' || o.asset, '.', '_') as incident,
           o.asset, urn, urns, impact,
           if(impact = 'degraded', 'FIELD', 'OPERATIONAL') as type,
           o.asset || ' is ' || impact || ' under ' || scenario as title,
           'The fault of scenario ' || scenario || ' was carried out on a shadow copy, and ' || o.asset
           || ' was seen to be ' || impact || ' after the rebuild. It reported: ' || impact || ' in ' || scenario
           || ' Run: nightly' as description,
           'ACTIVE' as state, 'today' as updated_at
    from {sim_observed} as o
    join (select asset, min(urn) as urn, string_agg(distinct urn, ' ' order by urn) as urns
          from {cat_keys} group by asset) as k on k.asset = o.asset""")
def wi_incidents(w):
    observed = w["sim_observed"].withColumn("detail", F.concat_ws(" in ", "impact", "scenario"))
    raised = publishing.incidents(observed, w["cat_keys"], "today", "nightly")
    return raised.withColumn("urns", F.array_join("urns", " "))


@query("wi_resolve", """
    select incident, if(ours, 'today', updated_at) as updated_at, if(ours, 'RESOLVED', state) as state
    from (select *, state = 'ACTIVE' and incident like '%:undertow\\_%' escape '\\' as ours
          from {pub_incidents})""")
def wi_resolve(w):
    return publishing.resolve(w["pub_incidents"], "today")


def _stored(w):
    """The published values as a stored table of its own."""
    values = w["pub_values"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.schema.fields)
    stored = KeyedTable(w.spark, f"{checkpoint_root(w.spark)}/published-{uuid.uuid4().hex}", schema, ["asset"], 16)
    stored.upsert(values)
    return stored


@query("snk_upsert", """
    from {pub_fresh} union all by name
    from {pub_values} where asset not in (select asset from {pub_fresh})""")
def snk_upsert(w):
    """On a stored table: loaded, two batches on top, read back."""
    stored = _stored(w)
    half = F.pmod(F.xxhash64("asset"), F.lit(2)) == 0
    for part in (half, ~half):
        stored.upsert(w["pub_fresh"].where(part))
    return stored.read()


@query("snk_prefix_delete", """
    select count(distinct asset) as assets_cleared, (select count(*) from {pub_values}
        where property = 'owner_note') as rows_left
    from {pub_values} where property <> 'owner_note'""")
def snk_prefix_delete(w):
    stored = _stored(w)
    cleared = publishing.assets_with_prefix(stored.read())
    stored.remove(F.col("property").startswith(publishing.PROPERTY_PREFIX))
    return cleared.withColumn("rows_left", stored.read().agg(F.count("*")).scalar())


@query("snk_readback", """
    select p.*, count(*) over () as carrying, (select count(*) from {lin_assets}) as of_assets
    from {pub_ranks} as p where asset in (select asset from {lin_assets})""")
def snk_readback(w):
    return publishing.read_back(w["pub_ranks"], w["lin_assets"])
