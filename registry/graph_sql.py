"""Checking SQL for reachability, propagation and scoring, as tables other checks build on."""

# The minute an asset fails when what it reads failed at minute M.
_DUE = """case when {on_read} then {m}
    when {c} = 'hourly' then (({m}) + 59) // 60 * 60
    when {c} like 'daily\\_%' escape '\\' then
        (substr({c}, 7, 2)::int * 60 + substr({c}, 9, 2)::int)
        + 1440 * (({m} - substr({c}, 7, 2)::int * 60 - substr({c}, 9, 2)::int + 1439) // 1440)
    else {m} + 5 end"""


def due(minute: str, alias: str) -> str:
    on_read = f"({alias}.kind <> 'dataset' or ifnull(lower({alias}.materialization) = 'view', false))"
    text = _DUE.replace("{m}", minute).replace("{c}", f"{alias}.refresh_cadence")
    return "(" + text.replace("{on_read}", on_read) + ")::int"


GRAPH_SQL = {
    "x_closure": """
        select distinct source as origin, target as asset from {lin_edges}
        union
        select origin, target from x_closure join {lin_edges} on asset = source""",
    "x_hops": """
        select source as origin, target as asset, 1 as hops from {lin_edges}
        union
        select origin, target, hops + 1 from x_hops join {lin_edges} on asset = source""",
    "x_kinds": """
        select * from (values ('drop_column', 'unavailable', true, true),
            ('drop_asset', 'unavailable', false, false),
            ('change_column_type', 'unavailable', true, true),
            ('stop_new_rows', 'degraded', false, true),
            ('null_out_column', 'degraded', true, true)) as k(kind, impact, by_column, needs_column)""",
    "x_faults": """
        select f.*, impact, by_column and exists (from {lin_column_edges} where source = origin)
            as narrow
        from {sim_faults} as f join {x_kinds} using (kind)""",
    "x_wave": """
        select distinct scenario, impact, origin, at_minute, target as asset, tc as column_name
        from (select f.*, target, unnest([target_column, '']) as tc from {x_faults} as f
              join {lin_column_edges} as e on e.source = origin and e.source_column = f.column_name
              where narrow
              union all
              select f.*, target, '' from {x_faults} as f join {lin_edges} on source = origin
              where not narrow
              union all
              select f.*, target, c.column_name from {x_faults} as f
              join {lin_edges} on source = origin join {lin_columns} as c on c.asset = target
              where not narrow)
        where target <> origin""",
    "x_moves": """
        select l.*, kind, materialization, refresh_cadence
        from (select 'unavailable' as impact, source, '' as sc, target, '' as tc from {lin_edges}
              union
              select 'degraded', source, '', target, '' from {lin_edges}
              where source not in (select source from {lin_column_edges})
              union
              select 'degraded', source, '', target, column_name from {lin_edges}
              join {lin_columns} on asset = target
              where source not in (select source from {lin_column_edges})
              union
              select 'degraded', source, source_column, target, unnest([target_column, ''])
              from {lin_column_edges}) as l
        join {lin_assets} on asset = target""",
    "x_spread": f"""
        select scenario, impact, origin, at_minute, w.asset, column_name,
               {due("at_minute", "a")} as due, origin as via, '' as via_column
        from {{x_wave}} as w join {{lin_assets}} as a on a.asset = w.asset
        where impact = 'degraded' or column_name = ''
        union
        select s.scenario, s.impact, s.origin, s.at_minute, m.target, m.tc, {due("s.due", "m")},
               s.asset, s.column_name
        from x_spread as s join {{x_moves}} as m
             on m.impact = s.impact and m.source = s.asset and m.sc = s.column_name
        where m.target <> s.origin""",
    "x_timeline": """
        select scenario, impact, origin, asset, column_name, min(due - at_minute) as offset_minutes,
               min(struct_pack(d := due, v := via, c := via_column)) as best
        from {x_spread} group by all""",
    "x_events": """
        select scenario, impact, origin, asset, offset_minutes, best.v as via from {x_timeline}
        where column_name = ''""",
    "x_owners": "select distinct asset, owner from {lin_owners}",
    "x_severity": """
        select asset, case lower(tier) when 'tier1' then 3 when 'tier2' then 2 else 1 end
            + case when asset in (select source from {lin_edges} join {lin_assets} as t
                                  on t.asset = target where t.kind <> 'dataset') then 2 else 0 end
            as severity
        from {lin_assets}""",
    "x_pages": """
        select scenario, owner, min(offset_minutes) as offset_minutes,
               arg_min(asset, struct_pack(o := offset_minutes, a := asset)) as first_asset,
               any_value(impact) as impact, count(*) as asset_count, max(severity) as severity
        from {x_events} join {x_owners} using (asset) join {x_severity} using (asset) group by all""",
    "x_unowned": """
        select scenario, asset from {x_events}
        where asset not in (select asset from {x_owners})""",
    "x_sweep_walk": f"""
        select a.asset as origin, target as asset, {due("240", "t")} as due
        from {{lin_assets}} as a join {{lin_edges}} on source = a.asset
             join {{lin_assets}} as t on t.asset = target
        where a.kind = 'dataset' and target <> a.asset
        union
        select s.origin, target, {due("s.due", "t")}
        from x_sweep_walk as s join {{lin_edges}} on source = s.asset
             join {{lin_assets}} as t on t.asset = target
        where target <> s.origin""",
    "x_sweep": """
        select origin, asset, min(due) - 240 as offset_minutes from {x_sweep_walk} group by all""",
    "x_usage": """
        select asset, sum(runs)::bigint as queries,
               count(distinct user_name) filter (runs > 0) as users
        from {lin_usage} group by all having sum(runs) > 0""",
    "x_knockouts": """
        select o.asset as origin, count(*) filter (l.kind = 'dataset') as datasets_lost,
               count(*) filter (l.kind <> 'dataset') as consumers_lost,
               count(*) filter (l.kind = 'dashboard') as dashboards_lost,
               (select count(distinct owner) from {x_sweep} as z join {x_owners} as w
                on w.asset = z.asset where z.origin = o.asset) as owners_paged,
               count(s.asset) filter (s.asset not in (select asset from {x_owners}))
                   as unowned_lost,
               min(offset_minutes) filter (l.kind <> 'dataset') as first_consumer_minutes
        from {lin_assets} as o left join {x_sweep} as s on s.origin = o.asset
             left join {lin_assets} as l on l.asset = s.asset
        where o.kind = 'dataset' group by o.asset""",
    "x_exposure": """
        select s.origin, sum(queries)::bigint as queries_lost
        from {x_sweep} as s join {x_usage} as u on u.asset = s.asset
             join {lin_assets} as a on a.asset = s.asset where kind = 'dataset' group by all""",
    "x_risk": """
        select asset, if(replicated, 0.0, if(ifnull(fallback_source, '') <> '', 0.5, 1.0)) as risk
        from {lin_assets} where replicated is not null""",
    "x_recovery": """
        select a.asset as origin, coalesce(
                   (select avg(risk) from {x_closure} as c join {x_risk} as r on r.asset = c.origin
                    where c.asset = a.asset), o.risk, 0.5) as recovery
        from {lin_assets} as a left join {x_risk} as o on o.asset = a.asset""",
    "x_parts": """
        select k.*, least((datasets_lost + consumers_lost) / (select count(*) from {lin_assets}), 1)
                   as blast,
               least(ifnull(queries_lost, 0) / (select sum(queries) from {x_usage}), 1) as exposure,
               recovery,
               case when datasets_lost + consumers_lost = 0 then 0
                    else least(0.5 * ifnull(1 / nullif(owners_paged, 0), 1)
                               + 0.5 * unowned_lost / (datasets_lost + consumers_lost), 1) end
                   as concentration,
               case when first_consumer_minutes is null then 0.0
                    else least(first_consumer_minutes / 1440, 1) end as blindness,
               (datasets_lost * 600 + dashboards_lost * 150)::double as cost
        from {x_knockouts} as k left join {x_exposure} using (origin)
             join {x_recovery} using (origin)""",
    "x_scores": """
        select *, 100 * (0.25 * blast + 0.25 * exposure + 0.25 * recovery + 0.15 * concentration
                         + 0.1 * blindness) as score
        from {x_parts}""",
    # Scores are ranked as they are published, so that the last bit of a sum settles no order.
    "x_ranked": """
        select *, row_number() over (order by score desc, origin) as rank
        from (select * replace (round(score, 9) as score) from {x_scores})""",
    "x_context": """
        select a.asset, if(kind <> 'dataset' or a.asset in (select source from {lin_edges})
                   or a.asset in (select target from {lin_edges}), 1.0, 0.0) as lineage,
               if(kind <> 'dataset', 1.0, least(ifnull(n, 0) / 8, 1)) as schema,
               ((team is not null)::int + (refresh_cadence is not null)::int
                + (sla_hours is not null)::int + (tier is not null)::int
                + (replicated is not null)::int) / 5 as operational,
               if(a.asset in (select asset from {lin_owners}), 1.0, 0.0) as ownership,
               if(a.asset in (select asset from {x_usage}), 1.0, 0.0) as usage,
               if(a.asset in (select fault_asset from {led_evidence}
                              where fingerprint = 'state F'), 1.0, 0.0) as verification
        from {lin_assets} as a
        left join (select asset, count(*) as n from {lin_columns} group by all) as c
               on c.asset = a.asset""",
    "x_confidence": """
        select *, if(confidence >= 0.8, 'high', if(confidence >= 0.5, 'partial', 'low')) as band
        from (select *, round((0.25 * lineage + 0.2 * schema + 0.25 * operational
                  + 0.15 * ownership + 0.1 * usage + 0.05 * verification)::decimal(20,12), 4)::double
                  as confidence from {x_context})""",
    "x_shaped": """
        select urn, split_part(urn, ':', 3) as kind,
               coalesce(body->>'$.name', body->>'$.properties.name') as name,
               if(split_part(urn, ':', 3) = 'dataset',
                  substr(split_part(urn, ',', 2), strpos(split_part(urn, ',', 2), '.') + 1),
                  split_part(urn, ':', 3) || ':' || (body->>'$.properties.name')) as asset,
               body->>'$.properties.customProperties[0].value' as team,
               try_cast(body->>'$.properties.customProperties[1].value' as int) as sla_hours,
               lower(trim(body->>'$.properties.customProperties[2].value')) = 'true' as replicated,
               split_part(body->>'$.ownership.owners[0].owner.urn', ':', 4) as owner,
               split_part(body->>'$.tags.tags[0].tag.urn', ':', 4) as tag
        from {cat_records}""",
}
