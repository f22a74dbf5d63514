"""Lineage, impact, knockout and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertow.operators import context, impact, knockout, lineage
from undertow.operators.lineage import Graph
from undertow.session import pin

from .core import query

_PINNED: dict[tuple, object] = {}


def held(w, label, build):
    """What several queries read, built once per session and set of input files.

    A warehouse with replaced tables has results of its own, told apart by what replaces them;
    a folder whose files were written anew is read anew.
    """
    files = tuple(sorted(w["lin_assets"].inputFiles() + w["lin_usage"].inputFiles()))
    stamps = tuple(_written(w.spark, f) for f in files)
    mine = tuple(sorted((name, -1 if df is None else df.semanticHash()) for name, df in w.replaced.items()))
    key = (w.spark.sparkContext.applicationId, w.root, stamps, mine, label)
    if key not in _PINNED:
        _PINNED[key] = build()
    return _PINNED[key]


def pinned(w, label, build):
    """A table several queries read, computed once."""
    return held(w, label, lambda: pin(build(), label))


def _written(spark, file: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


def reach(w):
    return pinned(w, "closure", lambda: lineage.closure(w["lin_edges"]))


def damage(w):
    return held(w, "damage", lambda: impact.spread_out(Graph.of(w), w["sim_faults"]))


def timeline(w):
    return damage(w).named()


def broken(w):
    """What breaks in which scenario, by number."""
    return pinned(w, "events", lambda: damage(w).events())


def named(w, rows, *columns):
    """Numbers of :func:`broken` in ``columns``, by name."""
    for column in columns:
        rows = impact.by_name(rows, column, damage(w).names(column))
    return rows


def swept(w):
    return held(w, "swept", lambda: knockout.sweep(Graph.of(w)))


def sweep(w):
    return held(w, "sweep", lambda: knockout.by_origin(swept(w)))


def used(w):
    return knockout.usage_rollup(w["lin_usage"])


def parts(w):
    def build():
        return knockout.components(Graph.of(w), sweep(w), used(w), damage=swept(w))

    return pinned(w, "components", build)


def ranked(w):
    def build():
        scored = knockout.scores(parts(w)).withColumn("score", F.round("score", 9))
        return knockout.ranked(scored)

    return pinned(w, "ranked", build)


def verified(w):
    return context.verified_assets(w["led_evidence"], "state F")


def known(w):
    return context.confidence(context.components(Graph.of(w), used(w), verified(w)))


# ------------------------------------------------------------------ lineage


@query("ln_shape", """
    select * exclude (owner, tag),
           case when kind in ('dashboard', 'chart') then 'bi' else split_part(asset, '.', 1) end as layer,
           null::varchar as refresh_cadence, null::varchar as tier, null::varchar as fallback_source,
           null::varchar as materialization, null::varchar as sub_type,
           ifnull(owner, '') as owners, ifnull(tag, '') as tags,
           if(urn like '%dataPlatform:postgres%', 'c0:bigint:false,c1:?:?', '') as columns
    from {x_shaped}""")
def ln_shape(w):
    shaped = lineage.shape_records(w["cat_records"])
    columns = F.transform(
        F.coalesce("fields", F.array()),
        lambda f: F.concat_ws(
            ":", f["fieldPath"], F.coalesce(f["nativeDataType"], F.lit("?")),
            F.coalesce(f["nullable"].cast("string"), F.lit("?")),
        ),
    )
    return shaped.withColumns(
        {"owners": F.array_join("owners", ","), "tags": F.array_join("tags", ","), "columns": F.array_join(columns, ",")}
    ).drop("fields")


# Every third dataset lies one level deeper, below the scope of another estate.
_NESTED = "if(kind = 'dataset' and length(asset) % 3 = 0, replace(urn, ',warehouse.', ',operations.warehouse.'), urn)"


@query("fn_key_layer", f"""
    select {_NESTED} as urn, asset, case when kind in ('dashboard', 'chart') then 'bi'
           else split_part(asset, '.', 1) end as layer from {{x_shaped}}""")
def fn_key_layer(w):
    shaped = lineage.shape_records(w["cat_records"])
    deeper = (F.col("kind") == "dataset") & (F.length("asset") % 3 == 0)
    nested = F.replace("urn", F.lit(",warehouse."), F.lit(",operations.warehouse."))
    moved = shaped.select("urn", F.when(deeper, nested).otherwise(F.col("urn")).alias("to"))
    records = w["cat_records"].join(moved, "urn").select(F.col("to").alias("urn"), "body")
    return lineage.shape_records(records, "operations.warehouse.").select("urn", "asset", "layer")


@query("ag_fold", """
    select asset, count(*) as record_count,
           arg_min(name, urn) as name, arg_min(team, urn) filter (team <> '') as team,
           arg_min(sla_hours, urn) filter (sla_hours is not null) as sla_hours,
           arg_min(replicated, urn) filter (replicated is not null) as replicated,
           count(distinct owner) as owner_count, count(distinct tag) as tag_count
    from {x_shaped} group by asset""")
def ag_fold(w):
    shaped = lineage.shape_records(w["cat_records"])
    folded = lineage.fold_records(shaped).select(
        "asset", "record_count", "name", "team", "sla_hours", "replicated"
    )
    for column in ("owner", "tag"):
        each = lineage.fold_lists(shaped, f"{column}s", column)
        n = each.groupBy("asset").agg(F.count("*").alias(f"{column}_count"))
        folded = folded.join(n, "asset", "left").fillna(0, [f"{column}_count"])
    return folded


@query("ln_edges", """
    select distinct s.asset as source, t.asset as target
    from {cat_upstreams} as u join {cat_keys} as s on s.urn = u.upstream_urn
         join {cat_keys} as t on t.urn = u.urn where s.asset <> t.asset""")
def ln_edges(w):
    return lineage.resolve_edges(w["cat_upstreams"], w["cat_keys"])


@query("ln_containment", """
    select distinct s.asset as source, t.asset as target
    from (select urn, unnest(from_json(members, '["VARCHAR"]')) as member from {cat_groups}) as g
         join {cat_keys} as s on s.urn = member join {cat_keys} as t on t.urn = g.urn
    where s.asset <> t.asset""")
def ln_containment(w):
    groups = w["cat_groups"].withColumn("members", F.from_json("members", "array<string>"))
    return lineage.containment_edges(groups, w["cat_keys"])


@query("ln_column_edges", """
    select distinct p.source, p.source_column, p.target, c.column_name as target_column,
           connected is null as assumed
    from {cat_probes} as p join {lin_columns} as c on c.asset = p.target
         left join {cat_paths} as q on q.source = p.source and q.source_column = p.source_column
              and q.target = p.target and q.target_column = c.column_name
    where ifnull(connected, true)""")
def ln_column_edges(w):
    return lineage.resolve_column_edges(w["cat_probes"], w["lin_columns"], w["cat_paths"])


@query("ln_neighbours", """
    select source as asset, 'downstream' as side, target as neighbour from {lin_edges}
    union select target, 'upstream', source from {lin_edges}""")
def ln_neighbours(w):
    return lineage.neighbours(w["lin_edges"])


@query("ln_closure", "select origin, asset, min(hops)::int as hops from {x_hops} group by all")
def ln_closure(w):
    return reach(w)


@query("ln_column_consumers", """
    select distinct target, target_column, source from {lin_column_edges}
    where source_column = 'c1'""")
def ln_column_consumers(w):
    edges = w["lin_column_edges"]
    return edges.where(F.col("source_column") == "c1").select("target", "target_column", "source").distinct()


@query("ln_summary", """
    select layer, kind, count(*) as assets, sum(ifnull(n, 0))::bigint as columns,
           sum(ifnull(m, 0))::bigint as outgoing_edges,
           count(*) filter (asset not in (select asset from {lin_owners})) as unowned,
           count(sla_hours) as with_sla, count(*) filter (not replicated) as unreplicated
    from {lin_assets}
    left join (select asset, count(*) as n from {lin_columns} group by all) using (asset)
    left join (select source as asset, count(*) as m from {lin_edges} group by all) using (asset)
    group by all""")
def ln_summary(w):
    return lineage.summary(Graph.of(w))


@query("ln_gaps", """
    select c.asset, c.column_name, count(distinct target) as consumers
    from {lin_columns} as c join {lin_assets} as a on a.asset = c.asset
         join {lin_edges} on source = c.asset
    where layer = 'landing' and kind = 'dataset'
      and (c.asset, c.column_name) not in (select (source, source_column) from {lin_column_edges})
      and (c.asset, c.column_name) not in (select (asset, column_name) from {cat_declared})
    group by all""")
def ln_gaps(w):
    return lineage.lineage_gaps(Graph.of(w), ["landing"], w["cat_declared"])


@query("so_fanout", """
    select source as asset, direct, total
    from (select source, count(distinct target) as direct from {lin_edges} group by all)
    join (select origin as source, count(*) as total from {x_closure} group by all) using (source)
    order by direct desc, source limit 5""")
def so_fanout(w):
    direct = w["lin_edges"].groupBy(F.col("source").alias("asset")).agg(
        F.count_distinct("target").alias("direct")
    )
    top = pin(direct.orderBy(F.desc("direct"), "asset").limit(5), "fanout")
    total = lineage.closure(w["lin_edges"].select("source", "target"), top).groupBy(F.col("origin").alias("asset")).agg(F.count("*").alias("total"))
    return top.join(total, "asset")


# ------------------------------------------------------------------ impact


@query("im_kinds", """
    select kind, k.impact, by_column, needs_column, count(*) as faults,
           count(*) filter (needs_column and column_name is null) as without_column
    from {sim_faults} join {x_kinds} as k using (kind) group by all""")
def im_kinds(w):
    faults = impact.with_kind(w["sim_faults"])
    return faults.groupBy(
        "kind", "impact", (F.col("reach") == "column").alias("by_column"), "needs_column"
    ).agg(
        F.count("*").alias("faults"),
        F.count_if(F.col("needs_column") & F.col("column_name").isNull()).alias("without_column"),
    )


@query("im_first_wave", "select scenario, impact, origin, asset, column_name from {x_wave}")
def im_first_wave(w):
    return impact.first_wave(Graph.of(w), w["sim_faults"]).drop("at_minute")


@query("im_unavailable", "select * from {x_events} where impact = 'unavailable'")
def im_unavailable(w):
    return impact.events(damage(w).named(whole=True)).where(F.col("impact") == "unavailable")


@query("im_degraded", """
    select scenario, asset, column_name, offset_minutes from {x_timeline}
    where impact = 'degraded' and column_name <> ''""")
def im_degraded(w):
    rows = damage(w).named(via=False).where((F.col("impact") == "degraded") & (F.col("column_name") != ""))
    return rows.select("scenario", "asset", "column_name", "offset_minutes")


@query("im_timeline", """
    select scenario, impact, origin, asset, column_name, offset_minutes, best.v as via,
           best.c as via_column from {x_timeline}""")
def im_timeline(w):
    return timeline(w)


@query("im_next_refresh", """
    select asset, at_minute, case when refresh_cadence = 'hourly'
               then at_minute + (60 - at_minute % 60) % 60
             when refresh_cadence = 'daily_0630' then 390 + if(at_minute > 390, 1440, 0)
             when refresh_cadence = 'daily_1845' then 1125 + if(at_minute > 1125, 1440, 0)
             else at_minute + 5 end as next_minute
    from {lin_assets} join {sim_faults} on origin = asset""")
def im_next_refresh(w):
    both = w["lin_assets"].join(w["sim_faults"].withColumnRenamed("origin", "asset"), "asset")
    due = impact.next_refresh(F.col("refresh_cadence"), F.col("at_minute"))
    return both.select("asset", "at_minute", due.alias("next_minute"))


@query("im_break_time", """
    select asset, case when kind <> 'dataset' or materialization = 'view' then at_minute
             when refresh_cadence = 'hourly' then at_minute + (60 - at_minute % 60) % 60
             when refresh_cadence = 'daily_0630' then 390 + if(at_minute > 390, 1440, 0)
             when refresh_cadence = 'daily_1845' then 1125 + if(at_minute > 1125, 1440, 0)
             else at_minute + 5 end as breaks_at
    from {lin_assets} join (select origin as asset, at_minute from {sim_faults}) using (asset)""")
def im_break_time(w):
    both = w["lin_assets"].join(
        w["sim_faults"].select(F.col("origin").alias("asset"), "at_minute"), "asset"
    )
    due = impact.break_time(
        F.col("kind"), F.col("materialization"), F.col("refresh_cadence"), F.col("at_minute")
    )
    return both.select("asset", due.alias("breaks_at"))


@query("im_paging", """
    select scenario, owner, min(offset_minutes) as offset_minutes,
           arg_min(asset, struct_pack(o := offset_minutes, a := asset)) as first_asset,
           any_value(impact) as impact, count(*) as asset_count, max(severity) as severity,
           string_agg(distinct asset, ',' order by asset) as assets
    from {x_events} join {x_owners} using (asset) join {x_severity} using (asset) group by all""")
def im_paging(w):
    pages = impact.named_pages(impact.paging(Graph.of(w), broken(w), damage=damage(w)), damage(w))
    return pages.withColumn("assets", F.array_join("assets", ","))


@query("im_severity", "select asset, severity from {x_severity}")
def im_severity(w):
    return impact.severity(Graph.of(w))


@query("im_unowned", "select * from {x_unowned}")
def im_unowned(w):
    alone = impact.unowned(Graph.of(w), broken(w), damage=damage(w))
    return named(w, alone, "scenario", "asset")


@query("im_load", """
    select scenario, ifnull(owners_paged, 0) as owners_paged, heaviest, heaviest_assets,
           ifnull(unowned_assets, 0) as unowned_assets
    from (select scenario, count(*) as owners_paged,
                 arg_min(owner, struct_pack(n := -asset_count, o := offset_minutes, s := -severity,
                                            w := owner)) as heaviest,
                 max(asset_count) as heaviest_assets from {x_pages} group by all) as p
    full join (select scenario, count(*) as unowned_assets from {x_unowned} group by all) as u
         using (scenario)""")
def im_load(w):
    g, d = Graph.of(w), damage(w)
    pages, alone = impact.paging(g, broken(w), damage=d), impact.unowned(g, broken(w), damage=d)
    return named(w, impact.load(pages, alone), "scenario")


@query("wn_first_per_owner", """
    select scenario, owner, page_no from (
        select scenario, owner, row_number() over (partition by scenario
               order by offset_minutes, severity desc, owner) as page_no from {x_pages})""")
def wn_first_per_owner(w):
    pages = impact.paging(Graph.of(w), broken(w), damage=damage(w))
    return named(w, impact.page_order(pages).select("scenario", "owner", "page_no"), "scenario")


@query("fn_offset", """
    select scenario, asset, offset_minutes,
           '+' || if(offset_minutes >= 1440, (offset_minutes // 1440) || 'd ', '')
           || lpad((offset_minutes % 1440 // 60)::varchar, 2, '0') || ':'
           || lpad((offset_minutes % 60)::varchar, 2, '0') as offset_label
    from {x_events}""")
def fn_offset(w):
    from undertow.functions.scalars import offset_text

    return named(w, broken(w), "scenario", "asset").select(
        "scenario", "asset", "offset_minutes", offset_text(F.col("offset_minutes")).alias("offset_label")
    )


# ------------------------------------------------------------------ knockout and scores


@query("ko_usage", "select * from {x_usage}")
def ko_usage(w):
    return used(w)


@query("ko_top_queries", """
    select asset, query_text, place from (
        select asset, query_text, row_number() over (partition by asset order by query_text) as place
        from (select distinct asset, query_text from {lin_usage} where runs > 0)) where place <= 5""")
def ko_top_queries(w):
    return knockout.top_queries(w["lin_usage"])


@query("ko_sweep", "select * from {x_knockouts}")
def ko_sweep(w):
    return knockout.knockouts(Graph.of(w), sweep(w), swept(w))


for _name in ("blast", "exposure", "recovery", "concentration", "blindness", "cost"):
    query(f"ko_{_name}", f"select origin, {_name} from {{x_parts}}")(
        lambda w, c=_name: parts(w).select("origin", c)
    )


@query("ko_score", "select origin, score, rank from {x_ranked}")
def ko_score(w):
    return ranked(w).select("origin", "score", "rank")


@query("ko_spof", """
    select origin, owners_paged as bus_factor, consumers_lost > 0 and owners_paged <= 1 as is_spof
    from {x_knockouts}""")
def ko_spof(w):
    lost = knockout.knockouts(Graph.of(w), sweep(w), swept(w))
    return lost.select("origin", F.col("owners_paged").alias("bus_factor"), knockout.is_spof().alias("is_spof"))


def _properties(w):
    return knockout.property_rows(ranked(w), known(w), "2001-12-31T00:00:00Z", "test estate")


@query("ko_properties", """
    with p as (
        select origin as asset, r.*, c.* exclude (asset)
        from {x_ranked} as r left join {x_confidence} as c on c.asset = r.origin)
    select asset, 'fragility_rank' as property, rank::varchar as text, null::double as value_number from p
    union all select asset, 'blast_radius', (datasets_lost + consumers_lost)::varchar, null from p
    union all select asset, 'bus_factor', owners_paged::varchar, null from p
    union all select asset, 'is_spof', if(consumers_lost > 0 and owners_paged <= 1, 'yes', 'no'),
                     null from p
    union all select asset, 'context_state', band, null from p
    union all select asset, 'scored_at', '2001-12-31T00:00:00Z', null from p
    union all select asset, 'scoring_provenance', 'test estate', null from p
    union all select asset, 'fragility_score', null, round(score, 3) from p
    union all select asset, 'resilience_score', null, round(100 - score, 3) from p
    union all select asset, 'blast_radius_cost', null, cost from p
    union all select asset, 'context_confidence', null, confidence from p
    union all select asset, 'component_blast', null, round(blast, 4) from p
    union all select asset, 'component_exposure', null, round(exposure, 4) from p
    union all select asset, 'component_recovery', null, round(recovery, 4) from p
    union all select asset, 'component_concentration', null, round(concentration, 4) from p
    union all select asset, 'component_blindness', null, round(blindness, 4) from p
    union all select asset, 'context_evidence', printf('lineage=%.2f;schema=%.2f;'
        || 'operational=%.2f;ownership=%.2f;usage=%.2f;verification=%.2f', lineage::double,
        schema::double, operational::double, ownership::double, usage::double,
        verification::double), null from p""")
def ko_properties(w):
    numeric = F.col("property").rlike("_score$|cost|confidence|component")
    rows = _properties(w)
    return rows.select(
        "asset",
        "property",
        F.when(~numeric, F.col("value")).alias("text"),
        F.when(numeric, F.col("value").try_cast("double")).alias("value_number"),
    )


@query("ko_gate", """
    select a.asset, score, case when score is null then 'unknown' when score >= 15 then 'fail'
           else 'pass' end as verdict
    from (select distinct asset from {cat_declared}) as a left join {x_ranked} on origin = a.asset""")
def ko_gate(w):
    return knockout.gate(ranked(w), w["cat_declared"], 15.0)


@query("ko_top5", """
    with five as (select row_number() over (order by score desc, origin) as place, origin, score, cost
                  from {x_ranked} order by score desc, origin limit 5)
    select place, origin, score, cost, 'fleet' as target, 'fp' as fingerprint, 'now' as scored_at,
           (select count(*) from {x_ranked}) as assets_scored, (select avg(score) from {x_ranked}) as mean_score
    from five""")
def ko_top5(w):
    row = knockout.history_row(ranked(w), "fleet", "fp", "now")
    return row.select(F.posexplode("top").alias("place", "t"), "target", "fingerprint", "scored_at",
                      "assets_scored", "mean_score").select(
        (F.col("place") + 1).alias("place"), "t.*", "target", "fingerprint", "scored_at", "assets_scored", "mean_score"
    )


# ------------------------------------------------------------------ context


@query("cx_components", "select * from {x_context}")
def cx_components(w):
    return context.components(Graph.of(w), used(w), verified(w))


@query("cx_score", "select asset, confidence, band from {x_confidence}")
def cx_score(w):
    return known(w).select("asset", "confidence", "band")


@query("cx_verified", "select distinct fault_asset as asset from {led_evidence} where fingerprint = 'state F'")
def cx_verified(w):
    return verified(w)


@query("cx_candidates", """
    select *, row_number() over (order by priority_score desc, path, scenario) as place from (
    select scenario, origin, path, band, novelty,
           round((0.5 * impact + 0.35 * (1 - confidence) + 0.15 * novelty)::decimal(20,12), 6)::double
               as priority_score,
           round(impact::decimal(20,12), 4)::double as impact_part,
           round((1 - confidence)::decimal(20,12), 4)::double as gap
    from (select f.scenario, f.origin, 'faults/' || kind as path, band, confidence,
                 case when ifnull(score, 0) > 0 then least(score / 100, 1)
                      else least(ifnull(n, 0) / (select count(*) from {lin_assets}), 1) end as impact,
                 if(f.scenario in (select scenario from {led_evidence} where fingerprint = 'state F'),
                    0.2, 1.0) as novelty
          from {sim_faults} as f join {x_confidence} on asset = f.origin
               left join {x_ranked} as r on r.origin = f.origin
               left join (select origin, count(*) as n from {x_closure} group by all) as c
                      on c.origin = f.origin))""")
def cx_candidates(w):
    scenarios = w["sim_faults"].select(
        "scenario", "origin", F.concat(F.lit("faults/"), "kind").alias("path")
    )
    size = w["lin_assets"].agg(F.count("*")).scalar()
    # How far an origin reaches counts only where it has no score.
    unscored = scenarios.select(F.col("origin").alias("asset")).distinct().join(
        ranked(w).where("score > 0").select(F.col("origin").alias("asset")), "asset", "left_anti"
    )
    reach = lineage.closure(w["lin_edges"].select("source", "target"), unscored)
    return context.candidates(
        scenarios, known(w), ranked(w), reach, w["led_evidence"], "state F", size
    )
