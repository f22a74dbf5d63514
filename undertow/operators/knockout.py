"""Knock out every dataset in turn and score how fragile the estate is around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import numbered
from ..session import pin
from .impact import Damage, by_name, by_number, present_owners, propagate, spread_out
from .lineage import DASHBOARD, DATASET, Graph, upstream_totals
from .spread import numbered as with_number

SWEEP_MINUTE = 4 * 60
# Score weights, which must sum to one, and the hours after which a failure
# counts as unseen.
WEIGHTS = {
    "blast": 0.25,
    "exposure": 0.25,
    "recovery": 0.25,
    "concentration": 0.15,
    "blindness": 0.10,
}
HORIZON_HOURS = 24
# Hours and hourly rates of the cost estimate.
ENGINEER_HOURS, ENGINEER_RATE = 4, 150
CONSUMER_HOURS, CONSUMER_RATE = 2, 75


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if set(weights) != set(WEIGHTS) or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError(f"weights must cover {sorted(WEIGHTS)} and sum to one")
    return weights


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Runs and distinct users per asset over all its buckets; unused assets are absent."""
    return (
        usage.groupBy("asset")
        .agg(
            F.sum("runs").alias("queries"),
            F.count_distinct(F.when(F.col("runs") > 0, F.col("user_name"))).alias("users"),
        )
        .where(F.col("queries") > 0)
    )


def sweep_faults(g: Graph) -> DataFrame:
    """One deletion scenario per dataset, all at the same hour."""
    return g.assets.where(F.col("kind") == DATASET).select(
        F.col("asset").alias("scenario"),
        F.lit("drop_asset").alias("kind"),
        F.col("asset").alias("origin"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit(SWEEP_MINUTE).alias("at_minute"),
    )


def sweep_events(g: Graph) -> DataFrame:
    return propagate(g, sweep_faults(g), with_via=False).drop("scenario", "column_name")


def sweep(g: Graph) -> Damage:
    """As :func:`sweep_events`, by number."""
    return spread_out(g, sweep_faults(g), with_via=False)


def by_origin(damage: Damage) -> DataFrame:
    """Numbers of the origin and of each asset lost with it: a scenario of the sweep is one origin.

    All faults of a sweep delete an asset at one hour, so a run is a scenario, a node is an asset, and nothing is joined.
    """
    offset = damage._minute() - SWEEP_MINUTE
    return damage.found.select(F.col("run").alias("origin"), F.col("node").alias("asset"), offset.alias("offset_minutes"))


def tally(g: Graph, broken: DataFrame, damage: Damage | None = None, used: DataFrame | None = None) -> DataFrame:
    """Per origin that loses anything: what it is, who owns it, when a reader first notices, and, with ``used``, its queries.

    Pairs of origin and asset are joined once, with one row per asset, and exchanged once more: a row per pair and owner, of which
    the first carries the counts. Owners are told apart by number.
    """
    dataset = F.col("kind") == DATASET
    owners = present_owners(g)
    kinds = g.assets.groupBy("asset").agg(
        F.count_if(dataset).alias("datasets"),
        F.count_if(~dataset).alias("consumers"),
        F.count_if(F.col("kind") == DASHBOARD).alias("dashboards"),
    )
    numbers = with_number(owners.select("owner").where(F.col("owner").isNotNull()), "owner_no", "owners")
    held = owners.join(numbers, "owner", "left").groupBy("asset").agg(
        F.lit(True).alias("owned"), F.collect_list("owner_no").alias("held")
    )
    facts = kinds.join(held, "asset", "full")
    if used is not None:
        facts = facts.join(_read(g, used).groupBy("asset").agg(F.sum("queries").alias("queries")), "asset", "left")
    if damage is not None:
        facts = by_number(facts, "asset", damage.names("asset"))
    each = broken.join(facts.hint("shuffle_hash"), "asset", "left").select("*", F.posexplode_outer("held").alias("turn", "owner_no"))
    once = F.coalesce(F.col("turn"), F.lit(0)) == 0
    sums = ["datasets", "consumers", "dashboards", *(["queries"] if used is not None else [])]
    per_owner = each.groupBy("origin", "owner_no").agg(
        *[F.sum(F.when(once, F.col(c))).alias(c) for c in sums],
        F.min(F.when(F.col("consumers") > 0, F.col("offset_minutes"))).alias("first"),
        F.count_if(once & F.col("owned").isNull()).alias("alone"),
    )
    return per_owner.groupBy("origin").agg(
        *[F.sum(c).alias(f"{c}_lost") for c in sums],
        F.min("first").alias("first_consumer_minutes"),
        F.sum("alone").alias("unowned_lost"),
        F.count("owner_no").alias("owners_paged"),
    )


def knockouts(g: Graph, broken: DataFrame, damage: Damage | None = None, lost: DataFrame | None = None) -> DataFrame:
    """Per origin: what is lost, who is paged, what pages nobody, when a reader first notices.

    With ``damage``, ``broken`` has the numbers of :func:`by_origin`; ``lost``, its :func:`tally`, is used if it is at hand.
    """
    lost = tally(g, broken, damage) if lost is None else lost
    everyone = g.assets.where(F.col("kind") == DATASET).select(F.col("asset").alias("origin"))
    everyone = everyone.withColumn("scenario", F.col("origin"))
    if damage is not None:
        everyone = by_number(everyone, "scenario", damage.names("scenario"), "left")
    joined = everyone.join(lost.withColumnRenamed("origin", "scenario"), "scenario", "left")
    counts = ("datasets_lost", "consumers_lost", "dashboards_lost", "owners_paged", "unowned_lost")
    return joined.select(
        "origin",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        "first_consumer_minutes",
    )


def radius() -> Column:
    return F.col("datasets_lost") + F.col("consumers_lost")


def share(part: Column, whole: Column) -> Column:
    """A share of a fixed total, so that scores of different nights stay comparable."""
    return F.when(whole > 0, F.least(part / whole, F.lit(1.0))).otherwise(F.lit(0.0))


def _read(g: Graph, used: DataFrame) -> DataFrame:
    datasets = g.assets.where(F.col("kind") == DATASET).select("asset")
    return used.join(datasets, "asset", "left_semi").select("asset", "queries")


def exposure(
    g: Graph, broken: DataFrame, used: DataFrame, damage: Damage | None = None, lost: DataFrame | None = None
) -> DataFrame:
    """Queries on the datasets lost with each origin; the origin's own are not among them.

    ``lost``, the :func:`tally` with ``used``, is used if it is at hand.
    """
    if lost is None:
        read = _read(g, used)
        if damage is not None:
            read = by_number(read, "asset", damage.names("asset"))
        lost = broken.join(read, "asset").groupBy("origin").agg(F.sum("queries").alias("queries_lost"))
    lost = lost.where(F.col("queries_lost").isNotNull()).select("origin", "queries_lost")
    return lost if damage is None else by_name(lost, "origin", damage.names("scenario"))


def swept_totals(g: Graph, values: DataFrame, broken: DataFrame, damage: Damage) -> DataFrame:
    """As ``upstream_totals`` of ``values`` (asset, value): what the sweep has found is not found again.

    The sweep has every pair of a dataset and what it reaches, save the dataset itself where a cycle leads back to it: these
    are looked up, and what no dataset starts is left to ``upstream_totals``. Damage stops at an asset that the
    estate does not list, and there the sweep is of no use.
    """
    edges = g.edges.select("source", "target")
    unlisted = edges.join(g.assets.select(F.col("asset").alias("source")), "source", "left_anti").select("source").distinct()
    if not unlisted.join(edges.select(F.col("target").alias("source")), "source", "left_semi").isEmpty():
        return upstream_totals(edges, values)
    datasets = g.assets.where(F.col("kind") == DATASET).select("asset")
    mine = values.join(datasets, "asset", "left_semi").withColumn("origin", F.col("asset"))
    mine = by_number(mine, "origin", damage.names("scenario"))
    pairs = broken.select("origin", "asset").join(mine.select("origin", "value").hint("shuffle_hash"), "origin")
    parts = by_name(pairs.groupBy("asset").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "asset", damage.names("asset"))
    parts = parts.unionByName(upstream_totals(edges, values.join(datasets, "asset", "left_anti")))
    if damage.core is not None:
        parts = parts.unionByName(_back_to_themselves(edges, mine, broken, damage))
    return parts.groupBy("asset").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _back_to_themselves(edges: DataFrame, mine: DataFrame, broken: DataFrame, damage: Damage) -> DataFrame:
    """(asset, n, total) of the datasets on a cycle: a step leads to them from themselves or from what they reach."""
    places = damage.names("asset")
    steps = by_number(by_number(edges.distinct(), "source", places), "target", places)
    steps = steps.join(damage.core.withColumnRenamed("place", "target"), "target", "left_semi")
    here = by_number(mine.select("origin", "asset").distinct(), "asset", places)
    back = here.join(steps, here["asset"] == steps["target"]).select("origin", F.col("target").alias("home"), F.col("source").alias("asset"))
    found = back.join(broken.select("origin", "asset"), ["origin", "asset"], "left_semi")
    cyclic = back.where(F.col("asset") == F.col("home")).unionByName(found.select(*back.columns)).select("origin").distinct()
    return mine.join(cyclic, "origin", "left_semi").groupBy("asset").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def recovery(g: Graph, reach: DataFrame | None = None, broken: DataFrame | None = None, damage: Damage | None = None) -> DataFrame:
    """How exposed each asset is to losing what it rests on; ``reach``, the closure, is used if it is at hand.

    So are, with ``damage``, the pairs of the sweep in ``broken``, by number.

    Replicated sources count nothing, unreplicated ones half with a fallback and fully
    without. What lies upstream decides; the asset's own flag only if nothing upstream has
    one, and one half if that is unknown too.
    """
    risk = F.when(F.col("replicated"), 0.0).when(
        F.nullif("fallback_source", F.lit("")).isNotNull(), 0.5
    ).otherwise(1.0)
    flagged = g.assets.where(F.col("replicated").isNotNull()).select("asset", risk.alias("risk"))
    if reach is None:
        values = flagged.withColumnRenamed("risk", "value")
        if damage is None:
            totals = upstream_totals(g.edges.select("source", "target"), values)
        else:
            totals = swept_totals(g, values, broken, damage)
        upstream = totals.select("asset", (F.col("total") / F.col("n")).alias("upstream_risk"))
    else:
        upstream = (
            reach.join(flagged.withColumnRenamed("asset", "origin"), "origin")
            .groupBy("asset")
            .agg(F.avg("risk").alias("upstream_risk"))
        )
    own = flagged.withColumnRenamed("risk", "own_risk")
    return g.assets.select("asset").join(upstream, "asset", "left").join(own, "asset", "left").select(
        F.col("asset").alias("origin"),
        F.coalesce("upstream_risk", "own_risk", F.lit(0.5)).alias("recovery"),
        F.coalesce("upstream_risk", "own_risk").isNotNull().alias("recovery_known"),
    )


def concentration() -> Column:
    """Mean of two shares: one over the number of owners paged, and the lost assets without an owner."""
    owners = F.col("owners_paged")
    few = F.when(owners > 0, F.lit(1.0) / F.nullif(owners, F.lit(0))).otherwise(1.0)
    alone = F.col("unowned_lost") / F.nullif(radius(), F.lit(0))
    return F.when(radius() == 0, 0.0).otherwise(F.least(few * 0.5 + alone * 0.5, F.lit(1.0)))


def blindness(horizon_hours: float = HORIZON_HOURS) -> Column:
    """How late the first reader notices, as a share of the horizon; nobody to notice is nought.

    The missing case comes first: ``least`` passes over nulls and would make it one.
    """
    seen = F.col("first_consumer_minutes") / F.lit(60.0 * horizon_hours)
    return F.when(seen.isNull(), 0.0).otherwise(F.least(seen, F.lit(1.0)))


def cost() -> Column:
    models = F.col("datasets_lost") * F.lit(ENGINEER_HOURS * ENGINEER_RATE)
    boards = F.col("dashboards_lost") * F.lit(CONSUMER_HOURS * CONSUMER_RATE)
    return F.round((models + boards).cast("decimal(20,4)"), 2)


def components(
    g: Graph, broken: DataFrame, used: DataFrame, reach: DataFrame | None = None, horizon: float = HORIZON_HOURS,
    damage: Damage | None = None,
) -> DataFrame:
    """The five components per dataset, each between nought and one. With ``damage``, ``broken`` has its numbers.

    The two totals are scalar subqueries: one row each, never joined to pairs of rows.
    """
    size = g.assets.agg(F.count("*")).scalar()
    total = used.agg(F.sum("queries")).scalar()
    lost = pin(tally(g, broken, damage, used), "tally")
    whole = (
        knockouts(g, broken, damage, lost)
        .join(exposure(g, broken, used, damage, lost), "origin", "left")
        .join(recovery(g, reach, broken, damage), "origin")
    )
    return whole.select(
        "origin",
        "datasets_lost",
        "consumers_lost",
        "dashboards_lost",
        "owners_paged",
        "unowned_lost",
        "first_consumer_minutes",
        share(radius(), size).alias("blast"),
        share(F.coalesce("queries_lost", F.lit(0)), F.coalesce(total, F.lit(0))).alias("exposure"),
        "recovery",
        concentration().alias("concentration"),
        blindness(horizon).alias("blindness"),
        cost().alias("cost"),
    )


def scores(parts: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    weights = check_weights(weights or WEIGHTS)
    total = sum((F.col(name) * weight for name, weight in weights.items()), F.lit(0.0))
    return parts.withColumn("score", total * 100)


def ranked(scored: DataFrame) -> DataFrame:
    """Ranks from one, most fragile first, equal scores by name."""
    return numbered(scored, [], [F.desc("score"), F.asc("origin")], "rank")


def is_spof() -> Column:
    """True where a consumer is lost and no more than one owner would be paged."""
    return (F.col("consumers_lost") > 0) & (F.col("owners_paged") <= 1)


def property_rows(scored: DataFrame, context: DataFrame, scored_at: str, provenance: str) -> DataFrame:
    """Every published value, one row per asset and property.

    ``scored`` is ranked; ``context`` has the confidence of each asset.
    """

    def at(column: str, places: int) -> Column:
        return F.round(F.col(column).cast("decimal(20,12)"), places).cast("double").cast("string")

    whole = scored.join(context.withColumnRenamed("asset", "origin"), "origin", "left")
    evidence = F.concat_ws(
        ";",
        *[
            F.concat(F.lit(f"{name}="), F.format_string("%.2f", F.coalesce(name, F.lit(0.0))))
            for name in ("lineage", "schema", "operational", "ownership", "usage", "verification")
        ],
    )
    values = {
        "fragility_score": at("score", 3),
        "resilience_score": F.round((100 - F.col("score")).cast("decimal(20,12)"), 3)
        .cast("double")
        .cast("string"),
        "fragility_rank": F.col("rank").cast("string"),
        "blast_radius": radius().cast("string"),
        "blast_radius_cost": F.col("cost").cast("double").cast("string"),
        "bus_factor": F.col("owners_paged").cast("string"),
        "is_spof": F.when(is_spof(), "yes").otherwise("no"),
        "scored_at": F.lit(scored_at),
        "scoring_provenance": F.lit(provenance),
        **{f"component_{name}": at(name, 4) for name in WEIGHTS},
        "context_confidence": F.coalesce(at("confidence", 4), F.lit("0.0")),
        "context_state": F.coalesce("band", F.lit("low")),
        "context_evidence": evidence,
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in values.items()])
    return whole.select(F.col("origin").alias("asset"), F.inline(pairs))


def gate(scored: DataFrame, changed: DataFrame, threshold: float = 50.0) -> DataFrame:
    """A verdict per changed asset; an asset the estate does not know fails the whole check."""
    return changed.select(F.col("asset").alias("origin")).distinct().join(scored, "origin", "left").select(
        F.col("origin").alias("asset"),
        "score",
        F.when(F.col("score").isNull(), "unknown")
        .when(F.col("score") >= threshold, "fail")
        .otherwise("pass")
        .alias("verdict"),
    )


def history_row(scored: DataFrame, target: str, fingerprint: str, scored_at: str) -> DataFrame:
    """One row per scoring run: what was scored, when, the mean, and the five most fragile with score and cost."""
    top = scored.orderBy(F.desc("score"), "origin").limit(5)
    five = top.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "origin", "score", "cost"))),
            lambda t: F.struct(t["origin"].alias("origin"), t["score"].alias("score"), t["cost"].alias("cost")),
        )
    ).scalar()
    return scored.agg(
        F.lit(target).alias("target"),
        F.lit(fingerprint).alias("fingerprint"),
        F.lit(scored_at).alias("scored_at"),
        F.count("*").alias("assets_scored"),
        F.avg("score").alias("mean_score"),
    ).withColumn("top", five)


def top_queries(usage: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` distinct query texts per asset, in order.

    Texts are de-duplicated before they meet in a group, and the group keeps a rank filter.
    """
    texts = usage.where(F.col("runs") > 0).select("asset", "query_text").distinct()
    turn = Window.partitionBy("asset").orderBy("query_text")
    return texts.withColumn("place", F.row_number().over(turn)).where(F.col("place") <= k)
