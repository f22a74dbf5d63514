"""Published property values and incidents: keyed replacement, removal, read-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The prefixes that mark what this system published, and incident types by impact.
PROPERTY_PREFIX = "undertow_"
INCIDENT_PREFIX = "urn:li:incident:undertow_"
INCIDENT_TYPE = {"unavailable": "OPERATIONAL", "degraded": "FIELD"}


def upsert(published: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Replace every row of each key that ``fresh`` brings; other keys stay as they are. A null is a key like any other."""
    brought = fresh.select(*key).distinct().alias("f")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"f.{k}")) for k in key]
    kept = published.alias("p").join(brought, same, "left_anti")
    return kept.unionByName(fresh.select(*published.columns))


def without_prefix(published: DataFrame, prefix: str = PROPERTY_PREFIX) -> DataFrame:
    """What is left after removing our own properties."""
    return published.where(~F.col("property").startswith(prefix))


def assets_with_prefix(published: DataFrame, prefix: str = PROPERTY_PREFIX) -> DataFrame:
    """How many assets such a removal touches."""
    return published.where(F.col("property").startswith(prefix)).agg(
        F.count_distinct("asset").alias("assets_cleared")
    )


def read_back(published: DataFrame, assets: DataFrame) -> DataFrame:
    """Known assets with what is published on them, by the published rank, with the coverage.

    ``published`` is wide: asset, rank and score as they came back.
    """
    total = assets.agg(F.count_distinct("asset")).scalar()
    found = published.join(assets.select("asset").distinct(), "asset", "left_semi")
    n = found.agg(F.count_distinct("asset")).scalar()
    return found.withColumns({"carrying": n, "of_assets": total}).orderBy(
        F.asc_nulls_last("rank"), "asset"
    )


def incident_id(scenario: Column, asset: Column) -> Column:
    return F.translate(
        F.concat(F.lit(INCIDENT_PREFIX), scenario, F.lit("_"), asset), ".", "_"
    )


def incidents(observed: DataFrame, urns: DataFrame, raised_at: str, provenance: str = "") -> DataFrame:
    """One active incident per affected asset that the catalog knows, attached to all its urns.

    ``urns`` lists them in order and ``urn`` is the first. The id depends on the scenario and the asset only, so a second
    run replaces the first. ``observed`` may carry ``detail``, what the execution said, which goes into the description.
    """
    known = urns.where(F.col("urn").isNotNull()).groupBy("asset").agg(F.array_sort(F.collect_set("urn")).alias("urns"))
    kinds = F.create_map(*[F.lit(x) for pair in INCIDENT_TYPE.items() for x in pair])
    detail = F.col("detail") if "detail" in observed.columns else F.lit(None).cast("string")
    said = F.coalesce(F.concat(F.lit(" It reported: "), detail), F.lit(""))
    title = F.concat_ws(" ", "asset", F.lit("is"), "impact", F.lit("under"), "scenario")
    story = F.concat(
        F.lit("The fault of scenario "), "scenario", F.lit(" was carried out on a shadow copy, and "), "asset",
        F.lit(" was seen to be "), "impact", F.lit(" after the rebuild."), said,
        F.lit(f" Run: {provenance}" if provenance else ""),
    )
    return (
        observed.where(F.col("impact").isNotNull())
        .join(known, "asset")
        .select(
            incident_id(F.col("scenario"), F.col("asset")).alias("incident"),
            "asset",
            F.element_at("urns", 1).alias("urn"),
            "urns",
            "impact",
            F.coalesce(F.try_element_at(kinds, "impact"), F.lit("OPERATIONAL")).alias("type"),
            title.alias("title"),
            story.alias("description"),
            F.lit("ACTIVE").alias("state"),
            F.lit(raised_at).alias("updated_at"),
        )
    )


def resolve(table: DataFrame, resolved_at: str) -> DataFrame:
    """Our active incidents resolved, everything else untouched; nothing is deleted."""
    ours = F.col("incident").startswith(INCIDENT_PREFIX) & (F.col("state") == "ACTIVE")
    return table.withColumns(
        {
            "updated_at": F.when(ours, F.lit(resolved_at)).otherwise(F.col("updated_at")),
            "state": F.when(ours, "RESOLVED").otherwise(F.col("state")),
        }
    )
