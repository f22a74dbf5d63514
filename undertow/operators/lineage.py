"""Lineage as tables: shaping catalog records, resolving edges, reachability, gaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered as in_order
from ..functions.scalars import tolerant_bool, tolerant_int
from ..functions.summaries import fingerprint
from ..session import pin
from .spread import by_level, earliest, numbered, reached

DATASET = "dataset"
DASHBOARD = "dashboard"

# The layer that an asset of each kind belongs to, when it is not a dataset.
LAYER_BY_KIND = {
    "dashboard": "bi",
    "chart": "bi",
    "mlFeatureTable": "ml",
    "mlFeature": "ml",
    "mlModel": "ml",
    "mlModelDeployment": "ml",
}

RECORD = (
    "name string, dashboardId string, chartId string, "
    "properties struct<name: string, customProperties: array<struct<key: string, value: string>>>, "
    "ownership struct<owners: array<struct<owner: struct<urn: string>>>>, "
    "tags struct<tags: array<struct<tag: struct<urn: string>>>>, "
    "schemaMetadata struct<fields: array<struct<fieldPath: string, nativeDataType: string, "
    "nullable: boolean>>>, subTypes struct<typeNames: array<string>>"
)


@dataclass(frozen=True)
class Graph:
    """An estate at one moment: its assets and how data flows between them."""

    assets: DataFrame
    columns: DataFrame
    owners: DataFrame
    edges: DataFrame
    column_edges: DataFrame

    @classmethod
    def of(cls, w) -> Graph:
        return cls(
            w["lin_assets"], w["lin_columns"], w["lin_owners"], w["lin_edges"], w["lin_column_edges"]
        )

    def fingerprint(self) -> DataFrame:
        """Identity of the content alone: the time and place of the read are not part of it."""
        return fingerprint(
            {
                "assets": self.assets,
                "columns": self.columns,
                "owners": self.owners.distinct(),
                "edges": self.edges.distinct(),
                "column_edges": self.column_edges.distinct(),
            }
        )


# ------------------------------------------------------------------ records to assets


def kind_of(urn: Column) -> Column:
    return F.split_part(urn, F.lit(":"), F.lit(3))


def key_of(urn: Column, name: Column, scope: str | None = None) -> Column:
    """Datasets are known by their path below ``scope``, the rest by kind and name.

    A path outside the scope, or any path without one, loses its first component, the database.
    """
    inside = F.regexp_extract(urn, r"\(.*?,([^,)]*)", 1)
    below = F.regexp_replace(inside, r"^[^.]*\.", "")
    if scope:
        below = F.when(inside.startswith(scope), F.substring(inside, len(scope) + 1, F.length(inside))).otherwise(below)
    return F.when(kind_of(urn) == DATASET, below).otherwise(
        F.concat_ws(":", kind_of(urn), name)
    )


def layer_of(key: Column, kind: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in LAYER_BY_KIND.items() for x in pair])
    return F.when(kind != DATASET, F.coalesce(F.try_element_at(named, kind), F.lit("other"))).otherwise(
        F.when(F.instr(key, ".") > 0, F.substring_index(key, ".", 1)).otherwise("other")
    )


def shape_records(records: DataFrame, scope: str | None = None) -> DataFrame:
    """One flat row per catalog record; ``records`` has ``urn`` and a JSON ``body``."""
    parsed = records.select("urn", F.from_json("body", RECORD).alias("r"))
    props = F.map_from_entries(
        F.filter(
            F.coalesce(F.col("r.properties.customProperties"), F.array()),
            lambda p: p["key"].isNotNull(),
        )
    )

    def first_text(*options: Column) -> Column:
        return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])

    name = first_text(
        F.col("r.name"),
        F.col("r.properties.name"),
        F.col("r.dashboardId"),
        F.col("r.chartId"),
        F.col("urn"),
    )
    shaped = parsed.withColumn("props", props).withColumn("name", name)
    prop = {k: F.try_element_at("props", F.lit(k)) for k in (
        "team", "refresh_cadence", "sla_hours", "criticality_tier", "replicated",
        "fallback_source", "materialization",
    )}
    key = key_of(F.col("urn"), F.col("name"), scope)
    return shaped.select(
        "urn",
        key.alias("asset"),
        kind_of(F.col("urn")).alias("kind"),
        "name",
        layer_of(key, kind_of(F.col("urn"))).alias("layer"),
        prop["team"].alias("team"),
        prop["refresh_cadence"].alias("refresh_cadence"),
        tolerant_int(prop["sla_hours"]).alias("sla_hours"),
        prop["criticality_tier"].alias("tier"),
        tolerant_bool(prop["replicated"]).alias("replicated"),
        prop["fallback_source"].alias("fallback_source"),
        prop["materialization"].alias("materialization"),
        F.col("r.subTypes.typeNames")[0].alias("sub_type"),
        F.transform(
            F.coalesce(F.col("r.ownership.owners"), F.array()),
            lambda o: F.substring_index(o["owner"]["urn"], ":", -1),
        ).alias("owners"),
        F.transform(
            F.coalesce(F.col("r.tags.tags"), F.array()),
            lambda t: F.regexp_replace(t["tag"]["urn"], "^urn:li:tag:", ""),
        ).alias("tags"),
        F.col("r.schemaMetadata.fields").alias("fields"),
    )


def fold_records(shaped: DataFrame) -> DataFrame:
    """One row per asset: for each value, the first record in urn order that has one.

    Only the smallest (urn, value) pair per column travels, so an asset described by a great
    many records is folded on the map side like any other.
    """

    def first_of(column: str, blank_counts: bool) -> Column:
        c = F.col(column)
        present = c.isNotNull() if blank_counts else F.nullif(c, F.lit("")).isNotNull()
        return F.min_by(c, F.when(present, F.col("urn"))).alias(column)

    text = ("team", "refresh_cadence", "tier", "fallback_source", "materialization", "sub_type")
    return shaped.groupBy("asset").agg(
        F.min("urn").alias("first_urn"),
        F.count("*").alias("record_count"),
        *[F.min_by(c, "urn").alias(c) for c in ("kind", "name", "layer")],
        *[first_of(c, False) for c in text],
        *[first_of(c, True) for c in ("sla_hours", "replicated")],
    )


def fold_lists(shaped: DataFrame, column: str, alias: str) -> DataFrame:
    """The union of a list over an asset's records, one row per distinct element."""
    return shaped.select("asset", F.explode(column).alias(alias)).where(
        F.col(alias).isNotNull()
    ).distinct()


def fold_columns(shaped: DataFrame) -> DataFrame:
    """Columns of the first record, in urn order, that has any."""
    described = shaped.where(F.size("fields") > 0)
    chosen = described.groupBy("asset").agg(F.min("urn").alias("urn"))
    return described.join(chosen, ["asset", "urn"]).select(
        "asset", F.inline("fields")
    ).select(
        "asset",
        F.col("fieldPath").alias("column_name"),
        F.coalesce(F.nullif("nativeDataType", F.lit("")), F.lit("unknown")).alias("native_type"),
        F.coalesce("nullable", F.lit(True)).alias("nullable"),
    )


# ------------------------------------------------------------------ edges


def resolve_edges(upstreams: DataFrame, keys: DataFrame) -> DataFrame:
    """Urn pairs as asset pairs; unknown ends and links within one asset are left out."""
    source = keys.select(F.col("urn").alias("upstream_urn"), F.col("asset").alias("source"))
    target = keys.select("urn", F.col("asset").alias("target"))
    return (
        upstreams.join(source, "upstream_urn")
        .join(target, "urn")
        .where(F.col("source") != F.col("target"))
        .select("source", "target")
        .distinct()
    )


def containment_edges(groups: DataFrame, keys: DataFrame) -> DataFrame:
    """Members to the group that lists them; ``groups`` has ``urn`` and an array ``members``."""
    pairs = groups.select("urn", F.explode("members").alias("upstream_urn"))
    return resolve_edges(pairs, keys)


def resolve_column_edges(probes: DataFrame, columns: DataFrame, paths: DataFrame) -> DataFrame:
    """Every column of a consumer is a possible landing; a pair nobody could answer for stays.

    ``probes`` names (source, source_column, target); ``paths`` answers ``connected`` for a
    column pair, null or absent meaning unanswered.
    """
    landings = columns.select(F.col("asset").alias("target"), F.col("column_name").alias("target_column"))
    pair = ["source", "source_column", "target", "target_column"]
    return (
        probes.where(F.col("source") != F.col("target"))
        .distinct()
        .join(landings, "target")
        .join(paths, pair, "left")
        .where(F.coalesce("connected", F.lit(True)))
        .select(*pair, F.col("connected").isNull().alias("assumed"))
        .distinct()
    )


# ------------------------------------------------------------------ reading the graph


def neighbours(edges: DataFrame) -> DataFrame:
    """One hop in each direction."""
    down = edges.select(
        F.col("source").alias("asset"), F.lit("downstream").alias("side"), F.col("target").alias("neighbour")
    )
    up = edges.select(
        F.col("target").alias("asset"), F.lit("upstream").alias("side"), F.col("source").alias("neighbour")
    )
    return down.unionByName(up).distinct()


def _numbered_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asset, id) of everything on an edge, and the edges as (from_node, node)."""
    names = numbered(edges.select(F.explode(F.array("source", "target")).alias("asset")), "id")

    def number(df: DataFrame, column: str, alias: str) -> DataFrame:
        return df.join(names.select(F.col("asset").alias(column), F.col("id").alias(alias)), column)

    links = number(number(edges.distinct(), "source", "from_node"), "target", "node")
    return names, pin(links.select("from_node", "node"), "links")


def closure(edges: DataFrame, origins: DataFrame | None = None) -> DataFrame:
    """Every (origin, asset) with asset reachable from origin, and the least number of hops.

    An origin reaches itself only if it lies on a cycle. With ``origins`` (asset) only theirs: the
    others take no part in any round.
    """
    names, moves = _numbered_edges(edges)
    first = moves
    if origins is not None:
        asked = names.join(origins.select("asset"), "asset", "left_semi")
        first = moves.join(asked, moves["from_node"] == asked["id"], "left_semi")
    start = first.select(F.col("from_node").alias("who"), "node", F.lit(1).alias("due"))
    further = F.col("due") + 1

    def rounds(came: DataFrame, inside: DataFrame) -> DataFrame:
        return earliest(came, inside, ["who"], further)

    found = by_level(start, moves, ["who"], F.min("due").alias("due"), further.alias("due"), rounds)
    named = found.join(names.select(F.col("id").alias("who"), F.col("asset").alias("origin")), "who")
    return named.join(names.withColumnRenamed("id", "node"), "node").select(
        "origin", "asset", F.col("due").alias("hops")
    )


def upstream_totals(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(asset, n, total): number and sum of ``values`` (asset, value) over all that lies upstream, each counted once.

    Assets are taken 64 of one value at a time, a bit each, so no pair of assets is ever a row: what
    travels is which of them reach a node, however many ways lead there. The values should be few.
    """
    names, moves = _numbered_edges(edges)
    placed = in_order(values.join(names, "asset"), ["value"], [F.col("id")], "place")
    place = F.col("place") - 1
    kinds = in_order(values.select("value").distinct(), [], [F.col("value")], "kind")
    word = F.col("kind") * F.lit(1 << 40) + F.floor(place / 64)
    bits = F.expr("shiftleft(1L, cast((place - 1) % 64 as int))")
    origins = pin(placed.join(kinds, "value").select(F.col("id").alias("from_node"), word.cast("bigint").alias("word"), bits.alias("bits"), "value"), "words")
    start = origins.join(moves, "from_node").select("word", "node", "bits")
    found = reached(start, moves).join(origins.select("word", "value").distinct(), "word")
    n = F.bit_count("bits")
    totals = found.groupBy("node").agg(F.sum(n).alias("n"), F.sum(n * F.col("value")).alias("total"))
    return totals.join(names.withColumnRenamed("id", "node"), "node").select("asset", "n", "total")


def summary(g: Graph) -> DataFrame:
    """Counts by layer and kind, with the declared metadata each group carries."""
    owned = g.owners.select("asset").distinct().withColumn("owned", F.lit(True))
    width = g.columns.groupBy("asset").agg(F.count("*").alias("n_columns"))
    out = g.edges.groupBy(F.col("source").alias("asset")).agg(F.count("*").alias("n_out"))
    whole = (
        g.assets.join(owned, "asset", "left")
        .join(width, "asset", "left")
        .join(out, "asset", "left")
    )
    return whole.groupBy("layer", "kind").agg(
        F.count("*").alias("assets"),
        F.sum(F.coalesce("n_columns", F.lit(0))).alias("columns"),
        F.sum(F.coalesce("n_out", F.lit(0))).alias("outgoing_edges"),
        F.count_if(F.col("owned").isNull()).alias("unowned"),
        F.count("sla_hours").alias("with_sla"),
        F.count_if(F.col("replicated").eqNullSafe(F.lit(False))).alias("unreplicated"),
    )


def lineage_gaps(g: Graph, landed_layers: list[str], declared: DataFrame) -> DataFrame:
    """Columns of landed tables that have consumers by table but none by column.

    ``declared`` lists the (asset, column_name) pairs already described at the source.
    """
    landed = g.assets.where((F.col("kind") == DATASET) & F.col("layer").isin(*landed_layers))
    read = g.edges.groupBy(F.col("source").alias("asset")).agg(
        F.count_distinct("target").alias("consumers")
    )
    traced = g.column_edges.select(
        F.col("source").alias("asset"), F.col("source_column").alias("column_name")
    )
    return (
        g.columns.join(landed.select("asset"), "asset", "left_semi")
        .join(traced, ["asset", "column_name"], "left_anti")
        .join(declared, ["asset", "column_name"], "left_anti")
        .join(read, "asset")
        .select("asset", "column_name", "consumers")
    )
