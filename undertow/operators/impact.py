"""What a fault breaks, when, and whom it wakes: all scenarios propagated together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import numbered as in_order
from ..session import pin
from .lineage import DATASET, Graph
from .spread import by_level, earliest, numbered, place_levels

UNAVAILABLE, DEGRADED = "unavailable", "degraded"
DAY = 1440

# Fault kind, how its readers fail, whether it reaches them by column or by
# table, and whether it needs a column.
KINDS = [
    ("drop_column", "unavailable", "column", True),
    ("drop_asset", "unavailable", "table", False),
    ("change_column_type", "unavailable", "column", True),
    ("stop_new_rows", "degraded", "table", True),
    ("null_out_column", "degraded", "column", True),
]
# Severity by tier, what an asset with no tier counts for, what a direct consumer adds.
TIER_WEIGHT = {"tier1": 3, "tier2": 2, "tier3": 1}
UNTIERED_WEIGHT = 1
CONSUMER_BONUS = 2
# Fixed value: minutes until an asset that refreshes continuously shows the damage.
CONTINUOUS_LAG = 5


def kinds(spark) -> DataFrame:
    return spark.createDataFrame(KINDS, "kind string, impact string, reach string, needs_column boolean")


def with_kind(faults: DataFrame) -> DataFrame:
    """Faults with their kind's impact and reach; the five kinds are always broadcast."""
    return faults.join(F.broadcast(kinds(faults.sparkSession)), "kind")


def clock_of(cadence: Column) -> Column:
    """When an asset rebuilds: -2 hourly, -1 continuously or unknown, else the minute of the day."""
    pattern = r"^daily_([01]\d|2[0-3])([0-5]\d)$"
    hour = F.regexp_extract(cadence, pattern, 1).try_cast("int")
    minute = F.regexp_extract(cadence, pattern, 2).try_cast("int")
    return F.when(cadence == "hourly", -2).otherwise(F.coalesce(hour * 60 + minute, F.lit(-1)))


def at_clock(clock: Column, minute: Column) -> Column:
    """First rebuild at or after ``minute``."""
    today = (F.floor(minute / DAY) * DAY).cast("int") + clock
    return (
        F.when(clock == -2, (F.ceil(minute / 60) * 60).cast("int"))
        .when(clock == -1, minute + CONTINUOUS_LAG)
        .otherwise(F.when(today >= minute, today).otherwise(today + DAY))
    )


def next_refresh(cadence: Column, minute: Column) -> Column:
    """First rebuild at or after ``minute``; an unknown cadence counts as continuous."""
    return at_clock(clock_of(cadence), minute)


def on_read(kind: Column, materialization: Column) -> Column:
    """True for views and for everything that is no dataset: these are computed when read."""
    return (kind != DATASET) | F.coalesce(F.lower(materialization) == "view", F.lit(False))


def break_time(kind: Column, materialization: Column, cadence: Column, minute: Column) -> Column:
    return F.when(on_read(kind, materialization), minute).otherwise(next_refresh(cadence, minute))


def _all_columns(links: DataFrame, g: Graph) -> DataFrame:
    """Each link once for the target as a whole (blank column) and once per target column."""
    columns = g.columns.select(F.col("asset").alias("target"), F.col("column_name").alias("target_column"))
    return links.withColumn("target_column", F.lit("")).unionByName(links.join(columns, "target"))


def first_wave(g: Graph, faults: DataFrame) -> DataFrame:
    """What each fault reaches directly, with the columns it corrupts there.

    Blank ``column_name`` stands for the asset itself. A fault in one column reaches that
    column's readers, unless its asset describes no column lineage at all: then nothing is
    known about who reads what, and every consumer is reached.
    """
    described = g.column_edges.select(F.col("source").alias("origin")).distinct().withColumn(
        "described", F.lit(True)
    )
    known = with_kind(faults).join(described, "origin", "left")
    by_column = (F.col("reach") == "column") & F.col("described").isNotNull()
    keep = ["scenario", "impact", "origin", "at_minute"]

    edges = g.column_edges.select(
        F.col("source").alias("origin"),
        F.col("source_column").alias("column_name"),
        "target",
        "target_column",
    )
    narrow = known.where(by_column).join(edges, ["origin", "column_name"]).select(
        *keep, "target", "target_column"
    )
    narrow = narrow.unionByName(narrow.withColumn("target_column", F.lit("")))
    direct = g.edges.select(F.col("source").alias("origin"), "target").distinct()
    wide = _all_columns(known.where(~by_column).join(direct, "origin").select(*keep, "target"), g)
    return (
        narrow.unionByName(wide.select(*narrow.columns))
        .where(F.col("target") != F.col("origin"))
        .distinct()
        .select(*keep, F.col("target").alias("asset"), F.col("target_column").alias("column_name"))
    )


def moves(g: Graph) -> DataFrame:
    """Every step damage can take, with how its target fails.

    Unavailability follows table edges. Wrong values follow column edges, from the columns
    they are in; an asset that describes no column lineage passes them to all its consumers.
    """
    described = g.column_edges.select("source").distinct()
    edges = g.edges.select("source", "target").distinct()
    gone = edges.select(
        F.lit(UNAVAILABLE).alias("impact"), "source", F.lit("").alias("source_column"), "target",
        F.lit("").alias("target_column"),
    )
    blind = _all_columns(edges.join(described, "source", "left_anti"), g).select(
        F.lit(DEGRADED).alias("impact"), "source", F.lit("").alias("source_column"), "target",
        "target_column",
    )
    traced = g.column_edges.select(F.lit(DEGRADED).alias("impact"), "*")
    traced = traced.unionByName(traced.withColumn("target_column", F.lit("")))
    return gone.unionByName(blind).unionByName(traced).distinct()


@dataclass(frozen=True)
class Damage:
    """What :func:`spread_out` finds, by number: only rows that are asked for by name are named.

    ``found`` has run, node and due; ``nodes`` node, impact, asset, column_name and place, the number of the asset;
    ``runs`` run, scenario, impact, origin, at_minute and turn, the number of the scenario. Nodes and places are in the
    order of their names; a node is even if it is an asset, odd if it is a column. ``core`` has the places on cycles and between
    them, and is None if there are none.
    """

    found: DataFrame
    nodes: DataFrame
    runs: DataFrame
    with_via: bool
    core: DataFrame | None = None

    def _minute(self) -> Column:
        return F.shiftright("due", 32).cast("int") if self.with_via else F.col("due")

    def _found(self, whole: bool) -> DataFrame:
        return self.found.where(F.col("node").bitwiseAND(F.lit(1)) == 0) if whole else self.found

    def named(self, whole: bool = False, via: bool | None = None) -> DataFrame:
        """The rows of :func:`propagate`, those of the assets themselves if ``whole``."""
        nodes = self.nodes.select("node", "asset", "column_name")
        nodes = nodes.where(F.col("column_name") == "") if whole else nodes
        # Each of the three is small beside what is found, which is hashed against it and never sorted.
        named = self._found(whole).join(nodes.hint("shuffle_hash"), "node").join(self.runs.hint("shuffle_hash"), "run")
        reached = [
            "scenario",
            "impact",
            "origin",
            "asset",
            "column_name",
            (self._minute() - F.col("at_minute")).alias("offset_minutes"),
        ]
        if not (self.with_via if via is None else via):
            return named.select(*reached)
        sources = self.nodes.select(F.col("node").alias("via_node"), F.col("asset").alias("via"), F.col("column_name").alias("via_column"))
        named = named.withColumn("via_node", F.col("due").bitwiseAND(F.lit((1 << 32) - 1)))
        return named.join(sources.hint("shuffle_hash"), "via_node").select(*reached, "via", "via_column")

    def events(self) -> DataFrame:
        """As :func:`events`, scenario and asset by number, and ``node``: an asset and how it fails."""
        nodes = self.nodes.where(F.col("column_name") == "").select("node", "impact", F.col("place").alias("asset"))
        runs = self.runs.select("run", F.col("turn").alias("scenario"), "at_minute")
        broken = self._found(True).join(nodes.hint("shuffle_hash"), "node").join(runs.hint("shuffle_hash"), "run")
        offset = self._minute() - F.col("at_minute")
        return broken.select("scenario", "impact", "asset", "node", offset.alias("offset_minutes"))

    def names(self, column: str) -> DataFrame:
        """(name, number) of all scenarios, or of all assets."""
        of, each, number = (self.runs, "run", "turn") if column == "scenario" else (self.nodes, "node", "place")
        return of.where(F.col(each) == F.col(number)).select(F.col(column).alias("name"), F.col(number).alias("number"))


def by_number(rows: DataFrame, column: str, names: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the numbers (name, number) of what ``column`` names."""
    numbers = names.select(F.col("name").alias(column), F.col("number").alias("_number"))
    joined = rows.join(numbers, column, how)
    return joined.select(*[F.col("_number").alias(c) if c == column else F.col(c) for c in rows.columns])


def by_name(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """The way back: ``rows`` with what the numbers in ``column`` stand for."""
    turned = names.select(F.col("number").alias("name"), F.col("name").alias("number")).hint("shuffle_hash")
    return by_number(rows, column, turned, "left")


def with_more(names: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """``names`` (name, number), and numbers below nought for what only ``column`` of ``rows`` names."""
    found = rows.select(F.col(column).alias("name")).where(F.col(column).isNotNull()).distinct()
    more = numbered(found.join(names, "name", "left_anti"), "number", "names")
    return names.unionByName(more.withColumn("number", -1 - F.col("number")))


def spread_out(g: Graph, faults: DataFrame, with_via: bool = True) -> Damage:
    """Earliest break of every asset and column in every scenario; see :func:`propagate`."""
    wave = first_wave(g, faults)
    wave = pin(wave.where((F.col("impact") != UNAVAILABLE) | (F.col("column_name") == "")), "wave")
    impacts = [r[0] for r in wave.select("impact").distinct().collect()]
    steps = pin(moves(g).where(F.col("impact").isin(impacts)), "steps")
    node = ["impact", "asset", "column_name"]
    source = steps.select(
        "impact", F.col("source").alias("asset"), F.col("source_column").alias("column_name")
    )
    target = steps.select(
        "impact", F.col("target").alias("asset"), F.col("target_column").alias("column_name")
    )
    home = wave.select("impact", F.col("origin").alias("asset"), F.lit("").alias("column_name"))
    names = source.unionByName(target).unionByName(wave.select(*node)).unionByName(home).distinct()
    # Numbered in the order of their names, so that the least number among sources is the first by name.
    nodes = in_order(names, [], [F.col("asset"), F.col("column_name"), F.col("impact")], "node")
    is_column = F.when(F.col("column_name") == "", 0).otherwise(1)
    nodes = pin(nodes.withColumn("node", F.shiftleft("node", 1) + is_column), "nodes")
    first = nodes.groupBy("asset").agg(F.min("node").alias("place"))
    nodes = pin(nodes.join(first, "asset"), "nodes")
    runs = numbered(wave.select("scenario", "impact", "origin", "at_minute"), "run", "runs")
    runs = pin(runs.join(runs.groupBy("scenario").agg(F.min("run").alias("turn")), "scenario"), "runs")
    how = g.assets.select(
        "asset",
        on_read(F.col("kind"), F.col("materialization")).alias("on_read"),
        clock_of(F.col("refresh_cadence")).alias("clock"),
    )
    known = pin(nodes.join(how, "asset"), "nodes")
    # The origin's own node, once per run, so that damage is never led back into it.
    homes = runs.join(first.select(F.col("asset").alias("origin"), F.col("place").alias("home")), "origin", "left")
    homes = pin(homes.select("run", F.coalesce("home", F.lit(-1)).alias("home")), "homes")
    ends = known.select(
        *[F.col(c).alias({"asset": "target", "column_name": "target_column"}.get(c, c)) for c in node],
        "node", "place", "on_read", "clock",
    )
    starts = known.select(
        "impact",
        F.col("asset").alias("source"),
        F.col("column_name").alias("source_column"),
        F.col("node").alias("from_node"),
        F.col("place").alias("from_place"),
    ).distinct()
    links = pin(
        steps.join(starts, ["impact", "source", "source_column"])
        .join(ends, ["impact", "target", "target_column"])
        .select("from_node", "node", "from_place", "place", "on_read", "clock"),
        "links",
    )

    def breaks(minute: Column) -> Column:
        return F.when(F.col("on_read"), minute).otherwise(at_clock(F.col("clock"), minute))

    def packed(minute: Column, via: Column) -> Column:
        """The minute, then the number of the source: the least is the earliest, and of its sources the first by name."""
        return (F.shiftleft(minute.cast("bigint"), 32) + via if with_via else minute).alias("due")

    minute = F.shiftright("due", 32).cast("int") if with_via else F.col("due")
    own = nodes.where(F.col("column_name") == "").select("impact", F.col("asset").alias("origin"), F.col("node").alias("via"))
    start = (
        wave.join(runs, ["scenario", "impact", "origin", "at_minute"])
        .join(own, ["impact", "origin"])
        .join(known, node)
        .select("run", "node", "place", packed(breaks(F.col("at_minute")), F.col("via")))
    )
    onward = packed(breaks(minute), F.col("from_node"))

    def rounds(came: DataFrame, inside: DataFrame) -> DataFrame:
        """Damage may be led back only where there are cycles, so only there the origin is looked at."""
        places = known.select("node", "place").distinct()
        back = earliest(came.join(homes, "run"), inside.join(places, "node"), ["run", "home"], onward, F.col("place") != F.col("home"))
        return back.drop("home")

    places = ("from_place", "place")
    order = place_levels(links, places)
    found = by_level(start, links, ["run"], F.min("due").alias("due"), onward, rounds, places, order)
    core = None if order[1] is None else order[0].where(F.col("level") == order[1]).select(F.col("node").alias("place"))
    return Damage(found, nodes, runs, with_via, core)


def propagate(g: Graph, faults: DataFrame, with_via: bool = True) -> DataFrame:
    """Earliest break of every asset and column in every scenario, in minutes after the fault.

    ``faults`` has scenario, kind, origin, column_name and at_minute (of the first day). Rows
    with a blank ``column_name`` are the assets' own break times. ``via`` names the first, by
    name, of the places from which the damage arrived at that very minute.
    """
    return spread_out(g, faults, with_via).named()


def events(reached: DataFrame) -> DataFrame:
    """One row per scenario and broken asset."""
    return reached.where(F.col("column_name") == "").drop("column_name", "via_column")


# ------------------------------------------------------------------ paging


def severity(g: Graph) -> DataFrame:
    """How urgent each asset's failure is: its tier, and whether something people read hangs on it."""
    weights = F.create_map(*[F.lit(x) for pair in TIER_WEIGHT.items() for x in pair])
    read = (
        g.edges.join(
            g.assets.where(F.col("kind") != DATASET).select(F.col("asset").alias("target")),
            "target",
            "left_semi",
        )
        .select(F.col("source").alias("asset"))
        .distinct()
        .withColumn("read", F.lit(CONSUMER_BONUS))
    )
    base = F.coalesce(F.try_element_at(weights, F.lower("tier")), F.lit(UNTIERED_WEIGHT))
    return g.assets.join(read, "asset", "left").select(
        "asset", (base + F.coalesce("read", F.lit(0))).alias("severity")
    )


def present_owners(g: Graph, departed: str | None = None) -> DataFrame:
    owners = g.owners.distinct()
    return owners.where(F.col("owner") != departed) if departed else owners


def paging(g: Graph, broken: DataFrame, departed: str | None = None, damage: Damage | None = None) -> DataFrame:
    """One page per scenario and owner: the first thing of theirs to fail, and the set of all that fails, by name.

    With ``damage``, ``broken`` has its numbers; of the first thing the page then has the ``node``.
    """
    called = present_owners(g, departed).join(severity(g), "asset").withColumn("named", F.col("asset"))
    if damage is None:
        first = F.min(F.struct("offset_minutes", "asset", "impact")).alias("first")
        of = ["first.offset_minutes", F.col("first.asset").alias("first_asset"), "first.impact"]
    else:
        called = by_number(called, "asset", damage.names("asset"))
        # Nodes are in the order of asset and impact, so this is the least of the three; a number needs no sorting.
        first = F.min(F.shiftleft(F.col("offset_minutes").cast("bigint"), 32) + F.col("node")).alias("first")
        of = [F.shiftright("first", 32).cast("int").alias("offset_minutes"), F.col("first").bitwiseAND(F.lit((1 << 32) - 1)).alias("node")]
    calls = broken.join(called, "asset")
    # Readers that do not ask for the set of assets do not collect it.
    whole = F.sort_array(F.collect_set("named")).alias("assets")
    pages = calls.groupBy("scenario", "owner").agg(first, F.count("*").alias("asset_count"), F.max("severity").alias("severity"), whole)
    return pages.select("scenario", "owner", *of, "asset_count", "severity", "assets")


def named_pages(pages: DataFrame, damage: Damage) -> DataFrame:
    """Pages by number, named."""
    first = damage.nodes.select("node", F.col("asset").alias("first_asset"), "impact")
    named = by_name(pages, "scenario", damage.names("scenario")).join(first.hint("shuffle_hash"), "node")
    return named.select("scenario", "owner", "offset_minutes", "first_asset", "impact", "asset_count", "severity", "assets")


def unowned(g: Graph, broken: DataFrame, departed: str | None = None, damage: Damage | None = None) -> DataFrame:
    """Broken assets that page nobody; with ``damage``, ``broken`` has its numbers."""
    owned = present_owners(g, departed).select("asset")
    if damage is None:
        return broken.join(owned, "asset", "left_anti").select("scenario", "asset")
    alone = damage.names("asset").join(owned.withColumnRenamed("asset", "name"), "name", "left_anti")
    return broken.join(alone.select(F.col("number").alias("asset")), "asset", "left_semi").select("scenario", "asset")


def load(pages: DataFrame, orphans: DataFrame) -> DataFrame:
    """Per scenario: how many are paged, the most loaded of them, and what pages nobody.

    Among equally loaded owners the heaviest is the one paged first.
    """
    turn = F.struct(
        (-F.col("asset_count")).alias("n"),
        "offset_minutes",
        (-F.col("severity")).alias("s"),
        "owner",
    )
    people = pages.groupBy("scenario").agg(
        F.count("*").alias("owners_paged"), F.min(turn).alias("top")
    )
    alone = orphans.groupBy("scenario").agg(F.count("*").alias("unowned_assets"))
    return people.join(alone, "scenario", "full").select(
        "scenario",
        F.coalesce("owners_paged", F.lit(0)).alias("owners_paged"),
        F.col("top.owner").alias("heaviest"),
        (-F.col("top.n")).alias("heaviest_assets"),
        F.coalesce("unowned_assets", F.lit(0)).alias("unowned_assets"),
    )


def page_order(pages: DataFrame) -> DataFrame:
    """``page_no`` per scenario, by minutes, then severity from the top, then owner."""
    turn = [F.asc("offset_minutes"), F.desc("severity"), F.asc("owner")]
    return in_order(pages, ["scenario"], turn, "page_no")


def refused(g: Graph, faults: DataFrame) -> DataFrame:
    """Scenarios that cannot be run, and why; an empty result means all of them can.

    A fault on an asset the estate does not know would otherwise look as if nothing broke.
    """
    here = g.assets.select(F.col("asset").alias("origin")).withColumn("here", F.lit(True))
    column = g.columns.select(F.col("asset").alias("origin"), "column_name").distinct()
    known = faults.join(F.broadcast(kinds(faults.sparkSession)), "kind", "left")
    checked = known.join(here, "origin", "left").join(
        column.withColumn("has_column", F.lit(True)), ["origin", "column_name"], "left"
    )
    reason = (
        F.when(F.col("impact").isNull(), "unknown kind of fault")
        .when(F.col("here").isNull(), "unknown asset")
        .when(F.col("needs_column") & F.col("column_name").isNull(), "needs a column")
        .when(F.col("column_name").isNotNull() & F.col("has_column").isNull(), "unknown column")
    )
    return checked.select("scenario", reason.alias("reason")).where(F.col("reason").isNotNull())
