"""Earliest arrival over a graph, for every origin at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import checkpoint_root, pin

#: Levels taken off a graph from either side. What is left, cycles included, is followed by rounds.
LEVELS = 256


def numbered(names: DataFrame, alias: str, label: str = "ids") -> DataFrame:
    """Distinct names with a 64-bit number each, written out so that the numbers never change.

    The rounds below then exchange numbers instead of names.
    """
    return pin(names.distinct().withColumn(alias, F.monotonically_increasing_id()), label)


class Buckets:
    """A table in the checkpoint folder that is bucketed by a key and grows by rounds.

    All rounds lie in one folder and are read by one scan. A join or an aggregate on the key finds
    the rows where they are, so only the other side is exchanged. The catalog entry lasts as long
    as the ``with`` block; files stay in the folder until its own cleanup.
    """

    def __init__(self, like: DataFrame, keys: list[str], label: str) -> None:
        self.spark, self.keys = like.sparkSession, keys
        self.name = f"{label}_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_root(self.spark)}/{self.name}"
        self.count = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.rounds = 0

    def __enter__(self) -> Buckets:
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, rows: DataFrame) -> int:
        """One more round, and the number of its rows, counted by the write."""
        seen = Observation()
        watched = rows.withColumn("round", F.lit(self.rounds)).observe(seen, F.count("*").alias("n"))
        writer = watched.write.format("parquet").option("path", self.path).partitionBy("round")
        writer.bucketBy(self.count, *self.keys).mode("append").saveAsTable(self.name)
        self.rounds += 1
        return seen.get["n"]

    def all(self) -> DataFrame:
        return self.spark.table(self.name).drop("round")

    def newest(self) -> DataFrame:
        """The rows of the last round: a scan of its files only."""
        return self.spark.table(self.name).where(F.col("round") == self.rounds - 1).drop("round")


def earliest(
    start: DataFrame, moves: DataFrame, who: list[str], arrival: Column, keep: Column | None = None
) -> DataFrame:
    """Least ``due`` at which each ``who`` reaches each ``node``.

    ``start`` has the who columns, ``node`` and ``due``, none of them null; ``moves`` has
    ``from_node``, ``node`` and whatever ``arrival`` and ``keep`` read. Each round follows only what
    became earlier in the round before, keeps the least per node, and stops when nothing does.
    Arrivals never precede departures, so cycles end by themselves.

    What is known is a table bucketed by (who, node), the moves one bucketed by where they start.
    A round exchanges its departures and its arrivals and nothing else: what is settled is read where it
    lies, by one scan however many rounds there were, and is neither shuffled nor written again. The
    write also counts what moved, so asking whether to go on costs no second job; a lost executor
    costs at most one round.
    """
    keys = [*who, "node"]
    with Buckets(moves, ["from_node"], "moves") as links, Buckets(start, keys, "spread") as known:
        links.add(moves.repartition(links.count, "from_node"))
        n = known.add(start.groupBy(*keys).agg(F.min("due").alias("due")))
        while n:
            n = known.add(_round(known, links, who, arrival, keep))
        return pin(known.all().groupBy(*keys).agg(F.min("due").alias("due")), "spread")


def _round(known: Buckets, links: Buckets, who: list[str], arrival: Column, keep: Column | None) -> DataFrame:
    """What the newest of ``known`` reaches earlier than anything known does."""
    keys = [*who, "node"]
    here = known.newest().select(*who, F.col("node").alias("from_node"), "due")
    arrived = here.join(links.all(), "from_node")
    if keep is not None:
        arrived = arrived.where(keep)
    arrived = arrived.select(*keys, arrival.alias("due")).groupBy(*keys).agg(F.min("due").alias("due"))
    before = known.all().withColumnRenamed("due", "_due")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return arrived.alias("a").join(before.alias("b"), [*same, F.col("_due") <= F.col("due")], "left_anti")


def reached(start: DataFrame, moves: DataFrame) -> DataFrame:
    """Which origins reach each node, 64 of them a row: (word, node, bits).

    ``start`` has (word, node, bits): the origins of a word, a bit each, that are at a node from the
    beginning; ``moves`` has (from_node, node). A round hands on only the bits that are new to a node, and keeps
    what is known in buckets as :func:`earliest` does, so origins that reach the same nodes travel together.
    """
    keys = ["word", "node"]
    with Buckets(moves, ["from_node"], "moves") as links, Buckets(start, keys, "bits") as known:
        links.add(moves.select("from_node", "node").repartition(links.count, "from_node"))
        n = known.add(start.groupBy(*keys).agg(F.bit_or("bits").alias("bits")))
        while n:
            n = known.add(_wider(known, links))
        return pin(known.all().groupBy(*keys).agg(F.bit_or("bits").alias("bits")), "bits")


def _wider(known: Buckets, links: Buckets) -> DataFrame:
    """The bits that the newest of ``known`` brings to nodes that did not have them."""
    here = known.newest().select("word", F.col("node").alias("from_node"), "bits")
    arrived = here.join(links.all(), "from_node").groupBy("word", "node").agg(F.bit_or("bits").alias("bits"))
    before = known.all().groupBy("word", "node").agg(F.bit_or("bits").alias("_had"))
    new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_had", F.lit(0).cast("bigint"))))
    joined = arrived.join(before, ["word", "node"], "left")
    return joined.select("word", "node", new.alias("bits")).where("bits <> 0")


# ------------------------------------------------------------------ level by level


def _peel(edges: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame, int]:
    """Longest ways: (node, level) of all that has an edge behind it, what no level holds, and the last level.

    An edge stays for as long as something leads to its source, so a node's level is one more than the last round in
    which something led to it. On and behind a cycle this never ends: such nodes have the level -1, and the edges
    between them are returned.
    """
    left, held, peeled = edges, _count(edges), []
    while held and len(peeled) < LEVELS:
        ends = left.select(F.col(target).alias("node")).distinct()
        peeled.append(ends.withColumn("level", F.lit(len(peeled) + 1)))
        left = pin(left.join(ends.withColumnRenamed("node", source), source, "left_semi"), "peeled")
        before, held = held, _count(left)
        if held == before:
            break
    last = len(peeled)
    if held:
        peeled[-1] = peeled[-1].withColumn("level", F.lit(LEVELS + 1))
    names = edges.select(F.col(target).alias("node"), F.lit(0).alias("level")).limit(0)
    for part in peeled:
        names = names.union(part)
    names = names.groupBy("node").agg(F.max("level").alias("level"))
    return names.withColumn("level", F.when(F.col("level") > LEVELS, -1).otherwise(F.col("level"))), left, last


def _count(df: DataFrame) -> int:
    return df.agg(F.count("*")).first()[0]


def _sheds_below(edges: DataFrame) -> bool:
    """True if more edges end where nothing goes on than begin where nothing came from."""
    ends = edges.join(edges.select(F.col("from_node").alias("node")).distinct(), "node", "left_anti")
    begins = edges.join(edges.select(F.col("node").alias("from_node")).distinct(), "from_node", "left_anti")
    return _count(ends) > _count(begins)


def levels(edges: DataFrame) -> tuple[DataFrame, int | None, int]:
    """An order in which no edge (from_node, node) leads back: (node, level), the level that holds the cycles, the last one.

    Nodes that are left out have the level 0. First comes what no cycle leads to, by its longest way from above; then, as one
    level, the cycles and what lies between them; then what leads to no cycle, by its longest way to the end. It is the other way
    round, from the end upwards, where more edges go in the first round: an estate that fans out keeps nearly all its edges until the
    last rounds from above, so that every round would write them again.
    """
    if not _sheds_below(edges):
        return _downwards(edges)
    turned, core, last = _downwards(edges.select(F.col("node").alias("from_node"), F.col("from_node").alias("node")))
    order = edges.select("node").distinct().join(turned, "node", "full")
    order = pin(order.select("node", (last - F.coalesce("level", F.lit(0))).alias("level")), "levels")
    return order, None if core is None else last - core, last


def _downwards(edges: DataFrame) -> tuple[DataFrame, int | None, int]:
    """:func:`levels` from above; nodes that nothing leads to are left out."""
    above, left, top = _peel(edges, "from_node", "node")
    above = pin(above, "levels")
    if not _count(left):
        return above, None, top
    below, core, bottom = _peel(left, "node", "from_node")
    turned = F.when(F.col("b.level") == -1, top + 1).otherwise(top + 2 + bottom - F.coalesce("b.level", F.lit(0)))
    level = F.when(F.col("a.level") == -1, turned).otherwise(F.col("a.level"))
    both = above.alias("a").join(below.alias("b"), F.col("a.node") == F.col("b.node"), "left")
    return pin(both.select("a.node", level.alias("level")), "levels"), top + 1 if _count(core) else None, top + 2 + bottom


def place_levels(moves: DataFrame, places: tuple[str, str]) -> tuple[DataFrame, int | None, int]:
    """:func:`levels` of the places that ``moves`` lead from and to."""
    return levels(pin(moves.select(*[F.col(p).alias(n) for p, n in zip(places, ("from_node", "node"))]).distinct(), "places"))


def by_level(
    start: DataFrame, moves: DataFrame, who: list[str], fold: Column, step: Column,
    rounds: Callable[[DataFrame, DataFrame], DataFrame], places: tuple[str, str] = ("from_node", "node"),
    order: tuple[DataFrame, int | None, int] | None = None,
) -> DataFrame:
    """One row per ``who`` and node that is reached: ``fold`` of all that arrives there.

    ``start`` has the who columns, ``node``, the place of the node and the value; ``moves`` has ``from_node``,
    ``node``, both places and what ``step`` reads to make the value that arrives. ``fold`` and ``step`` name the value alike.

    Where no way leads back, a node is final once all nodes of lower levels are: every row is found once,
    sent on once and read once where it arrives, and nothing known is compared with. Only what lies on cycles, or between them, is
    followed until nothing changes: ``rounds`` (start, moves) does that, and returns the who columns, node and value.
    Levels are those of places, :func:`place_levels`, if they are not given as ``order``; moves within a place are a cycle.
    """
    spark = start.sparkSession
    root = f"{checkpoint_root(spark)}/levels-{uuid.uuid4().hex}"
    source, target = places
    order, core, last = order or place_levels(moves, places)

    def placed(df: DataFrame, place: str, alias: str) -> DataFrame:
        known = order.select(F.col("node").alias("_place"), F.col("level").alias("_level"))
        joined = df.join(known, F.col(place) == F.col("_place"), "left").drop("_place")
        return joined.withColumn(alias, F.coalesce("_level", F.lit(0))).drop("_level")

    links = placed(placed(moves, source, "from_level"), target, "level")
    links = links.drop(*{source, target} - {"from_node", "node"})
    links.write.partitionBy("from_level").parquet(f"{root}/links")
    links = spark.read.schema(links.schema).parquet(f"{root}/links")
    sending = {r[0] for r in links.select("from_level").distinct().collect()}
    sent = placed(start, target, "level").drop(*{target} - {"node"})
    columns, schema = sent.columns, sent.schema
    sent.write.partitionBy("level").parquet(f"{root}/sent")
    for level in range(last + 1):
        came = spark.read.schema(schema).parquet(f"{root}/sent").where(F.col("level") == level).drop("level")
        on = links.where(F.col("from_level") == level).drop("from_level")
        if level == core:
            came = rounds(came, on.where(F.col("level") == level).drop("level"))
            on = on.where(F.col("level") != level)
        found = came.groupBy(*who, "node").agg(fold)
        found.write.parquet(f"{root}/found/level={level}")
        found = spark.read.schema(found.schema).parquet(f"{root}/found/level={level}")
        if level in sending:
            here = found.withColumnRenamed("node", "from_node").join(on, "from_node")
            here.select(*who, "node", step, "level").select(*columns).write.partitionBy("level").mode("append").parquet(f"{root}/sent")
    return spark.read.schema(found.withColumn("level", F.lit(0)).schema).parquet(f"{root}/found").drop("level")
