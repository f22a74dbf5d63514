"""Level by level: the same results as rounds, and no round where no way leads back."""

import random

from pyspark.sql import functions as F

from test_spread import shortest
from undertow.operators import spread


def swept(spark, edges, starts, monkeypatch):
    """What is found, and the nodes that rounds were asked to follow."""
    moves = spark.createDataFrame(edges, "from_node bigint, node bigint, minutes int")
    start = spark.createDataFrame(starts, "who bigint, node bigint, due int")
    further, inside = F.col("due") + F.col("minutes"), set()

    def rounds(came, links):
        inside.update(r[0] for r in links.select("node").collect())
        return spread.earliest(came, links, ["who"], further)

    found = spread.by_level(start, moves, ["who"], F.min("due").alias("due"), further.alias("due"), rounds)
    return sorted((tuple(r) for r in found.collect()), key=repr), inside


def test_without_cycles_nothing_known_is_compared(spark, monkeypatch):
    """Detours that are shorter in minutes than in steps, ties, nodes on no edge: each row is found once."""
    random.seed(5)
    edges = sorted({(a, a + random.randrange(1, 4), random.choice([0, 1, 5, 60])) for a in (random.randrange(9) for _ in range(30))})
    starts = [(0, 0, 3), (0, 4, 1), (1, 2, 0), (2, 77, 9), (2, 77, 8)]
    got, inside = swept(spark, edges, starts, monkeypatch)
    assert got == sorted(shortest(edges, starts), key=repr) and not inside


def test_only_cycles_and_what_lies_between_them_are_followed_by_rounds(spark, monkeypatch):
    chain = [(0, 1, 5), (1, 2, 1), (2, 3, 1), (3, 2, 1), (3, 4, 7), (4, 5, 0), (5, 5, 1), (5, 6, 2), (6, 7, 1), (1, 7, 90), (0, 6, 3)]
    starts = [(0, 0, 0), (1, 3, 2), (2, 6, 1)]
    got, inside = swept(spark, chain, starts, monkeypatch)
    assert got == sorted(shortest(chain, starts), key=repr) and inside == {2, 3, 4, 5}
    monkeypatch.setattr(spread, "LEVELS", 1)
    capped, more = swept(spark, chain, starts, monkeypatch)
    assert capped == got and inside < more


def test_levels_begin_where_most_edges_go(spark, monkeypatch):
    """A tree that fans out is taken off from its leaves: all rounds together write fewer edges than there are."""
    written, pin = [], spread.pin

    def watched(df, label="round", compression=None):
        done = pin(df, label, compression)
        written.extend([done.count()] if label == "peeled" else [])
        return done

    monkeypatch.setattr(spread, "pin", watched)
    tree = [(n, c) for n in range(63) for c in (2 * n + 1, 2 * n + 2)]
    for edges in (tree, [(b, a) for a, b in tree]):
        written.clear()
        order, core, last = spread.levels(spark.createDataFrame(edges, "from_node bigint, node bigint"))
        level = {r["node"]: r["level"] for r in order.collect()}
        assert core is None and last == 6 and all(level.get(a, 0) < level[b] <= last for a, b in edges)
        assert sum(written) < len(edges), written


def test_levels_of_any_graph_lead_upwards(spark):
    """From either side: edges outside the cycles rise, those within them stay."""
    random.seed(11)
    edges = [(random.randrange(9), random.randrange(30)) for _ in range(24)] + [(3, 3), (4, 5), (5, 4), (40, 4), (5, 41)]
    for pairs in (edges, [(b, a) for a, b in edges]):
        order, core, last = spread.levels(spark.createDataFrame(sorted(set(pairs)), "from_node bigint, node bigint"))
        level = {r["node"]: r["level"] for r in order.collect()}
        assert max(level.values()) <= last and level[3] == level[4] == level[5] == core
        for a, b in pairs:
            assert level.get(a, 0) < level.get(b, 0) or level.get(a, 0) == level.get(b, 0) == core, (a, b)
