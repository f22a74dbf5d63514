"""Earliest arrival: results on any graph, and what a round exchanges."""

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from undertow.operators import spread


def shortest(edges, starts):
    """Least sum of minutes from each start, by Dijkstra."""
    out = {}
    for who, node, due in starts:
        heap = [(due, node)]
        while heap:
            at, here = heapq.heappop(heap)
            if out.get((who, here), 1 << 60) <= at:
                continue
            out[who, here] = at
            for a, b, minutes in edges:
                if a == here:
                    heapq.heappush(heap, (at + minutes, b))
    return sorted((w, n, d) for (w, n), d in out.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_graph_with_cycles_ties_and_detours(spark, rows, seed):
    random.seed(seed)
    edges = sorted({(random.randrange(25), random.randrange(25), random.choice([0, 1, 5, 60])) for _ in range(70)})
    starts = sorted({(w, random.randrange(25)): (w, random.randrange(25), random.randrange(9)) for w in range(6)}.values())
    moves = spark.createDataFrame([(*e, "x") for e in edges], "from_node bigint, node bigint, minutes int, round string")
    start = spark.createDataFrame(starts, "who bigint, node bigint, due int")
    got = spread.earliest(start, moves, ["who"], F.col("due") + F.col("minutes"))
    assert rows(got) == sorted(shortest(edges, starts), key=repr)


def test_no_start_and_no_moves(spark):
    moves = spark.createDataFrame([], "from_node bigint, node bigint")
    start = spark.createDataFrame([(1, 2, 3)], "who bigint, node bigint, due int")
    assert [tuple(r) for r in spread.earliest(start, moves, ["who"], F.col("due")).collect()] == [(1, 2, 3)]
    assert spread.earliest(start.limit(0), moves, ["who"], F.col("due")).isEmpty()


def shuffled(spark):
    """Bytes written to shuffles so far."""
    jsc = spark.sparkContext._jsc.sc()
    jsc.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    found = jsc.statusStore().stageList(None, False, False, none, None)
    return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))


def exchanges(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[0]
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange ", text)), len(re.findall("FileScan", text))


def test_a_round_moves_only_what_it_found(spark, monkeypatch):
    """On a long chain beside a large settled part, no round exchanges what is known, and no plan grows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moves = spark.range(24).select(F.col("id").alias("from_node"), (F.col("id") + 1).alias("node"))
        settled = spark.range(20_000).select(F.lit(1).cast("bigint").alias("who"), (F.col("id") + 1000).alias("node"), F.lit(0).alias("due"))
        start = settled.union(spark.createDataFrame([(1, 0, 0)], "who bigint, node bigint, due int"))
        seen, plans = [], []
        real = spread._round

        def watched(known, links, *rest):
            df = real(known, links, *rest)
            if known.rounds in (2, 10, 20):
                before = shuffled(spark)
                plans.append(exchanges(df))
                seen.append(shuffled(spark) - before)
            return df

        monkeypatch.setattr(spread, "_round", watched)
        got = spread.earliest(start, moves, ["who"], F.col("due") + 1)
        assert got.count() == 20_025 and got.agg(F.max("due")).first()[0] == 24
        assert len(set(plans)) == 1 and plans[0][1] == 3 and plans[0][0] <= 2, plans
        assert max(seen) < 2_000, seen  # one row moved; 20,000 known ones would be some hundred thousand bytes
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed", [1, 2])
def test_upstream_totals_agree_with_the_closure(spark, rows, seed):
    """More than 64 origins of a value, several ways to a node, cycles, and assets on no edge."""
    from undertow.operators import lineage

    random.seed(seed)
    edges = [(f"a{random.randrange(160)}", f"a{random.randrange(160)}") for _ in range(210)]
    edges = spark.createDataFrame(edges, "source string, target string")
    values = spark.createDataFrame([(f"a{i}", random.choice([0.0, 0.0, 0.0, 0.5, 1.0])) for i in range(0, 170)], "asset string, value double")
    reach = lineage.closure(edges).join(values.withColumnRenamed("asset", "origin"), "origin")
    want = reach.groupBy("asset").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    assert rows(lineage.upstream_totals(edges, values)) == rows(want)
    few = spark.createDataFrame([("a1",), ("a7",), ("none",)], "asset string")
    assert rows(lineage.closure(edges, few)) == rows(lineage.closure(edges).where("origin in ('a1', 'a7')"))
