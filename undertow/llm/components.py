"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import pin


def _settle(df: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges written out, with their number and a checksum taken by the same write."""
    seen = Observation()
    watched = df.distinct().observe(
        seen,
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"),
    )
    pinned = pin(watched, "stars")
    return pinned, (seen.get["n"], seen.get["sum"])


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) for every node that has an edge to another: ``v`` is the least node that ``u`` reaches.

    ``edges`` has columns ``u`` and ``v`` of one orderable type; loops and nulls are passed over.
    The alternating large-star and small-star steps of Kiveris et al. (2014): each moves edges
    towards the least neighbour and keeps connectivity, so the edges end as one star per
    component after a number of rounds that grows with the logarithm of its size. A round is two
    joins of the edges with one minimum per node, written to the checkpoint folder: an executor
    that is lost costs one round, and no component is ever gathered in one place. The centre of a
    large star is the skewed side of these joins, which the adaptive skew join splits.
    """
    clean = edges.where("u is not null and v is not null and u <> v")
    held, mark = _settle(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while mark[0]:
        # Large star: neighbours above a node are handed to the least of its neighbourhood.
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = pin(large.distinct(), "stars")
        # Small star: a node and its smaller neighbours are handed to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        small = small.select("e.u", "e.v").where("u <> v")
        held, now = _settle(small)
        if now == mark:
            break
        mark = now
    return held


def labelled(nodes: DataFrame, node: str, edges: DataFrame, label: str) -> DataFrame:
    """``nodes`` with the least node each reaches in the column ``label``; itself where it has no edge."""
    ends = stars(edges).select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    joined = nodes.join(ends, F.col(node) == F.col("_u"), "left")
    return joined.withColumn(label, F.coalesce("_v", node)).drop("_u", "_v")
