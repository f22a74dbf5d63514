"""Grade what was predicted against what was observed, inside a declared scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def verdicts(predicted: DataFrame, observed: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key predicted or observed, with how it is graded.

    ``scope`` has some of the keys, such as the asset alone when every scenario shares it. Outside the scope a prediction is ungraded and an observation is left out.
    """
    said = predicted.select(*keys).distinct().withColumn("said", F.lit(True))
    seen = observed.select(*keys).distinct().withColumn("seen", F.lit(True))
    inside = scope.distinct().withColumn("inside", F.lit(True))
    both = said.join(seen, keys, "full").join(inside, scope.columns, "left")
    verdict = (
        F.when(F.col("inside").isNull(), F.when(F.col("said"), F.lit("ungraded")))
        .when(F.col("said") & F.col("seen"), "hit")
        .when(F.col("said"), "false_alarm")
        .otherwise("miss")
    )
    return both.select(*keys, verdict.alias("verdict")).where(F.col("verdict").isNotNull())


def _n(verdict: str) -> Column:
    return F.count_if(F.col("verdict") == verdict)


def scorecard(graded: DataFrame, by: list[str]) -> DataFrame:
    """Counts, precision and recall per group; null where nothing was predicted or nothing broke.

    Both perfect, with something observed, is reported as suspicious rather than as success.
    """
    cards = graded.groupBy(*by).agg(
        _n("hit").alias("hits"),
        _n("false_alarm").alias("false_alarms"),
        _n("miss").alias("misses"),
        _n("ungraded").alias("ungraded"),
    )
    hits = F.col("hits")
    return cards.withColumns(
        {
            "precision": ratio(hits, hits + F.col("false_alarms")),
            "recall": ratio(hits, hits + F.col("misses")),
            "suspicious": (hits > 0) & (F.col("false_alarms") == 0) & (F.col("misses") == 0),
        }
    )


def ungraded_by_kind(graded: DataFrame, assets: DataFrame) -> DataFrame:
    """Predictions nobody could check, by the kind of asset they are about."""
    return (
        graded.where(F.col("verdict") == "ungraded")
        .join(assets.select("asset", "kind"), "asset")
        .groupBy("kind")
        .agg(F.count("*").alias("predictions"))
    )
