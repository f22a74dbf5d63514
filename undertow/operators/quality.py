"""Data tests on tables, and checks on the estate as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.summaries import contents
from ..plans.warehouse import Check, Model
from .lineage import DATASET, Graph


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; missing values are never duplicates."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("key"))
        .agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def unaccepted(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose value is outside the list; a missing value passes."""
    return df.where(~F.col(column).isin(*values))


def failures(df: DataFrame, check: Check) -> DataFrame:
    """The number of failures of one check, as one row."""
    if check.kind == "unique":
        return duplicates(df, check.column).agg(F.count("*").alias("failures"))
    return df.agg(_failing(check).alias("failures"))


def _failing(check: Check) -> Column:
    """How many rows fail a check that looks at one row at a time."""
    value = F.col(check.column)
    return F.count_if(value.isNull() if check.kind == "not_null" else ~value.isin(*check.values))


def report(tables: dict[str, DataFrame], models: list[Model], kind: str) -> DataFrame:
    """One row per check of ``kind`` declared on ``models``; other models are not looked at.

    Row checks of a model share one pass over it. Unique checks of all models share one exchange:
    every value becomes a row of its check and its text, which tells values of one column
    apart, and is counted where it was read before it moves. Only the columns
    checked are read, so what the models compute besides falls away.
    """
    tested = [(m, [c for c in m.checks if c.kind == kind]) for m in models]
    tested = [(m, checks) for m, checks in tested if checks]
    if kind == "unique":
        return _unique(tables, tested)
    parts = []
    for m, checks in tested:
        pairs = [F.struct(F.lit(c.column).alias("column_name"), F.col(c.column).alias("failures")) for c in checks]
        counts = [_failing(c).alias(c.column) for c in checks]
        parts.append(tables[m.name].agg(*counts).select(F.lit(m.name).alias("model"), F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, parts)


def _unique(tables: dict[str, DataFrame], tested: list[tuple[Model, list[Check]]]) -> DataFrame:
    names = [(m.name, c.column) for m, checks in tested for c in checks]
    number = {name: i for i, name in enumerate(names)}
    parts = []
    for m, checks in tested:
        values = [F.struct(F.lit(number[m.name, c.column]).alias("check"), F.col(c.column).cast("string").alias("key")) for c in checks]
        parts.append(tables[m.name].select(F.inline(F.array(*values))))
    rows = reduce(DataFrame.union, parts).where("key is not null")
    seen = rows.groupBy("check", "key").agg(F.count("*").alias("n")).where("n > 1")
    found = seen.groupBy("check").agg(F.count("*").alias("failures"))
    pairs = [F.struct(F.lit(i).alias("check"), F.lit(a).alias("model"), F.lit(b).alias("column_name")) for i, (a, b) in enumerate(names)]
    every = rows.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    return every.join(found, "check", "left").select("model", "column_name", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"))


def expectation(name: str, observed: DataFrame, least: float, most: float | None = None) -> DataFrame:
    """One expectation: ``observed`` is one row with one number that must lie in the range."""
    value = F.col(observed.columns[0]).cast("double")
    fits = (value >= least) & (F.lit(True) if most is None else value <= most)
    return observed.select(
        F.lit(name).alias("expectation"),
        value.alias("share"),
        F.coalesce(fits, F.lit(False)).alias("passed"),
    )


def expectations(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def ownership(g: Graph) -> DataFrame:
    """Datasets per owner, and those with none, as shares of all datasets."""
    datasets = g.assets.where(F.col("kind") == DATASET).select("asset")
    total = datasets.agg(F.count("*")).scalar()
    named = datasets.join(g.owners.distinct(), "asset", "left")
    return named.groupBy(F.coalesce("owner", F.lit("(no owner)")).alias("owner")).agg(
        F.count("*").alias("datasets")
    ).withColumn("share", F.col("datasets") / total)


def coverage(g: Graph, used: DataFrame, recovery: DataFrame) -> DataFrame:
    """How much of the estate carries the metadata each score component needs.

    ``recovery`` says per asset whether anything beneath it declares replication.
    """
    owned = g.owners.select("asset").distinct().withColumn("owned", F.lit(1.0))
    busy = used.select("asset").withColumn("busy", F.lit(1.0))
    known = recovery.select(F.col("origin").alias("asset"), F.col("recovery_known").cast("double").alias("known"))
    datasets = g.assets.where(F.col("kind") == DATASET)
    for side in (owned, busy, known):
        datasets = datasets.join(side, "asset", "left")
    zero = F.lit(0.0)
    shares = {
        "replication": F.avg(F.coalesce("known", zero)),
        "usage": F.avg(F.coalesce("busy", zero)),
        "ownership": F.avg(F.coalesce("owned", zero)),
        "tiers": F.avg(F.col("tier").isNotNull().cast("double")),
    }
    one = datasets.agg(*[v.alias(k) for k, v in shares.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metadata"), F.col(k).alias("share")) for k in shares])
    return one.select(F.inline(pairs))


def model_path(features: DataFrame, models: DataFrame) -> DataFrame:
    """Feature tables whose features feed a deployed model.

    ``features`` has feature_table and feature; ``models`` has model, feature and deployment.
    One row per feature table, model and deployment that share a feature; none if broken.
    """
    return (
        features.join(models.where(F.col("deployment").isNotNull()), "feature")
        .groupBy("feature_table", "model", "deployment")
        .agg(F.min("feature").alias("feature"))
    )


def appended_once(ledger: DataFrame, run_id: str) -> DataFrame:
    """Rows one run added per target, and whether that was exactly one."""
    return (
        ledger.where(F.col("run_id") == run_id)
        .groupBy("target")
        .agg(F.count("*").alias("rows_added"))
        .withColumn("once", F.col("rows_added") == 1)
    )


def replays(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two runs over the same inputs gave the same rows, as one row."""
    again = contents(second).select(
        F.col("row_count").alias("rows_again"), F.col("checksum").alias("sum_again")
    )
    count, total = (again.select(c).scalar() for c in again.columns)
    return contents(first).select(
        "row_count",
        ((F.col("row_count") == count) & (F.col("checksum") == total)).alias("same"),
    )
