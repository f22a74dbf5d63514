"""Numbering and looking back in an order, without putting a whole group into one task.

A window over a key puts all rows of that key into one task. Here the rows are range
partitioned by key and order, so a key that holds most of the rows spans many slices; each
slice works alone, and only one row per slice and key is passed on between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pin


def _sliced(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` range partitioned and written out, each row with the number of its slice."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c) for c in by], *order)
    return pin(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def _same(left: str, right: str, columns: list[str]) -> Column:
    same = F.col(f"{left}._slice") == F.col(f"{right}._slice")
    for c in columns:
        same = same & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def numbered(df: DataFrame, by: list[str], order: list[Column], alias: str) -> DataFrame:
    """Rows numbered from one in ``order`` within each ``by`` group (or overall, if ``by`` is empty).

    ``order`` must leave no ties.
    """
    rows = _sliced(df, by, order)
    sizes = rows.groupBy("_slice", *by).agg(F.count("*").alias("_n"))
    # One row per slice and group: a group's row is here at most once per slice.
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_slice")) - F.col("_n")
    sizes = sizes.select("_slice", *by, earlier.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_slice", *by).orderBy(*order))
    return (
        rows.withColumn("_place", place)
        .alias("r")
        .join(sizes.alias("s"), _same("r", "s", by))
        .select("r.*", "s._before")
        .withColumn(alias, (F.col("_before") + F.col("_place")).cast("bigint"))
        .drop("_slice", "_place", "_before")
    )


def previous(df: DataFrame, by: list[str], order: list[Column], column: str, alias: str) -> DataFrame:
    """``column`` of the row before, within each ``by`` group; null for the first row."""
    rows = _sliced(df, by, order)
    here = Window.partitionBy("_slice", *by).orderBy(*order)
    rows = rows.withColumn("_place", F.row_number().over(here)).withColumn(
        "_prior", F.lag(column).over(here)
    )
    ends = rows.groupBy("_slice", *by).agg(F.max_by(column, "_place").alias("_end"))
    handed = F.lag("_end").over(Window.partitionBy(*by).orderBy("_slice"))
    ends = ends.select("_slice", *by, handed.alias("_handed"))
    return (
        rows.alias("r")
        .join(ends.alias("e"), _same("r", "e", by))
        .select("r.*", "e._handed")
        .withColumn(alias, F.when(F.col("_place") == 1, F.col("_handed")).otherwise(F.col("_prior")))
        .drop("_slice", "_place", "_prior", "_handed")
    )


def running_max(df: DataFrame, by: list[str], order: list[Column], column: str, alias: str) -> DataFrame:
    """The greatest ``column`` so far, this row included, within each ``by`` group; nulls are passed over."""
    rows = _sliced(df, by, order)
    here = Window.partitionBy("_slice", *by).orderBy(*order)
    here = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_so_far", F.max(column).over(here))
    ends = rows.groupBy("_slice", *by).agg(F.max(column).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_slice", *by, F.max("_end").over(before).alias("_handed"))
    return (
        rows.alias("r")
        .join(ends.alias("e"), _same("r", "e", by))
        .select("r.*", "e._handed")
        .withColumn(alias, F.array_max(F.array("_so_far", "_handed")))
        .drop("_slice", "_so_far", "_handed")
    )
