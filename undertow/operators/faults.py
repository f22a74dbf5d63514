"""The faulted copy of a table that each kind of fault leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import CharType, StringType, VarcharType


class FaultNotExecutable(ValueError):
    """The fault cannot be applied to this table."""


def _require(df: DataFrame, column: str | None) -> str:
    if column not in df.columns:
        raise FaultNotExecutable(f"no column {column!r} among {', '.join(df.columns)}")
    return column


def drop_column(df: DataFrame, column: str) -> DataFrame:
    _require(df, column)
    if len(df.columns) == 1:
        raise FaultNotExecutable(f"{column} is the only column")
    return df.drop(column)


def change_column_type(df: DataFrame, column: str) -> DataFrame:
    """``df`` with one column cast to string; a string column is refused."""
    if isinstance(df.schema[_require(df, column)].dataType, (StringType, CharType, VarcharType)):
        raise FaultNotExecutable(f"{column} is text already")
    return df.withColumn(column, F.col(column).cast("string"))


def null_out_column(df: DataFrame, column: str) -> DataFrame:
    kind = df.schema[_require(df, column)].dataType
    return df.withColumn(column, F.lit(None).cast(kind))


def stop_new_rows(df: DataFrame, column: str, days: int) -> DataFrame:
    """Without the most recent days, counted back from the newest row; undated rows go too.

    The newest date is a scalar subquery, so the filter is an ordinary one on the scan.
    """
    newest = df.agg(F.max(_require(df, column))).scalar()
    return df.where(F.col(column) <= newest - F.expr(f"interval {int(days)} days"))


def faulted(df: DataFrame, kind: str, column: str | None = None, days: int = 1) -> DataFrame | None:
    """The copy that ``kind`` leaves, or ``None`` where nothing is left."""
    if kind == "drop_asset":
        return None
    if kind == "drop_column":
        return drop_column(df, column)
    if kind == "change_column_type":
        return change_column_type(df, column)
    if kind == "null_out_column":
        return null_out_column(df, column)
    if kind == "stop_new_rows":
        return stop_new_rows(df, column, days)
    raise FaultNotExecutable(f"no fault is called {kind!r}")
