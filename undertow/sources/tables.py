"""Typed scans of the landed parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .contracts import check_contract

# Column types of the landed tables, as written by their producer.
LANDED = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def landed_schema(name: str) -> StructType:
    return StructType.fromDDL(LANDED[name])


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one landed table; a column that is absent or of another type than declared stops the read.

    The schema is that of the files (one footer is read), held against the declared one. Columns
    that are not declared are left out.
    """
    declared = landed_schema(name)
    found = spark.read.parquet(f"{root}/{name}.parquet")
    return check_contract(found, declared).select(declared.names)
