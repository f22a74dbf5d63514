"""Query registration: the Spark side, the checking SQL, and how the two are made comparable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, TimestampType

from undertow.plans import Warehouse
from undertow.sources.bindings import BINDINGS, DUCKDB_SPELLING, names_in, spell
from undertow.sources.tables import LANDED

from .graph_sql import GRAPH_SQL
from .model_sql import MODEL_SQL

TABLE_SQL = {**BINDINGS, **MODEL_SQL, **GRAPH_SQL}


@dataclass(frozen=True)
class Entry:
    run: Callable[[Warehouse], DataFrame]
    oracle: str | None


ENTRIES: dict[str, Entry] = {}

# Columns holding fractions, by name, in every query that has them. Both engines bring these
# to one grid before the comparison; everything else is compared as it is.
FRACTIONAL = (
    "_f amount amount_usd avg_csat_score avg_daily_amount_usd avg_daily_attempts "
    "avg_days_late avg_days_late_when_late avg_device_trust avg_lifetime_usd "
    "avg_min_device_trust avg_mrr_usd avg_resolution_hours avg_session_seconds "
    "avg_subscriber_lifetime_usd avg_transit_days active_mrr active_mrr_usd account_age_days "
    "attributed_net_usd authorisation_rate avg_authorisation_rate avg_unreconciled_ratio "
    "budget_amount budget_consumed_ratio cart_to_confirm_rate celsius churn_rate "
    "completed_net_amount_usd days_late days_since_last_order decline_rate devices_per_order "
    "discount_amount discount_amount_usd discount_applied discount_applied_local "
    "discount_applied_usd discount_intensity discount_usd discount_value dispute_rate "
    "disputed_amount_usd disputed_usd disputed_value_share duration_seconds exception_ratio "
    "exception_scan_ratio failed_login_rate fx_rate_to_usd gross_amount gross_amount_usd "
    "gross_usd items_amount late_rate lifetime_net_usd line_amount list_price load_ratio "
    "max_daily_amount_usd mean_temperature mean_transit_hours median_lifetime_usd "
    "min_device_trust mrr_amount mrr_usd net_amount net_amount_usd net_settled_usd net_usd "
    "normalised_mrr observed_late on_time_rate open_hours order_net_amount_usd ordered_net_usd "
    "p95_transit_days peak_to_mean_attempts product_to_cart_rate rate refunded_amount_usd "
    "refunded_usd score settle_latency_seconds settled_gross_usd settled_net_usd "
    "shipping_amount stddev_daily_attempts total_amount_usd transit_days transit_hours "
    "trust_score unit_price unreconciled_ratio unreconciled_usd window_days zero_result_rate "
    "share precision recall blast exposure recovery concentration blindness cost mean_score "
    "confidence lineage schema operational ownership usage verification priority_score impact_part "
    "gap novelty l_quantity l_extendedprice l_discount l_tax age_hours elapsed_hours value_number"
).split()


def query(name: str, oracle: str | None = None):
    """Register ``fn(warehouse)`` under ``name`` with its equivalent SQL."""

    def register(fn):
        assert name not in ENTRIES, name
        ENTRIES[name] = Entry(fn, oracle)
        return fn

    return register


def _grid(x: Column) -> Column:
    """Six decimals below ten thousand, two above.

    The cut lies off the middle, where round numbers never fall, so the last bit of a sum
    added in another order cannot move a value to the next step.
    """
    fine = F.floor(x * 1e6 + 0.3719) / 1e6
    coarse = F.floor(x * 1e2 + 0.3719) / 1e2
    return F.when(F.abs(x) < 1e4, fine).otherwise(coarse)


def comparable(df: DataFrame) -> DataFrame:
    """Fractions on the shared grid as doubles, instants as plain timestamps."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DecimalType, DoubleType, FloatType)):
            c = _grid(c.cast("double"))
        elif isinstance(f.dataType, TimestampType):
            c = c.cast("timestamp_ntz")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def spark_query(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, root: comparable(entry.run(Warehouse(spark, root)))


def _needed(template: str, seen: dict[str, str]) -> None:
    for name in names_in(template):
        if name in seen or name in LANDED:
            continue
        source = TABLE_SQL[name]
        _needed(source, seen)
        seen[name] = source


def _plain(template: str) -> str:
    return spell(template, DUCKDB_SPELLING).replace("{", "").replace("}", "")


def oracle_sql(template: str) -> str:
    """One statement: every table the query reads as a CTE, then its rows on the shared grid."""
    seen: dict[str, str] = {}
    _needed(template, seen)
    parts = [f"{name} AS ({_plain(sql)})" for name, sql in seen.items()]
    parts.append(f"answer AS ({_plain(template)})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + on_grid("answer")


def on_grid(table: str) -> str:
    """The rows of ``table`` with every fraction on the grid."""
    names = ", ".join(f"'{n}'" for n in FRACTIONAL)
    step = (
        "CASE WHEN abs(x) < 1e4 THEN floor(x * 1e6 + 0.3719) / 1e6 "
        "ELSE floor(x * 1e2 + 0.3719) / 1e2 END"
    )
    return (
        "SELECT * EXCLUDE (_f, _i) FROM (\n"
        f"  SELECT COLUMNS(lambda c: c NOT IN ({names})),\n"
        f"    list_transform([CAST(COLUMNS(lambda c: c IN ({names})) AS DOUBLE)],\n"
        f"                   lambda x: {step})[1]\n"
        f"  FROM (SELECT *, 0.5 AS _f, 1 AS _i FROM {table}))"
    )
