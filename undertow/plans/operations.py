"""Logistics warehouse: staging, core, marts and features, all prefixed ``o_``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import elapsed, or_zero, ratio
from .warehouse import model

HOUR = 3_600
OPERATIONS_END = "2001-12-31"


@model("ops_staging")
def o_stg_carriers(ops_carriers):
    return ops_carriers.select("carrier_id", "carrier_name", "service_tier", "home_region")


@model("ops_staging")
def o_stg_facilities(ops_facilities):
    return ops_facilities.select(
        "facility_id", "facility_code", "region", "capacity_units", "opened_date", "owner_team"
    )


@model(
    "ops_staging",
    typed="ops_inventory_snapshots.units_on_hand ops_inventory_snapshots.units_reserved",
)
def o_stg_inventory_snapshots(ops_inventory_snapshots):
    return ops_inventory_snapshots.withColumn(
        "units_committed", F.col("units_on_hand") + F.col("units_reserved")
    )


@model("ops_staging")
def o_stg_scan_events(ops_scan_events):
    return ops_scan_events.withColumn("is_exception", F.col("exception_code").isNotNull())


@model(
    "ops_staging",
    typed="ops_shipments.delivered_at ops_shipments.dispatched_at ops_shipments.promised_at",
    key="shipment_id",
    required="carrier_id",
)
def o_stg_shipments(ops_shipments):
    delivered = F.col("delivered_at")
    return ops_shipments.withColumns(
        {
            "transit_hours": elapsed(delivered, F.col("dispatched_at"), HOUR),
            # An undelivered shipment is not on time; it is never unknown.
            "on_time": delivered.isNotNull() & (delivered <= F.col("promised_at")),
        }
    )


@model("ops_staging")
def o_stg_temperature_readings(ops_temperature_readings):
    return ops_temperature_readings.withColumn("is_alert", F.col("sensor_status") == "alert")


@model("ops_staging", typed="ops_work_orders.opened_at ops_work_orders.closed_at")
def o_stg_work_orders(ops_work_orders):
    closed = F.coalesce("closed_at", F.lit(OPERATIONS_END).cast("timestamp"))
    return ops_work_orders.withColumn("open_hours", elapsed(closed, F.col("opened_at"), HOUR))


@model("ops_core", typed="o_stg_shipments.transit_hours")
def o_int_carrier_reliability(o_stg_shipments):
    carriers = o_stg_shipments.groupBy("carrier_id").agg(
        F.count("*").alias("shipment_count"),
        F.count_if("on_time").alias("on_time_shipments"),
        F.avg("transit_hours").alias("mean_transit_hours"),
    )
    # Decimal before rounding, so that halves go away from zero.
    share = ratio(F.col("on_time_shipments"), F.col("shipment_count")).cast("decimal(20,12)")
    return carriers.withColumn("on_time_rate", F.round(share, 4))


@model("ops_core")
def o_int_exception_events(o_stg_scan_events, o_stg_shipments):
    routes = o_stg_shipments.select("shipment_id", "route_code", "priority")
    return (
        o_stg_scan_events.where("is_exception")
        .join(routes, "shipment_id")
        .select(
            "event_id",
            "shipment_id",
            "facility_id",
            "event_ts",
            "exception_code",
            "route_code",
            "priority",
        )
    )


@model(
    "ops_core",
    typed="o_stg_temperature_readings.celsius o_stg_temperature_readings.recorded_at",
)
def o_int_facility_conditions(o_stg_temperature_readings):
    return o_stg_temperature_readings.groupBy(
        "facility_id", F.to_date("recorded_at").alias("condition_date")
    ).agg(
        F.avg("celsius").alias("mean_temperature"),
        F.count_if("is_alert").alias("temperature_alerts"),
    )


@model(
    "ops_core",
    typed="o_stg_shipments.dispatched_at o_stg_shipments.package_count",
    required="facility_id",
)
def o_int_facility_day(o_stg_shipments):
    return o_stg_shipments.groupBy(
        "facility_id", F.to_date("dispatched_at").alias("operation_date")
    ).agg(
        F.count("*").alias("shipments_dispatched"),
        F.sum("package_count").alias("packages_dispatched"),
        F.count_if(F.col("priority").isin("priority", "fragile")).alias("priority_shipments"),
    )


@model("ops_core", typed="o_stg_scan_events.event_ts", key="shipment_id")
def o_int_shipment_milestones(o_stg_shipments, o_stg_scan_events):
    scans = o_stg_scan_events.groupBy("shipment_id").agg(
        F.count("event_id").alias("scan_count"),
        F.count_if("is_exception").alias("exception_scan_count"),
        F.max("event_ts").alias("last_scan_at"),
    )
    return o_stg_shipments.join(scans, "shipment_id", "left").select(
        "shipment_id",
        "facility_id",
        "carrier_id",
        "promised_at",
        "delivered_at",
        "on_time",
        or_zero(F.col("scan_count")).alias("scan_count"),
        or_zero(F.col("exception_scan_count")).alias("exception_scan_count"),
        "last_scan_at",
    )


@model(
    "ops_marts",
    typed="o_int_facility_day.packages_dispatched o_stg_facilities.capacity_units "
    "o_stg_inventory_snapshots.units_committed o_stg_inventory_snapshots.snapshot_date",
)
def o_mart_capacity_risk(
    o_int_facility_day, o_stg_facilities, o_stg_inventory_snapshots, o_int_facility_conditions
):
    sites = o_stg_facilities.select("facility_id", "facility_code", "region", "capacity_units")
    stock = o_stg_inventory_snapshots.select(
        "facility_id", F.col("snapshot_date").alias("operation_date"), "units_committed"
    )
    weather = o_int_facility_conditions.select(
        "facility_id", F.col("condition_date").alias("operation_date"), "temperature_alerts"
    )
    day = ["facility_id", "operation_date"]
    # The two day-grain sides share the day's partitioning; the site lookup comes last.
    joined = (
        o_int_facility_day.join(stock, day, "left").join(weather, day, "left").join(sites, "facility_id")
    )
    load = ratio(
        F.col("packages_dispatched") + F.col("units_committed"), F.col("capacity_units")
    ).cast("decimal(20,12)")
    return joined.select(
        *day,
        "facility_code",
        "region",
        "capacity_units",
        "packages_dispatched",
        "units_committed",
        F.round(load, 4).alias("load_ratio"),
        or_zero(F.col("temperature_alerts")).alias("temperature_alerts"),
    )


@model("ops_marts")
def o_mart_carrier_network(o_stg_carriers, o_int_carrier_reliability):
    return o_stg_carriers.join(o_int_carrier_reliability, "carrier_id")


@model("ops_marts")
def o_mart_delivery_sla(o_int_shipment_milestones, o_stg_carriers):
    state = (
        F.when(F.col("delivered_at").isNull(), "open")
        .when(F.col("on_time"), "on_time")
        .otherwise("late")
    )
    carriers = o_stg_carriers.select("carrier_id", "carrier_name", "service_tier")
    return o_int_shipment_milestones.join(carriers, "carrier_id").select(
        "shipment_id",
        "facility_id",
        "carrier_id",
        "carrier_name",
        "service_tier",
        "on_time",
        "scan_count",
        "exception_scan_count",
        state.alias("sla_state"),
    )


@model("ops_marts")
def o_mart_exception_queue(o_int_exception_events, o_stg_work_orders):
    """Each exception with every work order of its facility: the fan-out is the queue.

    The exceptions are the streamed side, so a facility holding most of them is split by the
    adaptive skew join and each piece meets that facility's work orders on its own.
    """
    orders = o_stg_work_orders.select(
        "facility_id", "work_order_id", "severity", F.col("status").alias("work_order_status")
    )
    return o_int_exception_events.drop("priority").join(orders, "facility_id", "left")


@model("ops_features", typed="o_mart_delivery_sla.exception_scan_count")
def o_feature_delivery_risk(o_mart_delivery_sla):
    return o_mart_delivery_sla.select(
        "shipment_id",
        "facility_id",
        "carrier_id",
        F.when(F.col("sla_state") == "late", 1.0).otherwise(0.0).alias("observed_late"),
        "exception_scan_count",
        "scan_count",
        ratio(F.col("exception_scan_count"), F.col("scan_count")).alias("exception_scan_ratio"),
    )


@model("ops_features", typed="o_mart_capacity_risk.load_ratio")
def o_feature_facility_congestion(o_mart_capacity_risk):
    busy = (F.col("load_ratio") >= F.lit(0.85).cast("decimal(6,4)")) | (
        F.col("temperature_alerts") > 0
    )
    return o_mart_capacity_risk.select(
        "facility_id",
        "operation_date",
        "facility_code",
        "region",
        "load_ratio",
        "temperature_alerts",
        F.when(busy, 1).otherwise(0).alias("needs_attention"),
    )
