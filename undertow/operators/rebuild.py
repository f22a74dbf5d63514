"""Rebuild what a fault reaches on an overlay of production, and compare the contents."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.summaries import contents
from ..plans import CONSUMERS, MODELS, MissingTable, Warehouse, downstream_models
from ..sources.contracts import ContractError
from .baseline import Baseline, by_level
from .faults import faulted
from .impact import DEGRADED, UNAVAILABLE
from .quality import report

FAILURES = (PySparkException, ContractError, MissingTable)


@dataclass(frozen=True)
class Fault:
    kind: str
    table: str
    column: str | None = None
    days: int = 1


def overlay(production: Warehouse, fault: Fault) -> Warehouse:
    """Production with the faulted table in place of the real one; nothing is copied."""
    copy = faulted(production[fault.table], fault.kind, fault.column, fault.days)
    return production.overlay({fault.table: copy})


def scope(fault: Fault) -> list[str]:
    """The models to rebuild: everything downstream, in build order, the faulted one excepted."""
    return [name for name in downstream_models(fault.table) if name != fault.table]


def compare(shadow: DataFrame, real: DataFrame) -> tuple[str | None, str]:
    """How a rebuilt table differs from the real one: its impact, if any, and the evidence.

    Two one-row summaries are brought back; the rows themselves stay where they are.
    """
    if shadow.columns != real.columns:
        return DEGRADED, "columns differ"
    pair = (
        contents(shadow)
        .withColumn("side", F.lit("shadow"))
        .unionByName(contents(real).withColumn("side", F.lit("real")))
    )
    found = {r["side"]: r for r in pair.collect()}
    ours, theirs = found["shadow"], found["real"]
    if ours["row_count"] != theirs["row_count"]:
        gap = ours["row_count"] - theirs["row_count"]
        return DEGRADED, f"{ours['row_count']} rows against {theirs['row_count']} ({gap:+d})"
    if ours["checksum"] != theirs["checksum"]:
        return DEGRADED, "same row count, contents differ"
    return None, "identical"


def observe(
    shadow: Warehouse, production: Warehouse, name: str, stored: Baseline | None = None
) -> tuple[str | None, str]:
    """Build one model on ``shadow`` and say what happened to it.

    Both sides are written once, so the models above read them and do not compute them again. With
    a ``stored`` baseline only the rebuilt side is written, and its list of buckets is compared.
    """
    try:
        rebuilt = shadow.keep(name)
        return stored.compare(name, rebuilt) if stored else compare(rebuilt, production.keep(name))
    except FAILURES as error:
        return UNAVAILABLE, str(error).strip()


def classify(
    production: Warehouse, fault: Fault, names: Iterable[str] | None = None, stored: Baseline | None = None
) -> DataFrame:
    """Everything downstream rebuilt on the overlay and compared, models of one depth as concurrent jobs."""
    shadow = overlay(production, fault)
    shadow.keep(fault.table)
    names = list(names or scope(fault))
    found = by_level(names, lambda name: observe(shadow, production, name, stored))
    return outcome_table(production, [(name, *found[name]) for name in names])


def probes(
    production: Warehouse, fault: Fault, names: Iterable[str] | None = None, stored: Baseline | None = None
) -> DataFrame:
    """Every model downstream, each rebuilt by itself: all it reads is healthy but for the faulted table.

    A model that does not read the faulted table has nothing but healthy inputs, so what it is
    built from is production itself.
    """
    shadow = overlay(production, fault)
    rows = []
    for name in names or scope(fault):
        if fault.table not in MODELS[name].reads:
            rows.append((name, None, "identical"))
            continue
        healthy = {t: production.keep(t) for t in MODELS[name].reads if t != fault.table}
        alone = production.overlay({**healthy, fault.table: shadow.keep(fault.table)})
        rows.append((name, *observe(alone, production, name, stored)))
    return outcome_table(production, rows)


def broken_tests(shadow: Warehouse, name: str) -> list[str]:
    """The declared tests a rebuilt model fails; all tests of one kind are one job."""
    checks, df = MODELS[name].checks, shadow[name]
    failed = [f"{c.kind}({c.column})" for c in checks if c.column not in df.columns]
    present = replace(MODELS[name], checks=tuple(c for c in checks if c.column in df.columns))
    for kind in dict.fromkeys(c.kind for c in present.checks):
        found = report({name: df}, [present], kind).where("failures > 0").collect()
        failed += [f"{kind}({r['column_name']})" for r in found]
    return failed


def cascade(
    production: Warehouse, fault: Fault, names: Iterable[str] | None = None, stored: Baseline | None = None
) -> DataFrame:
    """Everything downstream rebuilt in order; a failed build or test stops what depends on it.

    The loop is over models, of which there are dozens; those of one depth are built at the same
    time, every table once, and compared on the cluster.
    """
    shadow = overlay(production, fault)
    shadow.keep(fault.table)
    stopped: set[str] = set()

    def rebuild(name: str) -> tuple[str | None, str]:
        if stopped.intersection(MODELS[name].reads):
            stopped.add(name)
            return UNAVAILABLE, "skipped: something it reads failed"
        impact, detail = observe(shadow, production, name, stored)
        if impact == UNAVAILABLE:
            stopped.add(name)
            return impact, detail
        failed = broken_tests(shadow, name)
        if failed:
            stopped.add(name)
            return DEGRADED, f"{detail}; failed {', '.join(failed)}"
        return impact, detail

    names = list(names or scope(fault))
    found = by_level(names, rebuild)
    return outcome_table(production, [(name, *found[name]) for name in names])


def outcome_table(w: Warehouse, rows: list[tuple]) -> DataFrame:
    return w.spark.createDataFrame(rows, "asset string, impact string, detail string")


def consumers(shadow: Warehouse, names: Iterable[str] | None = None) -> DataFrame:
    """Consumer queries on the overlay: whether each still runs, and how often it is run."""
    rows = []
    for c in (CONSUMERS[name] for name in sorted(names or CONSUMERS)):
        error = None
        try:
            c.run(*[shadow[t] for t in c.reads]).write.format("noop").mode("overwrite").save()
        except FAILURES as failure:
            error = str(failure).strip()
        rows.append((c.name, c.daily_runs, error))
    return shadow.spark.createDataFrame(rows, "consumer string, daily_runs int, error string")


def row_differences(shadow: DataFrame, real: DataFrame) -> DataFrame:
    """Rows on one side only, counted; the exact form of what the checksum decides."""
    ours = shadow.withColumn("_sign", F.lit(1))
    theirs = real.withColumn("_sign", F.lit(-1))
    net = ours.unionByName(theirs).groupBy(*shadow.columns).agg(F.sum("_sign").alias("_net"))
    return net.agg(
        F.coalesce(F.sum(F.greatest("_net", F.lit(0))), F.lit(0)).alias("only_rebuilt"),
        F.coalesce(F.sum(F.greatest(-F.col("_net"), F.lit(0))), F.lit(0)).alias("only_real"),
    )
