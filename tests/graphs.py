"""Small hand-made graphs, and a plain reading of how damage spreads, for comparison."""

from __future__ import annotations

import heapq

from undertow.operators.lineage import Graph

ASSET = (
    "asset string, kind string, name string, layer string, team string, refresh_cadence string, "
    "sla_hours int, tier string, replicated boolean, fallback_source string, materialization string"
)


def asset(key, kind="dataset", cadence=None, tier=None, replicated=None, fallback=None,
          how="table", team=None, sla=None):
    return (key, kind, key, key.split(".")[0], team, cadence, sla, tier, replicated, fallback, how)


def graph(spark, assets, edges, column_edges=(), columns=(), owners=()):
    return Graph(
        spark.createDataFrame(list(assets), ASSET),
        spark.createDataFrame(
            [(a, c, "text", True) for a, c in columns],
            "asset string, column_name string, native_type string, nullable boolean",
        ),
        spark.createDataFrame(list(owners), "asset string, owner string"),
        spark.createDataFrame(list(edges), "source string, target string"),
        spark.createDataFrame(
            list(column_edges),
            "source string, source_column string, target string, target_column string",
        ),
    )


def faults(spark, *rows):
    return spark.createDataFrame(
        list(rows),
        "scenario string, kind string, origin string, column_name string, at_minute int",
    )


IMPACT = {
    "drop_column": ("unavailable", True),
    "drop_asset": ("unavailable", False),
    "change_column_type": ("unavailable", True),
    "stop_new_rows": ("degraded", False),
    "null_out_column": ("degraded", True),
}


def refresh(cadence, minute):
    """Minute by minute until the clock says so."""
    if cadence == "hourly":
        while minute % 60:
            minute += 1
        return minute
    if cadence and cadence.startswith("daily_"):
        want = int(cadence[6:8]) * 60 + int(cadence[8:])
        while minute % 1440 != want:
            minute += 1
        return minute
    return minute + 5


def walk(assets, edges, column_edges, columns, kind, origin, column, at):
    """(asset, column or '') -> minutes after the fault, one step at a time, earliest first."""
    impact, narrow = IMPACT[kind]
    by_key = {a[0]: a for a in assets}
    out = {s: {t for f, t in edges if f == s} for s in by_key}
    cols = {k: [c for a, c in columns if a == k] for k in by_key}
    traced = {s for s, *_ in column_edges}

    def whole(targets):
        return [(t, c) for t in targets for c in ("", *cols[t])]

    def onward(key, col):
        if impact == "unavailable":
            return whole(out[key]) if col == "" else []
        if key not in traced:
            return whole(out[key]) if col == "" else []
        hits = [(t, tc) for s, sc, t, tc in column_edges if s == key and sc == col]
        return hits + [(t, "") for t, _ in hits]

    if narrow and origin in traced:
        hits = [(t, tc) for s, sc, t, tc in column_edges if s == origin and sc == column]
        first = hits + [(t, "") for t, _ in hits]
    else:
        first = whole(out[origin])
    queue = [(at, n) for n in first]
    heapq.heapify(queue)
    done = {}
    while queue:
        minute, (key, col) = heapq.heappop(queue)
        if key == origin:
            continue
        a = by_key[key]
        instant = a[1] != "dataset" or (a[10] or "").lower() == "view"
        due = minute if instant else refresh(a[5], minute)
        if done.get((key, col), due + 1) <= due:
            continue
        done[(key, col)] = due
        for n in onward(key, col):
            heapq.heappush(queue, (due, n))
    keep = (lambda c: c == "") if impact == "unavailable" else (lambda c: True)
    return {n: d - at for n, d in done.items() if keep(n[1])}
