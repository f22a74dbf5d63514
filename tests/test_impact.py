import random

import pytest
from pyspark.sql import functions as F

from graphs import asset, faults, graph, refresh, walk
from undertow.operators import impact


@pytest.mark.parametrize("cadence", [None, "continuous", "hourly", "daily_0630", "daily_0000", "weekly", "daily_9999"])
def test_next_refresh_matches_a_clock_watched_minute_by_minute(spark, cadence):
    rng = random.Random(1)
    minutes = [rng.randrange(0, 4000) for _ in range(60)] + [0, 60, 390, 1440]
    df = spark.createDataFrame([(m,) for m in minutes], "m int")
    c = F.lit(cadence).cast("string")
    for r in df.select("m", impact.next_refresh(c, F.col("m")).alias("due")).collect():
        want = refresh(None if cadence == "daily_9999" else cadence, r["m"])
        assert r["due"] == want, (cadence, r["m"])


def broken(g, f):
    return {r["asset"]: r["offset_minutes"] for r in impact.events(impact.propagate(g, f)).collect()}


def test_a_dropped_column_spares_readers_of_other_columns(spark):
    g = graph(
        spark,
        [asset("raw.o"), asset("stg.a", how="view"), asset("stg.b", how="view"), asset("mart.c")],
        [("raw.o", "stg.a"), ("raw.o", "stg.b"), ("stg.a", "mart.c")],
        column_edges=[("raw.o", "x", "stg.a", "x"), ("raw.o", "y", "stg.b", "y")],
        columns=[("stg.a", "x"), ("stg.b", "y"), ("mart.c", "z")],
    )
    got = broken(g, faults(spark, ("s", "drop_column", "raw.o", "x", 0)))
    assert got == {"stg.a": 0, "mart.c": 5}


def test_without_column_lineage_every_consumer_is_reached(spark):
    g = graph(spark, [asset("r"), asset("a", how="view"), asset("b", how="view")], [("r", "a"), ("r", "b")])
    got = broken(g, faults(spark, ("s", "drop_column", "r", "x", 0)))
    assert got == {"a": 0, "b": 0}
    # The catalog says who reads what and nobody reads x: silence is a finding.
    known = graph(spark, [asset("r"), asset("a")], [("r", "a")], [("r", "y", "a", "y")], [("a", "y")])
    assert broken(known, faults(spark, ("s", "drop_column", "r", "x", 0))) == {}


def test_wrong_values_stop_where_their_column_stops(spark):
    g = graph(
        spark,
        [asset("r"), asset("a", how="view"), asset("b", how="view"), asset("d", "dashboard")],
        [("r", "a"), ("a", "b"), ("a", "d")],
        column_edges=[("r", "x", "a", "x"), ("a", "other", "b", "other")],
        columns=[("a", "x"), ("a", "other"), ("b", "other")],
    )
    assert broken(g, faults(spark, ("s", "null_out_column", "r", "x", 0))) == {"a": 0}
    assert set(broken(g, faults(spark, ("s", "drop_column", "r", "x", 0)))) == {"a", "b", "d"}


def test_many_scenarios_at_once_match_one_walk_each(spark):
    rng = random.Random(11)
    names = [f"g.n{i}" for i in range(14)]
    cadences = [None, "hourly", "daily_0300", "daily_2200", "continuous", "weekly"]
    assets = [
        asset(n, rng.choice(["dataset"] * 5 + ["chart"]), rng.choice(cadences), how=rng.choice(["table", "view", None]))
        for n in names
    ]
    columns = [(n, c) for n in names for c in "xyz" if rng.random() < 0.8]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(26)})
    traced = set(rng.sample(names, 8))
    column_edges = sorted(
        {
            (s, rng.choice("xyz"), t, c)
            for s, t in edges
            if s in traced
            for a, c in columns
            if a == t and rng.random() < 0.7
        }
    )
    runs = [
        (f"s{i}", kind, n, None if kind == "drop_asset" else rng.choice("xyz"), rng.randrange(1440))
        for i, (n, kind) in enumerate((n, k) for n in names for k in impact_kinds())
    ]
    g = graph(spark, assets, edges, column_edges, columns)
    got = {}
    for r in impact.propagate(g, faults(spark, *runs)).collect():
        got.setdefault(r["scenario"], {})[(r["asset"], r["column_name"])] = r["offset_minutes"]
    for scenario, kind, origin, column, at in runs:
        want = walk(assets, edges, column_edges, columns, kind, origin, column, at)
        assert got.get(scenario, {}) == want, (scenario, kind, origin, column)


def impact_kinds():
    return [k for k, *_ in impact.KINDS]


def test_paging_names_each_owner_once_and_what_pages_nobody(spark, rows):
    g = graph(
        spark,
        [asset("r"), asset("a", tier="tier1", how="view"), asset("b", cadence="hourly"), asset("c", "dashboard")],
        [("r", "a"), ("a", "b"), ("a", "c")],
        owners=[("a", "ann"), ("b", "ann"), ("b", "bo"), ("a", "gone")],
    )
    ev = impact.events(impact.propagate(g, faults(spark, ("s", "drop_asset", "r", None, 10))))
    pages = impact.paging(g, ev, departed="gone")
    got = {r["owner"]: r for r in pages.collect()}
    assert set(got) == {"ann", "bo"}
    # tier1 is three, and a dashboard reads it directly: two more.
    assert (got["ann"]["first_asset"], got["ann"]["asset_count"], got["ann"]["severity"]) == ("a", 2, 5)
    assert got["bo"]["offset_minutes"] == 50 and got["bo"]["severity"] == 1
    orphans = impact.unowned(g, ev, departed="gone")
    assert rows(orphans) == [("s", "c")]
    line = impact.load(pages, orphans).first()
    assert (line["owners_paged"], line["heaviest"], line["unowned_assets"]) == (2, "ann", 1)


def test_a_page_holds_the_set_of_all_that_fails(spark, rows):
    """By name and by number: each asset once and in order, however often it fails or is described; what stays whole is not in it."""
    g = graph(
        spark,
        [asset("r"), asset("c"), asset("b", how="view"), asset("b"), asset("a", cadence="hourly"), asset("e")],
        [("r", "c"), ("r", "b"), ("b", "a")],
        owners=[("a", "ann"), ("b", "ann"), ("c", "ann"), ("c", "ann"), ("e", "ann"), ("r", "ann"), ("b", "bo"), ("e", "cy")],
    )
    f = faults(spark, ("s", "drop_asset", "r", None, 10), ("s", "stop_new_rows", "r", "x", 70), ("t", "drop_asset", "b", None, 0))
    want = [("s", "ann", ["a", "b", "c"]), ("s", "bo", ["b"]), ("t", "ann", ["a"])]
    damage = impact.spread_out(g, f)
    by_name, by_number = impact.paging(g, impact.events(damage.named())), impact.paging(g, damage.events(), damage=damage)
    for pages in (by_name, impact.named_pages(by_number, damage)):
        assert rows(pages.select("scenario", "owner", "assets")) == want
    assert "collect_set" not in impact.load(by_number, impact.unowned(g, damage.events(), damage=damage))._jdf.queryExecution().optimizedPlan().toString()


def test_pages_sort_by_time_not_by_text(spark):
    g = graph(
        spark,
        [asset("r"), asset("a", cadence="daily_2300"), asset("b", cadence="daily_0100")],
        [("r", "a"), ("r", "b")],
        owners=[("a", "early"), ("b", "late")],
    )
    ev = impact.events(impact.propagate(g, faults(spark, ("s", "drop_asset", "r", None, 120))))
    order = impact.page_order(impact.paging(g, ev)).orderBy("page_no").collect()
    assert [r["owner"] for r in order] == ["early", "late"]


def test_scenarios_that_cannot_run_say_why(spark, rows):
    g = graph(spark, [asset("r")], [], columns=[("r", "x")])
    f = faults(
        spark,
        ("ok", "drop_column", "r", "x", 0),
        ("gone", "drop_asset", "r", None, 0),
        ("a", "drop_asset", "nowhere", None, 0),
        ("b", "drop_column", "r", "zz", 0),
        ("c", "null_out_column", "r", None, 0),
        ("d", "set on fire", "r", None, 0),
    )
    assert rows(impact.refused(g, f)) == [
        ("a", "unknown asset"),
        ("b", "unknown column"),
        ("c", "needs a column"),
        ("d", "unknown kind of fault"),
    ]


def test_steps_are_found_once_however_often_they_are_read(spark, monkeypatch):
    """Names and links read the steps from where they were written, not from the tables of the estate again."""
    plans, pin = {}, impact.pin

    def watched(df, label="round", compression=None):
        plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString())
        return pin(df, label, compression)

    monkeypatch.setattr(impact, "pin", watched)
    g = graph(spark, [asset("r"), asset("a"), asset("b", how="view")], [("r", "a"), ("a", "b")], [("r", "x", "a", "x")], [("a", "x"), ("b", "y")])
    got = broken(g, faults(spark, ("s", "drop_column", "r", "x", 0)))
    assert got == {"a": 5, "b": 5}
    assert "LogicalRDD" in plans["wave"] or "LocalRelation" in plans["wave"]
    assert "LogicalRDD" not in plans["links"] and "LocalRelation" not in plans["links"]


def test_events_by_number_say_what_events_by_name_say(spark, rows):
    """Scenarios of several faults, an asset that is described twice, an owner who is named twice."""
    g = graph(
        spark,
        [asset("r"), asset("a", tier="tier1", how="view"), asset("a"), asset("b", cadence="hourly"), asset("c", "dashboard"), asset("e")],
        [("r", "a"), ("a", "b"), ("a", "c"), ("b", "e")],
        column_edges=[("r", "x", "a", "x"), ("a", "x", "b", "y")],
        columns=[("a", "x"), ("b", "y")],
        owners=[("a", "ann"), ("a", "ann"), ("b", "ann"), ("b", "bo"), ("c", "bo")],
    )
    told = [("s", "drop_asset", "r", None, 10), ("s", "stop_new_rows", "r", "x", 70), ("t", "null_out_column", "r", "x", 0), ("u", "drop_asset", "a", None, 5)]
    f = faults(spark, *told)
    by_name = impact.events(impact.propagate(g, f))
    damage = impact.spread_out(g, f)
    by_number = damage.events()
    named = impact.by_name(impact.by_name(by_number, "scenario", damage.names("scenario")), "asset", damage.names("asset"))
    columns = ["scenario", "impact", "asset", "offset_minutes"]
    assert rows(named.select(columns)) == rows(by_name.select(columns)) != []
    pages, numbered = impact.paging(g, by_name), impact.paging(g, by_number, damage=damage)
    assert rows(impact.named_pages(numbered, damage)) == rows(pages)
    alone, orphans = impact.unowned(g, by_name), impact.unowned(g, by_number, damage=damage)
    assert rows(impact.by_name(impact.by_name(orphans, "scenario", damage.names("scenario")), "asset", damage.names("asset"))) == rows(alone) != []
    load = impact.by_name(impact.load(numbered, orphans), "scenario", damage.names("scenario"))
    assert rows(load) == rows(impact.load(pages, alone))


def test_names_that_only_others_have_get_numbers_of_their_own(spark):
    names = spark.createDataFrame([("a", 4), ("b", 6)], "name string, number bigint")
    seen = spark.createDataFrame([("a",), ("z",), ("z",), (None,), ("y",)], "asset string")
    more = impact.with_more(names, seen, "asset")
    numbers = {r["name"]: r["number"] for r in more.collect()}
    assert set(numbers) == {"a", "b", "y", "z"} and (numbers["a"], numbers["b"]) == (4, 6)
    assert numbers["y"] < 0 and numbers["z"] < 0 and numbers["y"] != numbers["z"]
    back = impact.by_name(impact.by_number(seen, "asset", more, "left"), "asset", more)
    assert sorted(r["asset"] or "" for r in back.collect()) == ["", "a", "y", "z", "z"]
