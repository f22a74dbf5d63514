import pytest
from pyspark.sql import functions as F

from graphs import asset, graph
from undertow.operators import context, knockout, lineage


def scored(spark, g, usage=()):
    used = knockout.usage_rollup(
        spark.createDataFrame(list(usage), "asset string, runs bigint, user_name string")
    )
    ev = knockout.sweep_events(g)
    parts = knockout.components(g, ev, used, lineage.closure(g.edges))
    return {r["origin"]: r for r in knockout.ranked(knockout.scores(parts)).collect()}


def pair(spark, usage=(), **risky):
    """A replicated source with three readers, and a bare one with a single dashboard."""
    return scored(
        spark,
        graph(
            spark,
            [asset("s.big", replicated=True), asset("s.bare", **risky)]
            + [asset(f"m.{i}") for i in range(3)]
            + [asset("d", "dashboard")],
            [("s.big", f"m.{i}") for i in range(3)] + [("s.bare", "d")],
            owners=[("m.0", "ann"), ("d", "bo")],
        ),
        usage,
    )


def test_components_by_hand(spark):
    got = pair(spark, [("m.0", 30, "u"), ("m.1", 10, "u"), ("s.bare", 60, "v")], replicated=False)
    big, bare = got["s.big"], got["s.bare"]
    assert big["blast"] == pytest.approx(3 / 6) and bare["blast"] == pytest.approx(1 / 6)
    # Only what is lost counts: the source's own sixty queries do not.
    assert big["exposure"] == pytest.approx(0.4) and bare["exposure"] == 0
    assert big["recovery"] == 0 and bare["recovery"] == 1
    assert big["concentration"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert bare["concentration"] == pytest.approx(0.5) and bare["blindness"] == 0
    assert big["cost"] == 3 * 600 and bare["cost"] == 150
    want = 100 * (0.25 * 0.5 + 0.25 * 0.4 + 0.15 * (0.5 + 1 / 3))
    assert big["score"] == pytest.approx(want)
    assert sorted(r["rank"] for r in got.values()) == list(range(1, len(got) + 1))


def test_a_fallback_halves_recovery_and_unknown_is_a_half(spark):
    assert pair(spark, replicated=False, fallback="copy")["s.bare"]["recovery"] == 0.5
    assert pair(spark)["s.bare"]["recovery"] == 0.5
    # What lies upstream decides, not the asset's own flag.
    g = graph(spark, [asset("a", replicated=True), asset("b", replicated=False)], [("a", "b")])
    assert scored(spark, g)["b"]["recovery"] == 0


def test_equal_scores_rank_by_name(spark):
    got = scored(spark, graph(spark, [asset("z"), asset("a"), asset("m")], []))
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1]["rank"])] == ["a", "m", "z"]


def test_ranking_is_dense_over_many_slices(spark):
    df = spark.range(2000).select(
        (F.col("id") % 50).cast("double").alias("score"), F.col("id").cast("string").alias("origin")
    )
    got = [(r["score"], r["origin"]) for r in knockout.ranked(df).orderBy("rank").collect()]
    assert got == sorted(got, key=lambda t: (-t[0], t[1]))


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        knockout.check_weights({**knockout.WEIGHTS, "blast": 0.5})


def test_properties_and_gate(spark):
    g = graph(spark, [asset("a"), asset("d", "dashboard")], [("a", "d")], owners=[("d", "ann")])
    ev = knockout.sweep_events(g)
    used = spark.createDataFrame([], "asset string, queries bigint, users bigint")
    ranked = knockout.ranked(
        knockout.scores(knockout.components(g, ev, used, lineage.closure(g.edges)))
    )
    nothing = spark.createDataFrame([], "asset string")
    ctx = context.confidence(context.components(g, used, nothing))
    values = {
        r["property"]: r["value"]
        for r in knockout.property_rows(ranked, ctx, "now", "test").collect()
    }
    assert len(values) == 17 and values["is_spof"] == "yes" and values["bus_factor"] == "1"
    assert values["blast_radius"] == "1" and values["fragility_rank"] == "1"
    changed = spark.createDataFrame([("a",), ("lost",)], "asset string")
    verdicts = {r["asset"]: r["verdict"] for r in knockout.gate(ranked, changed, 10.0).collect()}
    assert verdicts == {"a": "fail", "lost": "unknown"}
    row = knockout.history_row(ranked, "fleet", "fp", "now").first()
    assert (row["target"], row["fingerprint"], row["scored_at"]) == ("fleet", "fp", "now")
    assert [t["origin"] for t in row["top"]] == ["a"] and row["top"][0]["score"] > 0


def test_confidence_by_hand(spark):
    g = graph(
        spark,
        [asset("a", tier="tier1", team="t", sla=4, cadence="hourly", replicated=False), asset("lonely"), asset("d", "chart")],
        [("a", "d")],
        columns=[("a", f"c{i}") for i in range(4)],
        owners=[("a", "ann")],
    )
    used = spark.createDataFrame([("a", 3, 1)], "asset string, queries bigint, users bigint")
    seen = spark.createDataFrame([("a",)], "asset string")
    got = {r["asset"]: r for r in context.confidence(context.components(g, used, seen)).collect()}
    assert got["a"]["confidence"] == pytest.approx(0.25 + 0.1 + 0.25 + 0.15 + 0.1 + 0.05)
    assert got["a"]["band"] == "high" and got["lonely"]["confidence"] == 0 and got["lonely"]["band"] == "low"
    assert got["d"]["confidence"] == pytest.approx(0.45)


def test_evidence_counts_only_for_the_present_state(spark, rows):
    ledger = spark.createDataFrame(
        [("fp1", "s1", "a"), ("fp2", "s2", "b"), ("fp1", "s1", "a")],
        "fingerprint string, scenario string, fault_asset string",
    )
    assert rows(context.verified_assets(ledger, "fp1")) == [("a",)]


def test_a_run_scenario_is_less_novel(spark):
    known = spark.createDataFrame([("a", 0.5, "partial")], "asset string, confidence double, band string")
    scenarios = spark.createDataFrame(
        [("s1", "a", "p"), ("s2", "a", "p"), ("s3", "lost", "p")], "scenario string, origin string, path string"
    )
    scores = spark.createDataFrame([("a", 40.0)], "origin string, score double")
    reach = spark.createDataFrame([("a", "b")], "origin string, asset string")
    ledger = spark.createDataFrame([("fp", "s1")], "fingerprint string, scenario string")
    got = {
        r["scenario"]: r["priority_score"]
        for r in context.candidates(scenarios, known, scores, reach, ledger, "fp", F.lit(10)).collect()
    }
    assert got == {"s1": pytest.approx(0.2 + 0.175 + 0.03), "s2": pytest.approx(0.2 + 0.175 + 0.15)}


def test_scoring_twice_gives_the_same_rows(spark):
    from undertow.operators import quality

    g = graph(spark, [asset("a"), asset("b", cadence="hourly"), asset("d", "dashboard")], [("a", "b"), ("b", "d")])
    used = spark.createDataFrame([("b", 4, 1)], "asset string, queries bigint, users bigint")
    run = lambda: knockout.scores(
        knockout.components(g, knockout.sweep_events(g), used, lineage.closure(g.edges))
    )
    first = run()
    assert quality.replays(first, run()).first()["same"]
    assert not quality.replays(first, first.withColumn("score", F.col("score") + 1)).first()["same"]


def test_knockouts_by_number_are_those_by_name(spark, rows):
    g = graph(
        spark,
        [asset("r"), asset("a"), asset("a", "chart"), asset("b", cadence="hourly"), asset("d", "dashboard"), asset("alone")],
        [("r", "a"), ("a", "b"), ("b", "d"), ("r", "d")],
        owners=[("a", "ann"), ("b", "ann"), ("b", "bo"), ("b", "bo")],
    )
    used = spark.createDataFrame([("a", 3, 1), ("b", 4, 1), ("d", 9, 2)], "asset string, queries bigint, users bigint")
    ev, swept = knockout.sweep_events(g), knockout.sweep(g)
    numbers = knockout.by_origin(swept)
    lost = knockout.knockouts(g, ev)
    assert rows(knockout.knockouts(g, numbers, swept)) == rows(lost)
    got = {r["origin"]: r for r in lost.collect()}
    assert (got["r"]["datasets_lost"], got["r"]["consumers_lost"], got["r"]["owners_paged"], got["r"]["unowned_lost"]) == (2, 2, 2, 1)
    assert got["alone"]["consumers_lost"] == 0 and got["alone"]["first_consumer_minutes"] is None
    assert rows(knockout.exposure(g, numbers, used, swept)) == rows(knockout.exposure(g, ev, used))


def test_recovery_uses_what_the_sweep_has_found(spark, rows, monkeypatch):
    """Cycles, a dataset that reads itself, an asset that is listed twice, consumers that are read: as by the closure."""
    import random

    asked, totals = [], knockout.upstream_totals

    def watched(edges, values):
        asked.append({r["asset"] for r in values.collect()})
        return totals(edges, values)

    monkeypatch.setattr(knockout, "upstream_totals", watched)
    random.seed(3)
    names = [f"n{i}" for i in range(16)]
    kinds = {n: random.choice(["dataset"] * 3 + ["chart"]) for n in names}
    flags = {n: random.choice([True, False, False, None]) for n in names} | {"n1": False, "n2": True}
    assets = [asset(n, kinds[n], replicated=flags[n], fallback=random.choice(["", "copy"])) for n in names]
    assets += [asset("n0", "dataset", replicated=False), asset("n0", "chart", replicated=True)]
    edges = [(random.choice(names), random.choice(names)) for _ in range(18)] + [("n1", "n1"), ("n2", "n3"), ("n3", "n2"), ("n9", "end")]
    datasets = {a[0] for a in assets if a[1] == "dataset"}
    for links, all_of_them in (edges, False), ([("n4", "hidden"), ("hidden", "n5"), ("n1", "n4")], True):
        asked.clear()
        g = graph(spark, assets, links)
        swept = knockout.sweep(g)
        got = knockout.recovery(g, None, knockout.by_origin(swept), swept)
        assert rows(got) == rows(knockout.recovery(g, lineage.closure(g.edges)))
        assert len(asked) == 1 and bool(asked[0] & datasets) == all_of_them


def test_the_tally_tells_owners_apart_and_counts_each_asset_once(spark, rows):
    """An asset of two owners, one of none, one whose owner has no name; the pairs of the sweep are read as they lie."""
    g = graph(
        spark,
        [asset("r"), asset("a"), asset("b"), asset("c", "dashboard", how="view"), asset("d")],
        [("r", "a"), ("a", "b"), ("b", "c"), ("r", "d")],
        owners=[("a", "ann"), ("a", "bo"), ("b", "ann"), ("d", None)],
    )
    used = spark.createDataFrame([("a", 3, 1), ("b", 4, 1), ("c", 9, 2)], "asset string, queries bigint, users bigint")
    swept = knockout.sweep(g)
    pairs = knockout.by_origin(swept)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    lost = knockout.tally(g, pairs, swept, used)
    got = {r["origin"]: r.asDict() for r in knockout.knockouts(g, pairs, swept, lost).collect()}
    assert [got["r"][c] for c in ("datasets_lost", "consumers_lost", "owners_paged", "unowned_lost", "first_consumer_minutes")] == [3, 1, 2, 1, 10]
    assert [got["a"][c] for c in ("datasets_lost", "consumers_lost", "owners_paged", "unowned_lost")] == [1, 1, 1, 1]
    assert rows(knockout.exposure(g, pairs, used, swept, lost)) == [("a", 4), ("r", 7)]
