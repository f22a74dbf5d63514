import random

from pyspark.sql import functions as F

from graphs import asset, graph
from undertow.operators import lineage

LOG = "urn:li:dataset:(urn:li:dataPlatform:{},wh.{},PROD)"


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source string, target string")


def reach(edges):
    out = {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
    found = set()
    for s in out:
        stack = list(out[s])
        while stack:
            t = stack.pop()
            if (s, t) not in found:
                found.add((s, t))
                stack += out.get(t, ())
    return found


def test_closure_on_a_cycle_ends_and_includes_the_origin(spark):
    got = lineage.closure(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]))
    pairs = {(r["origin"], r["asset"]) for r in got.collect()}
    assert pairs == reach([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    assert ("a", "a") in pairs and ("d", "d") not in pairs


def test_closure_matches_brute_force_on_random_graphs_with_a_hub(spark):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)]
    links += [("hub", f"n{i}") for i in range(30)]
    got = lineage.closure(edges_of(spark, links + links[:5]))
    assert {(r["origin"], r["asset"]) for r in got.collect()} == reach(links)
    assert got.count() == len(reach(links))


def records(spark):
    physical = '{"name":"orders","schemaMetadata":{"fields":[{"fieldPath":"id","nativeDataType":"bigint","nullable":false},{"fieldPath":"x"}]}}'
    modelled = '{"properties":{"name":"orders","customProperties":[{"key":"team","value":"ops"},{"key":"sla_hours","value":"soon"},{"key":"replicated","value":"TRUE"}]},"ownership":{"owners":[{"owner":{"urn":"urn:li:corpuser:ann"}},{"owner":{"urn":"urn:li:corpuser:bo"}}]},"schemaMetadata":{"fields":[{"fieldPath":"other"}]}}'
    board = '{"properties":{"name":"Revenue"}}'
    return spark.createDataFrame(
        [
            (LOG.format("postgres", "core.orders"), physical),
            (LOG.format("dbt", "core.orders"), modelled),
            ("urn:li:dashboard:(bi,revenue)", board),
        ],
        "urn string, body string",
    )


def test_siblings_fold_into_one_asset(spark, rows):
    shaped = lineage.shape_records(records(spark))
    folded = {r["asset"]: r for r in lineage.fold_records(shaped).collect()}
    assert set(folded) == {"core.orders", "dashboard:Revenue"}
    orders = folded["core.orders"]
    assert orders["record_count"] == 2 and orders["layer"] == "core" and orders["team"] == "ops"
    assert orders["sla_hours"] is None and orders["replicated"] is True
    assert folded["dashboard:Revenue"]["layer"] == "bi"
    assert rows(lineage.fold_lists(shaped, "owners", "owner")) == [
        ("core.orders", "ann"),
        ("core.orders", "bo"),
    ]
    # The modelling record comes first in urn order, and it has columns of its own.
    assert rows(lineage.fold_columns(shaped)) == [("core.orders", "other", "unknown", True)]


def test_edges_drop_unknown_ends_and_links_between_siblings(spark, rows):
    keys = spark.createDataFrame(
        [("u1", "a"), ("u2", "a"), ("u3", "b")], "urn string, asset string"
    )
    ups = spark.createDataFrame(
        [("u3", "u1"), ("u3", "u2"), ("u1", "u2"), ("u3", "lost"), ("lost", "u1")],
        "urn string, upstream_urn string",
    )
    assert rows(lineage.resolve_edges(ups, keys)) == [("a", "b")]


def test_unanswered_column_pairs_stay_and_are_marked(spark, rows):
    probes = spark.createDataFrame([("a", "x", "b")], "source string, source_column string, target string")
    columns = spark.createDataFrame([("b", "p"), ("b", "q"), ("b", "r")], "asset string, column_name string")
    paths = spark.createDataFrame(
        [("a", "x", "b", "p", True), ("a", "x", "b", "q", False)],
        "source string, source_column string, target string, target_column string, connected boolean",
    )
    assert rows(lineage.resolve_column_edges(probes, columns, paths)) == [
        ("a", "x", "b", "p", False),
        ("a", "x", "b", "r", True),
    ]


def test_fingerprint_changes_with_metadata_not_with_order(spark):
    def build(owner, flip=False):
        assets = [asset("a.x"), asset("a.y")]
        links = [("a.x", "a.y"), ("a.x", "a.y")]
        return graph(spark, assets[::-1] if flip else assets, links[: 2 - flip], owners=[("a.x", owner)])

    fp = lambda g: g.fingerprint().first()["fingerprint"]
    assert fp(build("ann")) == fp(build("ann", True)) != fp(build("bo"))


def test_gap_finder(spark, rows):
    g = graph(
        spark,
        [asset("landing.a"), asset("core.b"), asset("landing.alone")],
        [("landing.a", "core.b")],
        column_edges=[("landing.a", "traced", "core.b", "z")],
        columns=[("landing.a", "traced"), ("landing.a", "known"), ("landing.a", "gap"),
                 ("landing.alone", "c"), ("core.b", "z")],
    )
    declared = spark.createDataFrame([("landing.a", "known")], "asset string, column_name string")
    assert rows(lineage.lineage_gaps(g, ["landing"], declared)) == [("landing.a", "gap", 1)]


def test_containment(spark, rows):
    keys = spark.createDataFrame([("t", "ft"), ("f1", "f1"), ("f2", "f2")], "urn string, asset string")
    groups = spark.createDataFrame([("t", ["f1", "f2", "gone", "t"])], "urn string, members array<string>")
    assert rows(lineage.containment_edges(groups, keys)) == [("f1", "ft"), ("f2", "ft")]


def test_neighbours_and_summary(spark, rows):
    g = graph(spark, [asset("core.a"), asset("core.b", replicated=False)], [("core.a", "core.b")])
    assert len(rows(lineage.neighbours(g.edges))) == 2
    line = lineage.summary(g).where(F.col("layer") == "core").first()
    assert (line["assets"], line["unowned"], line["unreplicated"], line["outgoing_edges"]) == (2, 2, 1, 1)
