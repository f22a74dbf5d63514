import datetime as dt

from pyspark.sql import functions as F

from graphs import asset, graph
from undertow.operators import history, quality
from undertow.sources import ledgers, scopes, sinks


def attempts(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "line_no bigint, attempted_at string, status string, stage string, target string",
    )


READS = "target string, read_at string"


def test_missed_runs_are_held_against_their_own_target(spark):
    a = attempts(
        spark,
        ("2026-01-02T00:00:00Z", "failed", "read", "one"),  # after one's run: missed
        ("2026-01-02T00:00:00Z", "failed", "read", "two"),  # before two's run
        ("2026-01-02T00:00:00Z", "failed", "start", None),  # before the newest of any
        ("2026-01-09T00:00:00Z", "failed", "start", None),
        ("2026-01-09T00:00:00Z", "succeeded", "done", "one"),
        ("last night", "failed", "read", "one"),
        ("2026-01-09T00:00:00Z", None, "read", "new"),
    )
    reads = spark.createDataFrame([("one", "2026-01-01T00:00:00Z"), ("two", "2026-01-05T02:00:00+02:00")], READS)
    assert sorted(r["line_no"] for r in history.missed(a, reads).collect()) == [0, 3, 6]


def test_freshness(spark):
    now = F.lit("2026-01-02 01:00:00").cast("timestamp")
    say = lambda *rows: history.freshness(attempts(spark, *rows), now).first()["verdict"]
    ok = ("2026-01-01T23:00:00Z", "succeeded", "done", "one")
    assert say(ok) == "alive"
    assert say(ok, ("2026-01-02T00:30:00Z", "failed", "read", "one")) == "last run failed"
    assert say(("2025-12-31T23:00:00Z", "succeeded", "done", "one")) == "stale"
    assert say() == "never run" and say(("nonsense", "succeeded", "done", "one")) == "never run"


def test_evidence_named_then_same_day_then_earlier(spark):
    reads = spark.createDataFrame(
        [
            (1, "one", "2026-01-05T12:00:00Z", "c3"),
            (2, "one", "2026-01-05T12:00:00Z", "lost"),
            (3, "one", "2026-01-05T12:00:00Z", None),
            (4, "one", "2026-01-06T12:00:00Z", None),
            (5, "two", "2026-01-06T12:00:00Z", None),
            (6, "one", "2026-01-05T12:00:00Z", "other"),
        ],
        "line_no bigint, target string, read_at string, verification_artifact string",
    )
    at = dt.datetime
    captures = spark.createDataFrame(
        [
            ("c1", "one", at(2026, 1, 5, 9)),
            ("c2", "one", at(2026, 1, 5, 11)),
            ("c3", "one", at(2026, 1, 5, 18)),
            ("other", "two", at(2026, 1, 7, 1)),
        ],
        "path string, target string, generated_at timestamp",
    )
    got = {r["line_no"]: (r["evidence"], r["how"]) for r in history.evidence(reads, captures).collect()}
    assert got == {
        1: ("c3", "named"),
        2: (None, "named capture is missing"),
        3: ("c2", "same day"),
        4: ("c3", "earlier"),
        5: (None, "none"),
        6: (None, "named capture is missing"),  # another target's capture is never evidence
    }


def test_attempts_that_may_not_be_recorded(spark):
    a = attempts(
        spark,
        ("2026-01-01T00:00:00Z", "succeeded", "done", "one"),
        ("2026-01-01T00:00:00Z", "crashed", " ", "one"),
        ("soon", "failed", "read", None),
    )
    got = {r["line_no"]: r["reasons"] for r in history.invalid_attempts(a).collect()}
    assert got == {1: "status,stage", 2: "attempted_at"}


def test_changes_and_latest(spark):
    reads = spark.createDataFrame(
        [(1, "one", "2026-01-01T00:00:00Z", "x"), (2, "one", "2026-01-02T00:00:00Z", "x"),
         (3, "one", "2026-01-03T00:00:00Z", "y"), (4, "one", "never", "z")],
        "line_no bigint, target string, read_at string, fingerprint string",
    )
    got = {r["line_no"]: r["change"] for r in history.changes(reads.where("line_no < 4")).collect()}
    assert got == {1: "first", 2: "same", 3: "changed"}
    assert history.latest(reads, ["target"], "read_at", "line_no").first()["fingerprint"] == "y"


def test_the_last_stated_metric_counts(spark):
    lines = spark.createDataFrame(
        [("one", 1, "precision 0.5 recall 0.25"), ("one", 2, "x precision 0.75 recall 1.00"), ("one", 3, "done"),
         ("two", 1, "nothing")],
        "target string, line_no int, text string",
    )
    got = {r["target"]: tuple(r)[1:] for r in history.captured_metrics(lines, ["target"]).collect()}
    assert got == {"one": (0.75, 1.0, True), "two": (None, None, False)}


def test_ledger_keeps_good_lines_and_reports_bad_ones(spark, tmp_path):
    lines = spark.createDataFrame(
        [(1, '{"a":"x","n":1}'), (2, "  "), (3, '{"a":"y"'), (4, '{"a":"z"}')], "line_no int, text string"
    )
    parsed = ledgers.parse_lines(lines, "a string, n bigint")
    good = ledgers.records(parsed).orderBy("line_no").collect()
    assert [tuple(r) for r in good] == [(1, "x", 1), (4, "z", None)]
    assert [r["line_no"] for r in ledgers.complaints(parsed).collect()] == [3]
    path = str(tmp_path / "ledger")
    for n in (1, 2):
        ledgers.append(spark.createDataFrame([("t", n)], "target string, n int"), path, ["target"])
    back = ledgers.read_ledger(spark, path, "n int, later string")
    assert sorted(r["n"] for r in back.collect()) == [1, 2] and "_corrupt" in back.columns


def test_snapshots_are_stored_once_per_content(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    g = graph(spark, [asset("a.x"), asset("a.y")], [("a.x", "a.y")], columns=[("a.x", "c")], owners=[("a.x", "ann")],
              column_edges=[("a.x", "c", "a.y", "d")])
    first = sinks.store_snapshot(g, folder, "2026-01-01T00:00:00Z", "here")
    second = sinks.store_snapshot(g, folder, "2026-01-02T00:00:00Z", "there")
    assert first == (second[0], True) and second[1] is False
    changed = graph(spark, [asset("a.x")], [], owners=[("a.x", "bo")])
    third = sinks.store_snapshot(changed, folder, "2026-01-03T00:00:00Z", "here")
    assert third[1] and sinks.latest_fingerprint(sinks.snapshots(spark, folder)).first()[0] == third[0]
    assert sinks.load_snapshot(spark, folder, first[0]).fingerprint().first()[0] == first[0]


def test_load_counts_and_refresh_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.load(spark.range(5), path) == 5 and sinks.load(spark.range(3), path) == 3
    assert spark.read.parquet(path).count() == 8
    assert sinks.refresh(spark.range(2), path).count() == 2


def test_materialized_models_feed_each_other(w, tmp_path):
    names = ["stg_orders", "stg_fx_rates", "int_orders_enriched"]
    built = sinks.materialize(w, names, str(tmp_path))
    assert built["int_orders_enriched"].count() == w["int_orders_enriched"].count()
    assert "int_orders_enriched" in built["mart_revenue_daily"].inputFiles()[0] or built["mart_revenue_daily"].count()


def test_scope(spark):
    inside = scopes.accepts(F.col("u"), "wh.core.", "wh", ("urn:li:chart:",))
    us = {
        "urn:li:dataset:(urn:li:dataPlatform:postgres,wh.core.a,PROD)": True,
        "urn:li:dataset:(urn:li:dataPlatform:postgres,wh.raw.a,PROD)": False,
        "urn:li:dataset:(urn:li:dataPlatformInstance:(urn:li:dataPlatform:dbt,wh),wh.core.a,PROD)": True,
        "urn:li:dataset:(urn:li:dataPlatformInstance:(urn:li:dataPlatform:dbt,xx),wh.core.a,PROD)": False,
        "urn:li:chart:(bi,a)": True,
        "urn:li:dashboard:(bi,a)": False,
    }
    got = spark.createDataFrame([(u,) for u in us], "u string").select("u", inside.alias("x")).collect()
    assert {r["u"]: r["x"] for r in got} == us
    every = scopes.accepts(F.col("u"), "wh.core.")
    df = spark.createDataFrame([("urn:li:dashboard:(bi,a)",)], "u string").select(every.alias("x"))
    assert df.first()["x"] is True


def test_model_path_and_append_once(spark, rows):
    features = spark.createDataFrame([("ft", "f1"), ("ft", "f2")], "feature_table string, feature string")
    models = spark.createDataFrame(
        [("m", "f2", "prod"), ("n", "f1", None)], "model string, feature string, deployment string"
    )
    assert rows(quality.model_path(features, models)) == [("ft", "m", "prod", "f2")]
    runs = spark.createDataFrame([("r1", "one"), ("r1", "two"), ("r1", "two")], "run_id string, target string")
    assert rows(quality.appended_once(runs, "r1")) == [("one", 1, True), ("two", 2, False)]


def test_a_ledger_says_file_and_line_of_what_is_bad(spark, tmp_path):
    """Several files, read in small blocks: numbers are those an editor shows, blank lines included."""
    folder, want = tmp_path / "ledger", []
    for part, n in (("a", 400), ("b", 1), ("c", 0), ("d", 250)):
        (folder / f"target={part}").mkdir(parents=True)
        lines = ["" if i % 7 == 3 else '{"n": ' if i % 11 == 5 else '{"n": %d, "pad": "%s"}' % (i, "é" * (i % 60)) for i in range(1, n + 1)]
        (folder / f"target={part}" / "lines.json").write_text("\n".join(lines) + ("\n" if n % 2 else ""))
        want += [(part, i, t) for i, t in enumerate(lines, 1) if t]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        back = ledgers.read_ledger(spark, str(folder), "n bigint, later string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["target"], r["line_no"]) for r in back) == [(p, i) for p, i, _ in want]
    bad = {(r["target"], r["line_no"]) for r in back if r["_corrupt"] is not None}
    assert bad == {(p, i) for p, i, t in want if t == '{"n": '} and len(bad) > 50
    assert all(r["n"] == r["line_no"] for r in back if r["_corrupt"] is None)
    assert all(f"target={r['target']}/lines.json" in r["file"] for r in back)


def test_the_trend_reads_what_a_scoring_run_writes(spark):
    from undertow.operators import knockout

    scored = spark.createDataFrame([("a.x", 61.5, 10.0), ("a.y", 3.25, 0.0)], "origin string, score double, cost double")
    row = knockout.history_row(scored, "fleet", "fp", "now").withColumn("line_no", F.lit(1))
    found = history.trend(row).first()
    kept = history.trend(row.withColumn("top", F.to_json("top"))).first()
    assert tuple(found) == tuple(kept) == ("fleet", 1, "now", 32.375, "a.x", 61.5)
    older = [("t", 1, '["a.z","a.x"]'), ("t", 2, "[]"), ("t", 3, None), ("t", 4, "nonsense"), ("t", 5, '[{"score": 2.0}]')]
    rows = spark.createDataFrame([(*r, "now", 1.0) for r in older], "target string, line_no int, top string, scored_at string, mean_score double")
    assert [(r["most_fragile"], r["score"]) for r in history.trend(rows).orderBy("line_no").collect()] == [
        ("a.z", None), ("—", None), ("—", None), ("—", None), ("—", 2.0)]
