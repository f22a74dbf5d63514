import numpy as np
import pytest

from undertow.llm import vectors


def brute(rows, threshold=0.93):
    n = len(rows)
    ok = [r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    v = [np.array(r[1], float) if o else None for r, o in zip(rows, ok)]
    links, label = [0] * n, [r[0] for r in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]):
                if v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
    return [(r[0], k, c, c == r[0]) for r, k, c in zip(rows, links, label)]


def sample(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 24)).astype(np.float32)
    rows = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=24).astype(np.float32) * rng.choice([0, 0.2, 0.3, 0.4])
        rows.append((1000 + i, [float(np.float32(x)) for x in v * rng.choice([1, 1, 3])], int(rng.integers(0, 3))))
    rows += [(1, rows[0][1], rows[0][2]), (2, None, 0), (3, [0.0] * 24, 0), (4, [float("nan")] + [1.0] * 23, 0), (5, [None] + [1.0] * 23, 0)]
    rows += [(6, rows[0][1], None), (7, [1.0, 2.0], 0), (8, [2.0, 4.0], 0), (9, [], 0), (10, [float("inf")] * 24, 0), (11, [1e-30] * 24, 1), (12, [1e30] * 24, 1)]
    return rows


@pytest.mark.parametrize("tile", [1024, 7])
def test_agrees_with_all_pairs(spark, tile):
    rows = sample()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, label int, u int, component_id int")
    got = [tuple(r) for r in vectors.near(frame, tile=tile).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_stopping_early_loses_nothing():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 50))
    y = np.vstack([x[:50] + rng.normal(size=(50, 50)) * 0.3, rng.normal(size=(100, 50))])
    axes = np.linalg.qr(rng.normal(size=(50, 50)))[0]
    u, w = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(u @ w.T >= 0.93))))
    assert set(zip(*map(np.ndarray.tolist, vectors.compare(x, y, axes, 0.93)))) == want and len(want) > 10


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert vectors.near(frame).count() == 0
    frame = spark.createDataFrame([(1, None, None), (None, [1.0], 1), (2, [1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert sorted(map(tuple, vectors.near(frame).collect()), key=repr) == [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]


def test_a_tile_is_sent_once_per_group_and_each_pair_is_in_one(spark):
    n = 96
    tiles = spark.createDataFrame([(i, 2, [i], [1], b"") for i in range(n)], "tile bigint, size int, ids array<bigint>, copies array<bigint>, vectors binary")
    pairs = [(a, b) for a in range(n) for b in range(a, n)]
    met = vectors._met(tiles, spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert sorted((a, r["tile"]) for r in met if r["side"] for a in r["others"]) == pairs
    held = {(r["ga"], r["gb"], r["tile"]) for r in met if not r["side"]}
    assert all((r["ga"], r["gb"], a) in held for r in met if r["side"] for a in r["others"])
    whole = (n + vectors.PASSING) * (n + vectors.HELD) / 2
    assert len(met) <= whole * (1 / vectors.HELD + 1 / vectors.PASSING) < len(pairs) / 3


def test_moments_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FAN", 2)
    monkeypatch.setattr(vectors, "STRIPE", 5)
    rng = np.random.default_rng(5)
    rows = [(rng.normal(size=n).tolist(),) for n in (12, 3) for _ in range(40)]
    axes = vectors.principal_axes(spark.createDataFrame(rows, "v array<double>").repartition(7))
    for size in (12, 3):
        u = vectors._unit(np.array([r[0] for r in rows if len(r[0]) == size]))
        found = axes[size].T @ (u.T @ u) @ axes[size]
        assert np.allclose(found, np.diag(np.diag(found))) and (np.diff(np.diag(found)) <= 1e-9).all()
    assert vectors.principal_axes(spark.createDataFrame([], "v array<double>")) == {}


def test_a_dense_label_over_many_groups(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (np.ones(6) + rng.normal(size=6) * 0.35).tolist(), 1) for i in range(260)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert sorted(tuple(r) for r in vectors.near(frame, tile=3).collect()) == sorted(brute(rows))
