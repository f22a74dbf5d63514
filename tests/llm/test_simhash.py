import random

import numpy as np
import pytest
import xxhash

from undertow.llm import components, simhash


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))).split()
    parts = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64(b" ".join(p), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps, threshold=2):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_the_code_covers():
    """Every fingerprint has one home, and whoever is within the threshold comes to it."""
    rng = np.random.default_rng(1)
    fps = rng.integers(-(1 << 63), 1 << 63, 300, dtype=np.int64)
    near = fps.copy()
    for k in range(2):
        near ^= np.int64(1) << rng.integers(0, 63, 300)
    who, anchor, home = simhash.anchors(fps)
    assert np.bincount(who[home]).tolist() == [1] * 300
    assert np.bincount(who).max() <= 68
    came, place, _ = simhash.anchors(near)
    visits = {(w, a) for w, a in zip(came.tolist(), place.tolist())}
    assert all((w, a) in visits for w, a in zip(who[home].tolist(), anchor[home].tolist()))
    assert anchor.min() >= 0 and anchor.max() < 1 << 24


@pytest.mark.parametrize("crowded", [256, 1])
def test_links_of_planted_fingerprints(spark, crowded):
    random.seed(2)
    fps = [random.getrandbits(64) for _ in range(60)]
    for base in list(fps[:20]):
        for n in (1, 1, 2, 2, 2, 3, 4):
            fps.append(base ^ sum(1 << b for b in random.sample(range(64), n)))
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    got = {(r["u"], r["v"]) for r in simhash.links(frame, crowded=crowded).where("u <> v").collect()}
    assert all(bin((u ^ v) & (2**64 - 1)).count("1") <= 2 for u, v in got)
    ends = components.labelled(frame, "fp", simhash.links(frame, crowded=crowded), "root").collect()
    root = {r["fp"]: r["root"] for r in ends}
    want = brute_components(fps)
    for i, x in enumerate(fps):
        assert root[signed(x)] == min(signed(y) for y, w in zip(fps, want) if w == want[i])


def test_groups_of_documents(spark, docs):
    random.seed(4)
    base = [" ".join(random.choice("abcdefghijklmnop") * 3 for _ in range(200)) for _ in range(10)]
    texts = base + [b.upper() for b in base] + [b + " tail" for b in base] + [None, "", " \n", "One", "one", "a b", "x" * 100_000]
    ids = list(range(100, 100 + len(texts)))
    ids[4], ids[5] = ids[5], ids[5]
    got = simhash.groups(docs(texts, ids)).select("doc_id", simhash.hexadecimal("fp").alias("h"), "component_id").collect()
    fps = [brute_fingerprint(t) for t in texts]
    labels = brute_components(fps)
    least = {w: min(i for i, x in zip(ids, labels) if x == w) for w in labels}
    want = [(i, f"{f:016x}", least[w]) for i, f, w in zip(ids, fps, labels)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert simhash.groups(docs([])).count() == 0


def test_components_of_chains_stars_and_odd_rows(spark):
    edges = [(i + 1, i) for i in range(100, 140)] + [(200, x) for x in range(201, 240)] + [(5, 5), (None, 3), (7, 6), (7, 6)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["u"]: r["v"] for r in components.stars(frame).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 200 for i in range(201, 240)}, 7: 6}
