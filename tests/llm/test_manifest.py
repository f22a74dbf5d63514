import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from undertow.llm import manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, pos bigint, digest string, t int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    fields = (doc_id, source, lang, n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        found.append(nodes)
    return found


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        first = i // 8 * 8
        out += [nodes[j] for j in range(first, min(first + 8, len(nodes))) if j != i]
        i //= 8
    return out


def refold(tree, i, node):
    for nodes in tree[:-1]:
        first = i // 8 * 8
        node = h(*(node if j == i else nodes[j] for j in range(first, min(first + 8, len(nodes)))))
        i //= 8
    return node


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = levels([leaf(r) for r in by[name]])
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(by[name]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            other = leaf((r[0], r[1].translate(LOWER), *r[2:])) if hit else leaf(r)
            root = refold(top, k, refold(trees[name], i, other))
            proof = h(*siblings(trees[name], i), *siblings(top, k))
            out.append((r[0], leaf(r), trees[name][-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "y", 7) for r in rows], DOCS)


@pytest.mark.parametrize("deep", [1, 2, 4])
def test_agrees_with_trees_in_memory(spark, monkeypatch, deep):
    """Blocks of 8, 64 and 4096 leaves: the same proofs, however many rounds of block roots there are."""
    monkeypatch.setattr(manifest, "LEVELS", deep)
    random.seed(deep)
    langs = ["en"] * 20 + ["fr", None, "é", "", "z" * 50]
    rows = [(random.choice([i, i, None, 7]), random.choice(["Ab c", "", None, "é Ü", "X" * 5000]), random.choice(langs), "s", i % 3) for i in range(400)]
    rows += [(900, "same", "en", None, None)] * 9
    assert sorted(map(tuple, manifest.digests(frame(spark, rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73])
def test_trees_of_every_shape(spark, monkeypatch, n):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
    assert sorted(map(tuple, manifest.digests(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_many_trees(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    rows = [(i, "A", f"lang{i % 70}", "s", 1) for i in range(150)]
    assert sorted(map(tuple, manifest.digests(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_no_rows(spark):
    got = manifest.digests(frame(spark, []))
    assert got.count() == 0 and got.columns[:2] == ["doc_id", "leaf"]


def test_a_witness_proves_its_leaf_and_no_other(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "fr", "s", 1) for i in range(100)]
    proofs, root = manifest.manifest(frame(spark, rows))
    assert proofs.where(F.length("witness") % manifest.WIDTH != 0).isEmpty()
    same = manifest.folded(proofs, F.col("leaf")).where(F.lower(F.hex("folded")) != root.decode())
    other = manifest.folded(proofs, F.unhex(F.sha2(F.col("leaf"), 256))).where(F.lower(F.hex("folded")) == root.decode())
    assert same.isEmpty() and other.isEmpty()


def test_heights_and_paths():
    for n in range(1, 600):
        assert len(list(manifest.path(n - 1, n))) == manifest.height(n)
    assert [manifest.height(n) for n in (1, 2, 8, 9, 64, 65, 4096, 4097)] == [0, 1, 1, 2, 2, 3, 4, 5]
