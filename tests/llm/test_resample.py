import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from undertow.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def buckets(texts):
    counts = Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])
    return [counts[i] for i in range(10000)]


def brute(rows, target):
    s, t = buckets([text for _, text in rows]), buckets(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found) // len(found) if found else 0
        x = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words)])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def texts(n):
    vocabulary = ["the", "The", "é", "ß", "a1", "of", "x" * 200, "日本"] + [f"w{i}" for i in range(200)]
    gaps = [" ", "  ", ", ", "\n", "\x00", "--", "\x7f"]
    return ["".join(random.choice(vocabulary) + random.choice(gaps) for _ in range(random.choice([0, 1, 5, 19, 20, 21, 60]))) for _ in range(n)]


def test_agrees_with_counting_in_memory(spark, docs):
    random.seed(3)
    found = texts(150) + [None, "", "...", "one", "A b\nC", "w1 " * 40_000, "y" * 300_000] + ["the same " * 15] * 5
    ids = [*range(len(found) - 7), None, None, 3, 3, 3, 9, 9]
    target = texts(20) + [None, ""]
    got = resample.resample(docs(found, ids), docs(target)).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == brute(list(zip(ids, found)), target)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_documents_and_no_target(spark, docs, n):
    found = ["word " * 30] * n
    got = resample.resample(docs(found), docs([]))
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str) == brute(list(enumerate(found)), [])


def test_hashes_are_those_of_the_library():
    random.seed(1)
    for length in (*range(70), 127, 128):
        rows = [random.randbytes(length) for _ in range(5)]
        matrix = np.frombuffer(b"".join(rows), np.uint8).reshape(5, length)
        assert resample.xxh64(matrix).tolist() == [xxhash.xxh64_intdigest(r) for r in rows]


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    """With one hash for all strings every n-gram still has a slot of its own."""
    monkeypatch.setattr(resample, "xxh64", lambda strings: np.zeros(len(strings), np.uint64))
    random.seed(2)
    data, starts, ends, owner, words = resample.ngrams([t.encode() for t in texts(12)])
    table = resample.Interned(data, starts, ends)
    flat = data.tobytes()
    found = [flat[a:b] for a, b in zip(starts, ends)]
    assert len(set(zip(found, table.slots.tolist()))) == len(set(found)) == len(set(table.slots.tolist()))
    assert all(table.count[s] == found.count(f) and table.bucket[s] == zlib.crc32(f) % 10000 for f, s in zip(found, table.slots))


def test_documents_like_the_target_are_drawn_more_often(spark, docs):
    random.seed(5)
    near, far = ([" ".join(random.choice(v) for _ in range(30)) for _ in range(200)] for v in (["a", "b", "c"], ["x", "y", "z"]))
    drawn = resample.resample(docs(near + far), docs(["a b c a c b"] * 50)).where("rank is not null").collect()
    assert len(drawn) == 100 and sum(r["doc_id"] < 200 for r in drawn) > 90
