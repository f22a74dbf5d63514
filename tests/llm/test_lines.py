import random
import re

import numpy as np
import pytest

from undertow.llm import lines

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, similarity=0.8):
    """Lines kept per row: those without an earlier match, by key, text mark aside."""
    seen, out = [], {}
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for key, text in order:
        kept = []
        for line in text.split("\n"):
            words = frozenset(WORD.findall(line.encode().lower()))
            alike = any(len(words & s) >= similarity * len(words | s) - 1e-9 for s in seen) if words else False
            if words:
                seen.append(words)
            if not alike:
                kept.append(line)
        out[key, text] = "\n".join(kept)
    return [(k, out.get((k, t), t)) for k, t in rows]


def corpus(seed):
    random.seed(seed)
    vocabulary = ["the", "of", "and"] * 30 + [f"w{i}" for i in range(300)]
    base = [[random.choice(vocabulary) for _ in range(random.randrange(1, 30))] for _ in range(25)]
    texts = []
    for _ in range(120):
        found = []
        for _ in range(random.randrange(1, 6)):
            words = list(random.choice(base))
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            if random.random() < 0.3:
                random.shuffle(words)
            found.append(random.choice([" ", ", "]).join(words))
        texts.append("\n".join(found))
    return texts


@pytest.mark.parametrize("limit, crowded", [(4096, 8), (4096, 0), (3, 8)])
def test_agrees_with_all_pairs(spark, docs, monkeypatch, limit, crowded):
    monkeypatch.setattr(lines, "LIMIT", limit)
    monkeypatch.setattr(lines, "CROWDED", crowded)
    texts = corpus(limit + crowded) + [None, "", "\n\n", "...", "A\na\nB", "The.", "é ü", "É ü", "w1 " * 5000 + "\n" + "w1 w2"]
    ids = [*range(len(texts) - 1), None]
    got = lines.dedup(docs(texts, ids))
    want = brute(list(zip(ids, texts)))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert {k: r["text"] for k, r in rows.items()} == dict(want)
    assert rows[0]["key"] == "k" and rows[0]["id"] == 3  # clashing names of the caller's columns are kept
    assert all(r["n_lines"] == (t.count("\n") + 1 if t is not None else 0) for t, r in ((t, rows[i]) for i, t in zip(ids, texts)))


def test_repeated_rows_and_no_rows(spark, docs):
    got = lines.dedup(docs(["a b\nc", "a b\nc", "c\nd"], [1, 1, 1])).collect()
    assert sorted(r["text"] for r in got) in (["a b", "a b", "c\nd"], ["a b\nc", "a b\nc", "d"])
    assert lines.dedup(docs([])).count() == 0


def test_rows_without_a_key_are_documents_of_their_own(spark, docs):
    """Of equal ones a single row keeps its lines; lines without words stay in all."""
    texts = ["a b\n--\nc", "a b\n--\nc", "a b\n--\nc", "c\né", None, None, "", "--", "--", "b a\nx y z"]
    ids = [None] * 9 + [1]
    got = lines.dedup(docs(texts, ids))
    rows = got.collect()
    assert got.columns == [*docs([]).columns, "n_lines", "n_removed"] and len(rows) == len(texts)
    long = sorted(r["text"] for r in rows if r["n_lines"] == 3)
    assert long[:2] == ["--", "--"] and "a b" in long[2]
    assert sum(r["text"].split("\n").count("c") for r in rows if r["text"]) == 1
    assert [(r["text"], r["n_removed"]) for r in rows if r["doc_id"] == 1] == [("x y z", 1)]
    rest = sorted((r["text"] is None, r["text"] or "", r["n_removed"]) for r in rows if not r["text"] or r["text"] == "--" and r["n_lines"] == 1)
    assert rest == [(False, "", 0), (False, "--", 0), (False, "--", 0), (True, "", 0), (True, "", 0)]
    assert sum(r["n_removed"] for r in rows) == 2 + 2 + 1 + 1


def test_prefixes_meet():
    """Two sets of the same order that are similar enough share a token in their prefixes."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = set(rng.choice(40, rng.integers(1, 30), replace=False).tolist())
        y = set(list(x)[: max(1, len(x) - int(rng.integers(0, 4)))]) | set(rng.choice(40, rng.integers(0, 4)).tolist())
        if len(x & y) >= 0.8 * len(x | y):
            p, q = (sorted(s)[: int(lines.prefix_length(len(s)))] for s in (x, y))
            assert set(p) & set(q)


def test_columns_of_any_name_are_carried(spark):
    kind = "doc_id bigint, text string, _doc string, _gone int, n_lines int, n_removed string, key int, row int, mark int"
    rows = [(1, "a b\nc", "x", 7, 8, "y", 1, 2, 3), (2, "a b\nd", "x", 7, 8, "y", 1, 2, 3), (None, "a b", "z", 7, 8, "y", 1, 2, 3)]
    got = lines.dedup(spark.createDataFrame(rows, kind))
    assert got.columns == [c.split()[0] for c in kind.split(", ")] + ["n_lines_", "n_removed_"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert [found[k]["text"] for k in (None, 1, 2)] == ["a b", "c", "d"]
    assert all((r["n_lines"], r["n_removed"], r["_gone"], r["row"]) == (8, "y", 7, 2) for r in found.values())
    assert [found[k]["n_removed_"] for k in (None, 1, 2)] == [0, 1, 1] and found[1]["n_lines_"] == 2


def test_all_words_are_hashed_at_once():
    """Equal words have equal hashes and others do not, whatever their length; lines and texts are told apart."""
    random.seed(5)
    some = [bytes(random.choices(b"ab\xc3\xa9019", k=k)) for k in [*range(1, 20), 24, 63, 64, 65, 72, 200] for _ in range(8)]
    texts = [b"", b"\n\n", b" \n.", b"A\na\nB"]
    for _ in range(200):
        texts.append(b"".join(random.choice(some) + random.choice([b" ", b", ", b"\n", b"\t", b"\r\n", b"."]) for _ in range(30)))
    want = [[line.split() for line in t.translate(lines._WORD_BYTES).split(b"\n")] for t in texts]
    hashes, lengths, counts = lines.word_hashes(texts)
    assert counts.tolist() == [len(w) for w in want]
    assert lengths.tolist() == [len(f) for w in want for f in w]
    named = list(zip((x for w in want for f in w for x in f), hashes.tolist(), strict=True))
    assert len(set(named)) == len({w for w, _ in named}) == len({h for _, h in named})
    ids = lines.line_ids(hashes, lengths[lengths > 0]).tolist()
    both = set(zip((tuple(f) for w in want for f in w if f), ids, strict=True))
    assert len(both) == len({f for f, _ in both}) == len({i for _, i in both})
    assert [len(c) for c in lines.word_hashes([])] == [0, 0, 0]


def test_postings_travel_many_in_a_row(spark, docs):
    """A task sends a row for each bucket of tokens and not for each token; none is lost."""
    frame = docs(corpus(1)).coalesce(2)
    survey = lines._survey(lines._identified(frame, "doc_id"))
    rarity, words = lines._rarity(survey)
    assert words == sum(len(WORD.findall(line.lower().encode())) for text in corpus(1) for line in text.split("\n"))
    sent = lines._postings(lines._identified(frame, "doc_id"), rarity, 0.8, 8).collect()
    assert len(sent) <= 16 and {r["bucket"] for r in sent} == set(range(8))
    found = {tuple(row) for r in sent for row in np.frombuffer(r["postings"], np.int64).reshape(-1, 5)[:, :2].tolist()}
    distinct = {tuple(WORD.findall(line.lower().encode())) for text in corpus(1) for line in text.split("\n")}
    assert len(found) == sum(int(lines.prefix_length(len(set(f)))) for f in distinct)


@pytest.mark.parametrize("limit, held", [(4096, 1 << 20), (3, 1 << 20), (3, 5), (4096, 5)])
def test_buckets_in_many_batches(spark, docs, monkeypatch, limit, held):
    """Buckets that come piece by piece, tokens that turn out to be crowded on the way, and pairs put out early."""
    texts = corpus(9)
    want = dict(brute(list(enumerate(texts))))
    monkeypatch.setattr(lines, "LIMIT", limit)
    for name, value in (("_HELD", held), ("_TRIED", 50), ("_BUCKET_WORDS", 2000), ("_SENT", 1)):
        monkeypatch.setattr(lines, name, value)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        got = {r["doc_id"]: r["text"] for r in lines.dedup(docs(texts).repartition(3)).collect()}
    finally:
        spark.conf.set(name, before)
    assert got == want
