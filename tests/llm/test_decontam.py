import random
import re

import corpus_pipeline
from undertow.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, window=10):
    found = WORD.findall((text or "").encode().translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))))
    hit, names = set(), set()
    for item, body in items:
        w = WORD.findall((body or "").encode().lower())
        size = min(window, len(w))
        pats = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(found) - size + 1):
            if size and tuple(found[i : i + size]) in pats:
                hit |= set(range(i, i + size))
                names.add(str(item))
    return len(found), len(hit), len(names), sorted(names)


def cases():
    random.seed(5)
    say = lambda n, k: " ".join(random.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, say(random.choice([1, 2, 3, 9, 10, 11, 25]), 4)) for i in range(12)] + [(50, ""), (51, None), (52, "É ü-ñ"), (52, "dup")]
    texts = [say(random.randrange(0, 120), 5) for _ in range(40)] + [None, "", "!!!", "x é Ü-ñ É, ü ñ", "DUP"]
    texts += [items[4][1].upper() + ", " + items[6][1] + "."]
    return texts, items


def test_rows_agree_with_brute_force(spark, docs):
    texts, items = cases()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(i, *brute(t, items)[:3]) for i, t in enumerate(texts)]
    for limit in (decontam.PASS_BYTES, 40):  # one pass, and several
        found = decontam.hits(docs(texts), benchmark, pass_bytes=limit)
        rows = decontam.digest(found).orderBy("doc_id").collect()
        assert [tuple(r)[:4] for r in rows] == want
        assert [r["items"] for r in found.orderBy("doc_id").collect()] == [brute(t, items)[3] for t in texts]


def test_several_passes_over_rows_with_their_text_inside(spark, docs):
    """As the pipeline hands documents over: one column, and no text beside it."""
    texts, items = cases()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    given = docs(texts)
    for limit in (decontam.PASS_BYTES, 40):
        found = decontam.hits(corpus_pipeline._rows(given), benchmark, key="row", pass_bytes=limit)
        assert found.columns == ["row", "n_words", "spans", "items"]
        rows = sorted(found.collect(), key=lambda r: r["row"]["doc_id"])
        assert [r["row"] for r in rows] == given.orderBy("doc_id").collect()
        assert [(r["n_words"], r["items"]) for r in rows] == [(b[0], b[3]) for b in (brute(t, items) for t in texts)]
        assert [sum(s["end"] - s["first"] for s in r["spans"]) for r in rows] == [brute(t, items)[1] for t in texts]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[1:4] for r in decontam.digest(decontam.hits(docs(["a b"]), none)).collect()] == [(2, 0, 0)]
    assert decontam.hits(docs([]), none).count() == 0
