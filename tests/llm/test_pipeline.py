import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from undertow.llm import bpe
from undertow.session import pin

from .test_decontam import brute as hits
from .test_lines import brute as lines
from .test_simhash import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus in which each stage has something to do."""
    random.seed(11)
    say = lambda lang, n: " ".join("".join(random.choices(lang, k=3)) for _ in range(n))
    xx, yy = ["ka", "to", "mi", "ru", "ne", "so"], ["sch", "ung", "eit", "ver", "ge", "lich"]
    items = [(i, say(xx, 14)) for i in range(3)] + [(3, say(xx, 6))]
    texts = [(say(lang, 40) + "\n" + say(lang, 30), name) for lang, name in ((xx, "xx"), (yy, "yy")) for _ in range(25)]
    texts += [(texts[3][0], "xx"), (texts[30][0].replace(" ", "  ", 3), "yy")]  # copies
    texts += [(say(xx, 20) + "\n" + texts[5][0].split("\n")[1] + " mikato", "xx")]  # a line that is nearly there already
    texts += [(say(xx, 10) + " " + items[k][1].upper() + ". " + say(xx, 10), "xx") for k in (0, 2, 3)]  # leaks
    texts += [(None, "xx"), ("", "yy"), ("12 ... 3", None), (texts[8][0] + " toru kami", "xx")]
    rows = [(i, t, l, f"s{i % 3}", len(t) if t is not None else None) for i, (t, l) in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_each_stage_on_its_own_input(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts_of(docs)
        docs = pin(stage(spark, docs, folder), "test")
        after = texts_of(docs)
        assert docs.columns == columns and after
        if name == "language_id":
            assert after == {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}
        if name == "line_dedup":
            want = {i: t for i, t in lines(sorted(before.items()))}
            assert after == {i: t for i, t in want.items() if t.strip()} and len(after) < len(before)
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "simhash":
            ids = sorted(before)
            group = brute_components([brute_fingerprint(before[i]) for i in ids])
            assert sorted(after) == [i for k, i in enumerate(ids) if group.index(group[k]) == k]
        if name == "decontamination":
            assert after == {i: t for i, t in before.items() if not hits(t, items)[1]} and len(after) == len(before) - 3


def test_the_whole_run(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = pin(stage(spark, docs, folder), "test")
    kept = {r["doc_id"]: r for r in docs.collect()}
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    import public_tokenizers

    ranks = bpe.load(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    assert set(rows) == set(kept)
    for i, r in rows.items():
        text = kept[i]["text"]
        assert (r["lang"], r["source"]) == (kept[i]["lang"], kept[i]["source"])
        assert bytes(r["ids"]) == ranks.encode([text])[0] and r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4"))
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_take_empty_and_odd_tables(spark, corpus):
    folder, _ = corpus
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    odd = spark.createDataFrame(
        [(None, "kato miru", None, None, None), (None, "kato miru", None, None, None), (7, None, "xx", "s", 0)], empty.schema
    )
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, pin(empty, "test"), folder).count() == 0
        stage(spark, pin(odd, "test"), folder).count()
    assert corpus_pipeline.keep_one_of_each_group(spark, pin(odd, "test"), folder).count() == 2


def test_stages_carry_columns_of_any_name(spark, corpus):
    from pyspark.sql import functions as F

    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ("row", "_row", "_place", "place", "first", "n_lines", "n_removed", "_doc", "_gone", "key", "label", "lang_pred", "score", "items")
    odd = docs.withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns
        assert got.where(" or ".join(f"{n} <> '{n}'" for n in names)).isEmpty()
        assert sorted(r[0] or -1 for r in got.select("doc_id").collect()) == sorted(r[0] or -1 for r in stage(spark, docs, folder).select("doc_id").collect())
