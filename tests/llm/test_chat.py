import hashlib

from pyspark.sql import functions as F

from undertow.llm import chat


def folded(spark, rows):
    log = spark.createDataFrame(rows, "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string")
    return {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold(log).collect()}


def test_deltas_edits_and_regenerations(spark):
    got = folded(
        spark,
        [
            (1, 0, 1, "message", "user", "hi"),
            (1, 1, 2, "delta", "assistant", "wr"),
            (1, 1, 3, "delta", None, "ong"),
            (1, 1, 4, "regenerate", None, "ignored"),
            (1, 1, 5, "delta", None, "ri"),
            (1, 1, 6, "delta", None, "ght"),
            (1, 2, 7, "message", "user", "gone"),
            (1, 0, 8, "edit", None, "hello"),
            (1, 1, 9, "delta", "assistant", "new"),
            (2, 0, 1, "message", "user", None),
            (None, 0, None, "delta", None, "a"),
        ],
    )
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "new"), (2, 0): ("user", ""), (None, 0): (None, "a")}


ROWS = [
    (1, 0, "user", "say </s> and \\</s> and [INST]\\"),
    (1, 1, "assistant", "</s>[INST] ok [/INST]\n <s> \\\\[/INST] </s>\n"),
    (1, 1, "assistant", ""),
    (2, None, None, None),
    (2, 3, "ro\\le\n[INST]", "x\ny"),
    (2, 3, "ro\\le\n[INST]", "x\ny"),
    (None, 5, "assistant", "é🙂" * 500),
    (3, None, "assistant", "no turn"),
]


def test_everything_is_read_back(spark):
    table = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    rendered = chat.render(chat.fold(chat.events(table)))
    got = {r["conv_id"]: r for r in chat.digest(rendered).collect()}
    for conv in (1, 2, 3, None):
        rows = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
        learnt = "".join(r[3] or "" for r in rows if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(rows)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.digest(chat.render(chat.fold(chat.events(table.limit(0))))).count() == 0


def test_texts_are_made_of_deltas_and_first_attempts_are_gone(spark):
    table = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    log = chat.events(table, 3)
    kinds = {(r["kind"], r["n"]) for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    learnt = [r for r in ROWS if r[2] == "assistant"]
    deltas = sum(max(1, -(-len(r[3] or "") // 3)) for r in ROWS) + len(learnt)
    assert kinds == {("delta", deltas), ("regenerate", len(learnt))}
    assert log.where("length(text) > 32").isEmpty()
    got = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in chat.fold(log).collect()]
    assert sorted(got, key=repr) == sorted([(*r[:3], r[3] or "") for r in ROWS], key=repr)
