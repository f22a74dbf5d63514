import math
import random
import zlib

import numpy as np

from undertow.llm import toxicity


def test_tokens_and_disguises():
    assert toxicity.undisguised("1d1o7") == "idiot"
    assert toxicity.undisguised("*st.u.p.iiiid*!") == "stupid"
    assert toxicity.grams("loser") == ["loser", "lose*"]
    tokens = toxicity.Tokens({"idiot": 3.0, "lowe*": 2.0})
    texts = ["You IDIOT!", "id10t you", "loweiß", "fine words", "", "x"]
    dense, _ = toxicity._features(texts, tokens, np.zeros((0, tokens.WIDTH), np.float32))
    column = {f: dense[:, i] for i, f in enumerate(toxicity.FEATURES)}
    assert (column["strongest"] == [3, 3, 2, 0, 0, 0]).all()
    assert (column["near_second_person"] > 0).tolist() == [True, True, False, False, False, False]
    assert (column["disguised"] > 0).tolist() == [False, True, False, False, False, False]
    assert column["capital_words"][0] == 0.5 and np.isfinite(dense).all()


def corpus(n):
    random.seed(8)
    common = [a + b + c for a in "tkmpsr" for b in "aeiou" for c in ("n", "l", "st")]
    bad = ["idiot", "moron", "scum"]
    texts, toxic = [], []
    for i in range(n):
        words = random.choices(common, k=random.randrange(5, 80))
        toxic.append(int(i % 6 == 0))
        if toxic[-1]:
            for _ in range(random.randrange(1, 4)):
                words.insert(random.randrange(len(words)), random.choice(bad))
        texts.append(" ".join(words))
    return texts, toxic


def test_held_out_rows_are_told_apart(spark, docs):
    texts, toxic = corpus(600)
    extra = [None, "", "one idiot " * 20_000, "clean", "clean"]
    ids = [*range(603), None, None]
    labels = [(i, t, "x") for i, t in enumerate(toxic)] + [(3, None, "x"), (None, 1, "x"), (6, 1, "x"), (99999, 1, "x")]
    frame = spark.createDataFrame(labels, "doc_id bigint, toxic int, text string")
    rows = toxicity.score(docs(texts + extra, ids), frame).collect()
    assert len(rows) == 605 and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by_id[i]["held_out"] for i in held) and sum(r["held_out"] for r in rows if (r["doc_id"] or 0) < 600) == len(held)
    assert all((by_id[i]["score"] >= 0.3) == bool(toxic[i]) for i in held)
    assert by_id[602]["score"] >= 0.3 and by_id[601]["score"] < 0.3


def test_labels_of_one_kind_or_none(spark, docs):
    frame = spark.createDataFrame([(i, 1) for i in range(8)], "doc_id bigint, toxic int")
    assert {r["score"] for r in toxicity.score(docs(["a", "b", None]), frame).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(docs(["a", "b"]), frame.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs([]), frame).count() == 0


def test_columns_of_any_name_do_no_harm(spark):
    texts, toxic = corpus(200)
    kind = "doc_id bigint, text string, label int, toxic int, score double, row int, _id bigint, held_out string, _p int"
    frame = spark.createDataFrame([(i, t, 1, 0, 0.5, 3, 4, "x", 5) for i, t in enumerate(texts)], kind)
    labels = spark.createDataFrame([(i, t, "y") for i, t in enumerate(toxic)], "doc_id bigint, toxic int, label string")
    got = toxicity.score(frame, labels)
    plain = toxicity.score(frame.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    assert got.columns == plain.columns == ["doc_id", "held_out", "score"] and got.count() == 200
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def weight_of(weights, word):
    return max((weights.get(g, 0.0) for g in toxicity.grams(word)), default=0.0) if word else 0.0


def naive(text, weights):
    """The features of one text, word by word and character by character."""
    sums, strongest, marks, persons = dict.fromkeys(("n", "hits", "weight", "hidden", "caps", "mixed", "single", "repeated"), 0), 0, [], []
    for token in text.split():
        word, inner = toxicity.plain(token), token.strip(".,;:!?\"'()[]{}*%&#$")
        letters = [c for c in token if c.isalpha()]
        mixed = inner != "" and not inner.isalpha() and letters != []
        repeated = toxicity._REPEATED.search(token) is not None
        weight = weight_of(weights, word) if inner.isalpha() else 0
        hidden = max(weight_of(weights, toxicity.undisguised(token)), weight_of(weights, word)) if not weight and (mixed or repeated) else 0
        weight = weight or hidden
        sums["n"] += 1
        sums["hits"] += weight > 0
        sums["weight"] += weight
        sums["hidden"] += hidden
        sums["caps"] += len(letters) > 1 and all(c.isupper() for c in letters)
        sums["mixed"] += mixed
        sums["single"] += len(letters) == 1 and len(inner) == 1
        sums["repeated"] += repeated
        strongest = max(strongest, weight)
        marks.append(weight > 0)
        persons.append(word in toxicity.SECOND_PERSON)
    near = sum(m and any(persons[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, m in enumerate(marks))
    plain_text = "".join(text.split())
    letters = max(1, sum(c.isalpha() for c in plain_text))
    count = lambda fit: sum(map(fit, plain_text)) / max(1, len(plain_text))
    n, log = max(1, sums["n"]), math.log1p
    other = lambda c: not (c.isalpha() or c.isdigit() or c in "!?")
    return [
        log(sums["n"]), log(sums["hits"]), sums["hits"] / n, log(sums["weight"]), sums["weight"] / n, strongest, log(sums["hidden"]), log(near),
        sum(persons) / n, sum(c.isupper() for c in plain_text) / letters, sums["caps"] / n, count(lambda c: c == "!"), count(lambda c: c == "?"),
        count(other), count(str.isdigit), sums["mixed"] / n, sums["single"] / n, sums["repeated"] / n,
    ]


def test_features_agree_with_counting_one_by_one():
    random.seed(9)
    weights = {"idiot": 3.0, "moron": 2.5, "lowe*": 2.0, "scum": 1.0}
    tokens = toxicity.Tokens(weights)
    words = ["You", "you're", "IDIOT", "id10t", "m0r0n", "scum", "lower", "fine", "HELLO", "a", "ß", "x9", "!!", "...", "scuuuum", "7", "É?!"]
    texts = [" ".join(random.choices(words, k=random.randrange(0, 60))) + random.choice(["", "!", " \n?!"]) for _ in range(300)]
    dense, _ = toxicity._features(texts, tokens, np.zeros((0, tokens.WIDTH), np.float32))
    assert dense.shape[1] == len(toxicity.FEATURES) == 18
    for text, row in zip(texts, dense):
        assert np.allclose(row, naive(text, weights), atol=1e-6), text


def test_calibrated_scores_rise_with_the_trees_probability(spark, docs, monkeypatch):
    """The isotonic step never turns two documents round."""
    texts, toxic = corpus(400)
    seen = []
    real = toxicity._probability
    monkeypatch.setattr(toxicity, "_probability", lambda model, df: seen.append(real(model, df)) or seen[-1])
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs(texts), labels).collect()}
    chances = {r["doc_id"]: r["_p"] for r in seen[-1].select("doc_id", "_p").collect()}
    order = sorted(chances, key=chances.get)
    assert all(scores[a] <= scores[b] for a, b in zip(order, order[1:])) and len(set(scores.values())) > 1
