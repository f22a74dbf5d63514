import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from undertow.llm import langid

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(open(PATH, "rb").read())


def brute_score(pieces, log_p, word):
    """The sum over all segmentations, one by one."""
    known = {}

    def find(part):
        if part not in known:
            h = 0
            for byte in part:
                h = (h * int(langid._BASE) + byte + 1) & (2**64 - 1)
            known[part] = int(pieces.find(np.array([h], np.uint64))[0])
        return known[part]

    def all_of(rest):
        if not rest:
            return 1.0
        return sum(
            math.exp(log_p[find(rest[:k])]) * all_of(rest[k:]) for k in range(1, len(rest) + 1) if find(rest[:k]) >= 0
        )

    return math.log(all_of(b" " + word))


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(1)
    log_p = np.log(rng.dirichlet(np.ones(pieces.count), 2).T)
    log_p = np.vstack([log_p, np.full((1, 2), -np.inf)])
    words = [b"a", b"the", b"thing", "éü".encode(), "日".encode(), b"wordword"]
    got = langid.Model(["x", "y"], log_p).word_scores(pieces, words)
    for i, w in enumerate(words):
        assert np.allclose(got[i], [brute_score(pieces, log_p[:, g], w) for g in (0, 1)])


def test_long_words_stay_finite(pieces):
    log_p = np.full((pieces.count + 1, 1), -np.log(pieces.count))
    log_p[-1] = -np.inf
    got = langid.Model(["x"], log_p).word_scores(pieces, [b"qzx" * 80, b"a" * 255])
    assert np.isfinite(got).all() and (got < -50).all()


def test_expected_uses_add_up(pieces):
    """Every byte of a word belongs to one piece in each segmentation."""
    p = np.full(pieces.count + 1, 1 / pieces.count)
    p[-1] = 0
    word = b"thinking"
    uses = langid._expected(p, pieces, [word], np.array([3.0]))
    step, total = 1e-6, 0.0  # the derivative of log P by log p is the expected use
    base = langid.Model(["x"], np.log(np.maximum(p, 0))[:, None]).word_scores(pieces, [word])[0, 0]
    for i in np.argsort(-uses)[:5]:
        q = np.log(np.maximum(p, 0))
        q[i] += step
        moved = langid.Model(["x"], q[:, None]).word_scores(pieces, [word])[0, 0]
        assert math.isclose((moved - base) / step * 3, uses[i], rel_tol=1e-3)
        total += uses[i]
    assert uses[-1] == 0 and total > 0


def test_words():
    assert langid.words(None) == [] and langid.words("1 2 -".encode()) == []
    assert langid.words("It's ÉTÉ, 3x".encode()) == [b"it", b"s", "été".encode(), b"x"]
    assert [len(w) for w in langid.words(b"a" * 600)] == [255, 255, 90]


def test_long_runs_are_summed_whole(pieces, monkeypatch):
    """Side by side and in stretches, or each word at once: the same sums, and the same expected uses."""
    rng = np.random.default_rng(2)
    log_p = np.log(rng.dirichlet(np.ones(pieces.count), 2).T)
    log_p = np.vstack([log_p, np.full((1, 2), -np.inf)])
    text = "".join(rng.choice(list("日本語の文章ภาษาไทยthinging"), 400)).encode()
    found = [text[:n] for n in (5, 10, 11, 12, 30, 31, 90, 250)] + [b"kato"]
    counts = rng.integers(1, 5, len(found)).astype(float)
    model = langid.Model(["x", "y"], log_p)
    scores, uses = model.word_scores(pieces, found), langid._expected(np.exp(log_p[:, 0]), pieces, found, counts)
    for part in (10, 64):
        monkeypatch.setattr(langid, "PART_BYTES", part)
        assert np.allclose(model.word_scores(pieces, found), scores, rtol=1e-9)
        p = np.exp(log_p[:, 0])
        got = langid._expected(p, pieces, found, counts) + langid._long_expected(p, pieces, found, counts)
        assert np.allclose(got, uses, rtol=1e-6, atol=1e-12)


def test_prediction_of_a_long_run(spark, docs, pieces):
    """No segmentation is left out at a border of parts, and no space put in."""
    rng = np.random.default_rng(3)
    first = np.log(rng.dirichlet(np.ones(pieces.count)))
    log_p = np.vstack([np.stack([first, first + rng.normal(0, 0.05, pieces.count)], 1), np.full((1, 2), -np.inf)])
    texts = ["日本語の文章を書いて" * 40, "ที่ภาษาไทย" * 30 + " thing", "ถ" * 86, "thing"]
    rows = langid.predict(docs(texts), langid.Model(["x", "y"], log_p), PATH).orderBy("doc_id").collect()
    for text, row in zip(texts, rows):
        total = np.zeros(2)
        for word in langid._NOT_LETTERS.sub(" ", text).encode().split():
            [(_, size, ends)] = whole_lattice(pieces, word)
            total += langid._forward(np.exp(log_p), size, ends, 1)[0][0]
        top = int(total.argmax())
        assert row["lang_pred"] == "xy"[top]
        assert math.isclose(row["score"], 1 / np.exp(total - total[top]).sum(), rel_tol=1e-9)


def whole_lattice(pieces, word):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(langid, "PART_BYTES", len(word))
        return list(pieces.lattice([word]))


def test_held_out_accuracy_and_odd_rows(spark, docs):
    random.seed(1)
    sounds = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ung", "eit", "ver"], "zz": ["eau", "tion", "ment", "que"]}
    texts, langs = [], []
    for i in range(150):
        lang = random.choice(sorted(sounds))
        texts.append(" ".join("".join(random.choices(sounds[lang], k=3)) for _ in range(30)))
        langs.append(lang)
    texts += [None, "", "123 !?", "kato " * 50_000, "ungeit", "ungeit"]
    langs += ["xx", "yy", None, None, None, None]
    ids = [*range(154), None, None]
    rows = langid.identify(docs(texts, ids, langs), PATH).collect()
    assert len(rows) == len(texts)
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == langs[i] for i in range(150))
    assert all(by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(154))
    assert [(by_id[i]["lang_pred"], by_id[i]["score"]) for i in (150, 151, 152)] == [("und", 0.0)] * 3
    assert by_id[153]["lang_pred"] == "xx"
    assert [(r["lang_pred"], r["held_out"]) for r in rows if r["doc_id"] is None] == [("yy", False)] * 2


def test_nothing_to_learn_from(spark, docs):
    got = langid.identify(docs(["some words"], langs=[None]), PATH).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert langid.identify(docs([]), PATH).count() == 0


@pytest.mark.parametrize("text, known", [("½ ²", False), ("Ⅷ ①", False), ("ª", True), ("12 ⓐ", False), ("٣ é", True), ("日本", True), ("_", False)])
def test_letters_are_letters_and_nothing_else(text, known):
    assert bool(langid.runs(text.encode())) is known == any(c.isalpha() for c in text)


def test_texts_without_a_letter_are_undecided(spark, docs):
    model = langid.Model(["en"], np.full((langid.Pieces(open(PATH, "rb").read()).count + 1, 1), -5.0))
    texts = ["½ ²", "Ⅷ ①", "", None, "ª"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(texts), model, PATH).collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "und", 4: "en"}


def test_a_column_of_anything_is_no_column_of_languages(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError, match="4 values of lang"):
        langid.train(docs(["a"] * 4, langs=list("abcd")), PATH)
